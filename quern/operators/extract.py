"""Links, content, dates and extraction strategies, each from one parse of a page."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import urljoin, urlsplit

import pandas as pd
from dateutil import parser as dates
from pyspark.sql import DataFrame, functions as F

from quern.functions import dom, url as U
from quern.operators.structure import selector

# Selector patterns of the learner with their confidence.
CONTENT = [
    ("article", 0.9), ("[role='main']", 0.85), ("main", 0.85), (".article-content", 0.8), (".post-content", 0.8), (".entry-content", 0.8), (".content", 0.7),
    ("#content", 0.7), (".main-content", 0.75), ("#main-content", 0.75), ("body", 0.75),
]
TITLE = [("h1.title", 0.9), ("h1.entry-title", 0.9), ("h1.post-title", 0.9), ("article h1", 0.85), (".article-title", 0.8), ("h1", 0.7), ("title", 0.75)]
DATE = [
    ("meta[property='article:published_time']", 0.96), ("meta[property='og:published_time']", 0.95), ("meta[itemprop='datePublished']", 0.95), ("time[datetime]", 0.93),
    (".published-date", 0.85), (".post-date", 0.85), (".date", 0.7),
]
AUTHOR = [("[rel='author']", 0.9), (".author", 0.8), (".byline", 0.8), ("[itemprop='author']", 0.9), (".post-author", 0.8)]
FIELDS = {"title": TITLE, "content": CONTENT, "date": DATE, "author": AUTHOR}
# Meta names of dates.
DATE_META = ["article:published_time", "article:modified_time", "og:published_time", "pubdate", "publish-date", "date"]
DATE_TEXT = re.compile(r"\b(?:\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d{1,2}\s+\w+\s+\d{2,4}|\w+\s+\d{1,2},?\s+\d{2,4})\b")

LINKS = "page_id long, links array<struct<url:string,text:string,rel:string,link_type:string,is_external:boolean,is_resource:boolean,nofollow:boolean>>"


def links(html: str | None, base: str) -> list[dict]:
    """Links of a page in order, one per resolved address: anchors, then images, scripts, stylesheets and frames."""
    root = dom.parse(html)
    nodes = [n for n in root.walk() if n is not root]
    home = next((n.attrs["href"] for n in nodes if n.tag == "base" and n.attrs.get("href")), "")
    base = urljoin(base, home)
    own = urlsplit(base).netloc.lower()
    out: dict[str, dict] = {}
    sources = [(n, "href", "anchor") for n in nodes if n.tag == "a"] + [
        (n, "src", kind) for kind, tag in (("image", "img"), ("script", "script"), ("iframe", "iframe")) for n in nodes if n.tag == tag
    ] + [(n, "href", "stylesheet") for n in nodes if n.tag == "link" and "stylesheet" in n.attrs.get("rel", "").lower()]
    for n, name, kind in sources:
        href = n.attrs.get(name, "").strip()
        if not href or href.startswith("#") or re.match("(javascript|mailto|tel|data):", href, re.I):
            continue
        try:
            full = urljoin(base, href)
            part = urlsplit(full)
        except ValueError:
            continue
        if part.scheme not in ("http", "https") or not part.netloc:
            continue
        full = full.split("#", 1)[0]
        if full not in out:
            rel = n.attrs.get("rel", "").lower()
            out[full] = {
                "url": full, "text": n.text()[:200], "rel": rel, "link_type": kind, "is_external": part.netloc.lower() != own,
                "is_resource": kind != "anchor" or bool(re.search(rf"\.({'|'.join(U.RESOURCES)})$", part.path.lower())), "nofollow": "nofollow" in rel.split(),
            }
    return list(out.values())


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> one row per link, its normalized address included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "links": [links(h, u or "") for h, u in zip(b["html"], b["url"], strict=True)]})

    rows = pages.select("page_id", "url", "html").mapInPandas(run, LINKS).select("page_id", F.explode("links").alias("l")).select("page_id", "l.*")
    return rows.withColumn("norm_url", U.normalize(F.col("url")))


def follow(rows: DataFrame, *, external: bool = False, allowed: tuple[str, ...] = (), exclude: tuple[str, ...] = (), resources: bool = False, nofollow: bool = False) -> DataFrame:
    """Links a crawler takes: no nofollow, no resources, none of the excluded patterns; all external ones if wanted, else those
    of allowed domains and their subdomains only."""
    ok = F.lit(True)
    if not nofollow:
        ok = ok & ~F.col("nofollow")
    if not resources:
        ok = ok & ~F.col("is_resource")
    for p in exclude:
        ok = ok & ~F.col("url").rlike(p)
    if not external:
        inside = ~F.col("is_external")
        for d in allowed:
            inside = inside | (U.domain("url") == d) | U.domain("url").endswith("." + d)
        ok = ok & inside
    return rows.where(ok)


def page_urls(rows: DataFrame, *, external: bool = False, **options) -> DataFrame:
    """The addresses that a page is said to lead to: of the links taken the internal ones, and external ones only if wanted,
    whatever domains are allowed."""
    taken = follow(rows, external=external, **options)
    return (taken if external else taken.where("not is_external")).select("page_id", "url", "norm_url")


# Dates within a text, in ISO form and as Unix time.
ISO = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?")
UNIX = re.compile(r"\b\d{10,13}\b")


def _readings(text: str) -> Iterator[Callable[[], datetime | None]]:
    """Ways to read a text as a date, in order."""
    yield lambda: dates.parse(text, fuzzy=True, default=datetime(2000, 1, 1))
    yield lambda: datetime.fromisoformat(m[0].replace("Z", "+00:00")) if (m := ISO.search(text)) else None
    yield lambda: datetime.fromtimestamp(int(m[0]) / (1000 if len(m[0]) == 13 else 1), timezone.utc) if (m := UNIX.search(text)) else None


def parse_date(text: str | None, now: datetime | None = None) -> str | None:
    """ISO form with zone of a date in free form, within a text, or in Unix seconds or milliseconds: the first reading that
    isn't later than `now` (the time of the capture, by default the present)."""
    text = (text or "").strip()
    if len(text) < 4:
        return None
    now = now or datetime.now(timezone.utc)
    for read in _readings(text):
        try:
            at = read()
        except (ValueError, OverflowError, TypeError, OSError):
            continue
        if at is not None:
            at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
            if at <= now:
                return at.isoformat()
    return None


def json_ld(root: dom.Node, key: str) -> str | None:
    """The first value of a key in the page's JSON-LD blocks, depth first."""

    def find(x: object) -> object:
        if isinstance(x, dict):
            if key in x and not isinstance(x[key], (dict, list)):
                return x[key]
            x = list(x.values())
        if isinstance(x, list):
            for y in x:
                if (v := find(y)) is not None:
                    return v
        return None

    for n in root.walk():
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                if (v := find(json.loads(n.text(raw=True)))) is not None:
                    return str(v)
            except ValueError:
                continue
    return None


def _dated(nodes: list[dom.Node], text: Callable[[], str]) -> Iterator[tuple[str | None, float]]:
    """(text, confidence) where a page may give its date, in order of trust: meta elements, time elements, elements named like
    dates, then the first ten in the text."""
    for name in DATE_META:
        for attribute in ("property", "name"):
            if n := next((n for n in nodes if n.tag == "meta" and n.attrs.get(attribute) == name), None):
                yield n.attrs.get("content"), 0.9
                break
    for n in nodes:
        if n.tag == "time":
            yield n.attrs.get("datetime"), 0.95
            yield n.text(), 0.9
    for what in ("class", "id"):
        for n in nodes:
            if re.search("date|time|publish|posted", n.attrs.get(what, ""), re.I):
                yield n.text(), 0.75
    for candidate in DATE_TEXT.findall(text())[:10]:
        yield candidate, 0.6


def page_date(root: dom.Node, now: datetime | None = None) -> tuple[str | None, float]:
    """The date of a page and its confidence."""
    return next(((d, sure) for t, sure in _dated(root.nodes(), root.text) if (d := parse_date(t, now))), (None, 0.0))


def value(root: dom.Node, sel: str, method: str = "text", attribute: str | None = None, now: datetime | None = None) -> str | None:
    """The values of all elements of a selector, distinct and in document order, between blank lines; those of date
    selectors, and of the attribute 'date', are parsed, and the earliest counts."""
    dated, out = attribute == "date" or bool(re.search("date|time", sel)), []
    for n in dom.select(root, sel):
        if dated:
            v = parse_date(n.attrs.get("datetime") or n.attrs.get("content") or n.text(), now)
        elif method == "attribute" and attribute:
            v = n.attrs.get(attribute)
        elif method == "html":
            v = n.html()
        else:
            v = n.attrs.get("content") if n.tag == "meta" else n.text()
        if v:
            out.append(v)
    return (min(out) if dated and out else "\n\n".join(dict.fromkeys(out))) or None


def rule_value(root: dom.Node, rule: dict, key: str | None = None, now: datetime | None = None) -> tuple[str | None, float]:
    """A rule's value: JSON-LD if it has the key, the primary selector, then fallbacks at 0.9 of the confidence each."""
    if key and (v := json_ld(root, key)):
        return v, 0.95
    confidence = rule.get("confidence", 1.0)
    for i, sel in enumerate([rule["primary"], *rule.get("fallbacks", [])]):
        if v := value(root, sel or "", rule.get("method") or "text", rule.get("attribute"), now):
            return v, confidence * 0.9**i
    return None, 0.0


def best_selector(root: dom.Node, field: str) -> tuple[str, float] | None:
    """The best pattern of a field: its confidence, times 0.9 for two or three matches and 0.7 for more, halved for content
    under a hundred characters; earlier patterns win ties."""
    best = None
    for sel, confidence in FIELDS.get(field, ()):
        if found := dom.select(root, sel):
            score = confidence * (1.0 if len(found) == 1 else 0.9 if len(found) <= 3 else 0.7)
            if field == "content" and len(found[0].text()) < 100:
                score *= 0.5
            if best is None or score > best[1]:
                best = (sel, score)
    return best


def infer(page: str | dom.Node | None, least: float = 0.5) -> dict[str, tuple[str, float]]:
    """The best selector of each field, with its confidence, where that is `least` or more."""
    root = page if isinstance(page, dom.Node) else dom.parse(page)
    found = ((field, best_selector(root, field)) for field in FIELDS)
    return {field: best for field, best in found if best and best[1] >= least}


def adapt(old: dict[str, tuple[str, float]], html: str | None) -> dict[str, tuple[str, float]]:
    """A strategy for a changed page: selectors that still match at 0.95 of their confidence, else new ones at 0.8."""
    root = dom.parse(html)
    fresh = infer(root)
    out = {f: (s, c * 0.95) for f, (s, c) in old.items() if value(root, s)}
    return out | {f: (s, c * 0.8) for f, (s, c) in fresh.items() if f not in out}


def valid_fields(strategy: dict[str, tuple[str, float]], html: str | None) -> dict[str, bool]:
    root = dom.parse(html)
    return {f: value(root, s) is not None for f, (s, _) in strategy.items()}


EXTRACTION = (
    "page_id long, success boolean, title string, content string, author string, date string, date_confidence double, images array<string>, links array<string>, "
    "confidence double, strategy map<string,struct<selector:string,confidence:double>>, errors array<string>, warnings array<string>"
)


def extract(html: str | None, base: str, strategy: dict[str, tuple[str, float]] | None = None, now: datetime | None = None) -> dict:
    """A page's content by a strategy (by default its own inferred one). A page without a date can still succeed."""
    root = dom.parse(html)
    strategy = infer(root) if strategy is None else strategy
    got = {f: rule_value(root, {"primary": s, "confidence": c}, {"title": "headline", "author": "author"}.get(f), now) for f, (s, c) in strategy.items()}
    date, sure = page_date(root, now)
    title, content = (got.get(f, (None, 0.0))[0] for f in ("title", "content"))
    errors = [f"missing {f}" for f in ("title", "content") if not got.get(f, (None,))[0]]
    warnings = [w for w, bad in (("short title", title and len(title) < 5), ("short content", content and len(content) < 100), ("no date", not date)) if bad]
    scores = [c for v, c in got.values() if v]
    full = lambda n, *names: next((urljoin(base, n.attrs[a]) for a in names if n.attrs.get(a)), None)
    return {
        "success": not errors, "title": title, "content": content, "author": got.get("author", (None,))[0], "date": date, "date_confidence": sure,
        "images": list(dict.fromkeys(x for n in dom.select(root, "img") if (x := full(n, "src", "data-src")))), "links": list(dict.fromkeys(x for n in dom.select(root, "article a") if (x := full(n, "href")))),
        "confidence": sum(scores) / len(scores) if scores else 0.0, "strategy": {f: {"selector": s, "confidence": c} for f, (s, c) in strategy.items()}, "errors": errors, "warnings": warnings,
    }


def extractions(pages: DataFrame, captured: str | None = None) -> DataFrame:
    """The extraction of every page (page_id, url, html). Dates later than the capture are refused: `captured` names the
    column of its time; without it that is the present."""
    at = F.unix_seconds(F.col(captured).cast("timestamp")) if captured else F.lit(None).cast("long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            now = [None if pd.isna(t) else datetime.fromtimestamp(int(t), timezone.utc) for t in b["at"]]
            yield pd.DataFrame([{"page_id": i, **extract(h, u or "", now=t)} for i, u, h, t in zip(b["page_id"], b["url"], b["html"], now, strict=True)])

    return pages.select("page_id", "url", "html", at.alias("at")).mapInPandas(run, EXTRACTION)


def validity(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Extractions with `valid`: success, a title of five characters, content of a hundred, confidence of `least`; lengths
    of missing parts aren't checked."""
    ok = F.col("success") & (F.coalesce(F.length("title"), F.lit(5)) >= 5) & (F.coalesce(F.length("content"), F.lit(100)) >= 100) & (F.col("confidence") >= least)
    return rows.withColumn("valid", ok)


__all__ = ["links", "page_links", "follow", "parse_date", "page_date", "infer", "adapt", "extract", "extractions", "validity", "selector"]
