"""Extraction strategies as tables: rules applied to pages, adapted, checked and set by hand.

A strategy is a row (key, version, source, rules), rules a map from a field (title, content, date, author, images, links or
any other) to a rule. A page is parsed once, whatever its strategy's rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import dom
from quern.operators import extract as X
from quern.operators.limits import fold

RULE = "struct<primary:string,fallbacks:array<string>,method:string,attribute:string,confidence:double>"
STRATEGY = f"key string, version int, source string, rules map<string,{RULE}>"
#: Fields whose rules give lists of addresses, from the attributes named.
LISTS = {"images": ("src", "data-src"), "links": ("href",)}
FOUND = "array<struct<field:string,value:string,items:array<string>,confidence:double>>"


def _items(root: dom.Node, rule: dict, names: tuple[str, ...]) -> tuple[list[str], float]:
    """The addresses of the first selector that has any, a fallback's at 0.9 of the confidence per step."""
    for i, sel in enumerate([rule["primary"], *rule["fallbacks"]]):
        got = [v for n in dom.select(root, sel or "") if (v := next((n.attrs[a] for a in names if n.attrs.get(a)), None))]
        if got:
            return got, rule["confidence"] * 0.9**i
    return [], 0.0


def evaluate(root: dom.Node, rules: dict[str, dict], now: datetime | None = None) -> list[dict]:
    """What each rule gives on a page; fields without a value are left out."""
    out = []
    for field in sorted(rules):
        if field in LISTS:
            items, sure = _items(root, rules[field], LISTS[field])
            value = None
        else:
            items, (value, sure) = [], X.rule_value(root, rules[field], {"title": "headline", "author": "author"}.get(field), now)
        if value or items:
            out.append({"field": field, "value": value, "items": items, "confidence": round(sure, 9)})
    return out


def _rules(x) -> dict[str, dict]:
    return {k: {**v, "fallbacks": [] if v["fallbacks"] is None else list(v["fallbacks"])} for k, v in dict(x if x is not None else {}).items()}


def _joined(pages: DataFrame, strategies: DataFrame) -> DataFrame:
    """Pages (page_id, key, html) with the newest strategy of their key."""
    newest = strategies.groupBy("key").agg(F.max_by(F.struct("version", "source", "rules"), "version").alias("s"))
    return pages.select("page_id", "key", "html").join(newest, "key").select("page_id", "key", "html", "s.version", "s.rules")


def apply(pages: DataFrame, strategies: DataFrame, now: datetime | None = None) -> DataFrame:
    """(page_id, found) for the pages (page_id, key, html) whose key has a strategy: field, value or items, and confidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "found": [evaluate(dom.parse(h), _rules(r), now) for h, r in zip(b["html"], b["rules"], strict=True)]})

    return _joined(pages, strategies).select("page_id", "html", "rules").mapInPandas(run, f"page_id long, found {FOUND}")


def _adapt(root: dom.Node, rules: dict[str, dict]) -> dict[str, dict]:
    new = {}
    for field, rule in rules.items():
        if dom.select(root, rule["primary"] or ""):
            new[field] = {**rule, "confidence": rule["confidence"] * 0.95}
        elif best := X.best_selector(root, field):
            new[field] = _rule(best[0], best[1] * 0.8)
    return new


def _rule(primary: str, confidence: float) -> dict:
    return {"primary": primary, "fallbacks": [], "method": "text", "attribute": None, "confidence": confidence}


def adapted(pages: DataFrame, strategies: DataFrame) -> DataFrame:
    """Each page's strategy as adapted to it: a rule whose primary selector still matches stays at 0.95 of its confidence,
    another gives way to the best pattern of its field at 0.8, or is dropped; one version on, source 'adaptation'. A row per
    page: page_id and the strategy's columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, key, html, version, rules in b.itertuples(index=False, name=None):
                out.append((i, key, version + 1, "adaptation", _adapt(dom.parse(html), _rules(rules))))
            yield pd.DataFrame(out, columns=["page_id", "key", "version", "source", "rules"])

    return _joined(pages, strategies).mapInPandas(run, f"page_id long, {STRATEGY}")


def of_variant() -> Column:
    """The key of a variant's strategy, of a row's key and variant_id."""
    return F.concat_ws("#", "key", "variant_id")


def lived(life: DataFrame, pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The strategies that a life cycle (`life`: key, page_id, variant_id, action, version) leads to, by variant (`of_variant`) and
    version: inferred from the page where a variant is learned or learned anew, else the variant's last one adapted to the page.

    `known` are strategies of earlier calls; a variant without one has it inferred. Only pages that change a variant are read and
    parsed, in the order of versions; a variant's are one task's, and its rules are all that is held.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = life.where("action <> 'matched'").join(pages.select("page_id", "html"), "page_id")
    rows = rows.select(of_variant().alias("key"), "version", "action", "html", none(f"map<string,{RULE}>").alias("rules"))
    if known is not None:
        newest = known.groupBy("key").agg(F.max_by("rules", "version").alias("rules"))
        rows = rows.unionByName(newest.join(rows.select("key").distinct(), "key", "left_semi").select("key", F.lit(0).alias("version"), F.lit("known").alias("action"), none("string").alias("html"), "rules"))

    def step(rules: dict | None, r: dict) -> tuple[dict, tuple]:
        if r["action"] == "known":
            new, source = _rules(r["rules"]), "known"
        elif r["action"] == "adapted" and rules is not None:
            new, source = _adapt(dom.parse(r["html"]), rules), "adaptation"
        else:
            new, source = {f: _rule(*best) for f, best in X.infer(r["html"]).items()}, "learned"
        return new, (r["key"], int(r["version"]), source, new)

    return fold(rows, "key", ["version"], lambda: None, step, STRATEGY).where("source <> 'known'")


def validated(pages: DataFrame, strategies: DataFrame) -> DataFrame:
    """(page_id, valid, fields): whether every rule of the page's strategy gives something, and for each field."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, html, rules in b.itertuples(index=False, name=None):
                given = _rules(rules)
                have = {f["field"] for f in evaluate(dom.parse(html), given)}
                out.append((i, have == set(given), {f: f in have for f in given}))
            yield pd.DataFrame(out, columns=["page_id", "valid", "fields"])

    return _joined(pages, strategies).select("page_id", "html", "rules").mapInPandas(run, "page_id long, valid boolean, fields map<string,boolean>")


def overridden(strategies: DataFrame, edits: DataFrame) -> DataFrame:
    """New versions of the strategies that `edits` (key, field, selector) change by hand: the selector is the rule's primary at
    full confidence, the old one its only fallback; source 'manual'. An edit of a field that the strategy lacks adds it."""
    newest = strategies.groupBy("key").agg(F.max_by(F.struct("version", "rules"), "version").alias("s")).select("key", "s.*")
    wanted = edits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "selector"))).alias("want"))  # a key's fields
    both = newest.join(wanted, "key")
    rule = lambda field: F.struct(
        F.col("want")[field].alias("primary"), F.filter(F.array(F.col("rules")[field]["primary"]), lambda x: x.isNotNull()).alias("fallbacks"), F.lit("text").alias("method"),
        F.lit(None).cast("string").alias("attribute"), F.lit(1.0).alias("confidence"))
    new = F.map_from_entries(F.transform(F.map_keys("want"), lambda f: F.struct(f, rule(f))))
    kept = F.map_filter("rules", lambda k, v: ~F.map_contains_key("want", k))
    return both.select("key", (F.col("version") + 1).cast("int").alias("version"), F.lit("manual").alias("source"), F.map_concat(kept, new).alias("rules"))


def describe() -> Column:
    """A strategy in words."""
    sure = lambda f: F.concat(F.lit("("), F.round(F.col("rules")[f]["confidence"] * 100).cast("int").cast("string"), F.lit("% confidence)"))
    line = lambda f, name: F.when(F.map_contains_key("rules", f), F.concat(F.lit(f"{name} extracted using "), F.col("rules")[f]["primary"], F.lit(" selector "), sure(f)))
    other = F.array_sort(F.filter(F.map_keys("rules"), lambda k: ~k.isin("title", "content", "images", "links")))
    return F.concat_ws(
        " ", F.concat(F.lit("Extraction strategy for "), F.col("key"), F.lit(" pages")), F.concat(F.lit("Learning source: "), F.col("source")), line("title", "Title"), line("content", "Content"),
        F.when(F.size(other) > 0, F.concat(F.lit("Metadata fields: "), F.array_join(other, ", "))))
