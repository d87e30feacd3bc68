"""Page structures: one parse of a page gives everything the structural operators need."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import dom, text as T
from quern.operators.pieces import pieces
from quern.operators.variants import Variants

SCHEMA = (
    "page_id long, tag_counts map<string,int>, depth_distribution map<int,int>, parent_child_pairs map<string,int>, css_class_map map<string,int>, "
    "css_class_rank map<string,int>, id_attributes array<string>, semantic_landmarks map<string,string>, "
    "content_regions array<struct<name:string,primary_selector:string,fallback_selectors:array<string>,confidence:double>>, navigation_selectors array<string>, "
    "pagination struct<next_selector:string,prev_selector:string,pattern:string>, "
    "iframes array<struct<selector:string,src_pattern:string,position:string,is_dynamic:boolean>>, script_signatures array<string>, content_hash string"
)
# Semantic elements and roles that are landmarks.
LANDMARKS = ("header", "nav", "main", "article", "section", "aside", "footer", "figure", "figcaption")
ROLES = ("banner", "navigation", "main", "contentinfo")
# Frameworks that inline scripts name, and those that descriptions name.
FRAMEWORKS = ("jquery", "react", "vue", "angular")
KNOWN_FRAMEWORKS = ("react", "vue", "angular", "jquery", "bootstrap", "next", "nuxt")
# Elements that hold a page's content, best first, with other selectors for it and confidence; words of such classes.
REGIONS = {"article": (("main", ".content", "#content"), 0.9), "main": ((".main-content", "#main"), 0.85)}
CONTENT_WORDS = ("content", "article", "post", "entry")
# The parts of a comparison, their weights, and the kind of change that each stands for.
PARTS = {
    "tag": (0.30, "structure_reorganized", "tag_hierarchy"), "regions": (0.25, "content_relocated", "content_regions"), "navigation": (0.15, "url_pattern_changed", "navigation"),
    "landmarks": (0.15, "structure_reorganized", "semantic_landmarks"), "css": (0.10, "class_renamed", "css_classes"), "ids": (0.05, "id_changed", "id_attributes"),
}


def selector(n: dom.Node) -> str:
    """tag#id, or tag with at most two classes."""
    if n.attrs.get("id"):
        return f"{n.tag}#{n.attrs['id']}"
    return n.tag + "".join(f".{c}" for c in n.classes()[:2])


def analyze(html: str | None) -> dict:
    """The structure of a page; see SCHEMA."""
    root = dom.parse(html)
    nodes = [n for n in root.walk() if n is not root]
    body = next((n for n in nodes if n.tag == "body"), root)
    tags, depths, pairs = Counter(), Counter(), Counter()
    stack = [(c, 1) for c in reversed(body.children) if isinstance(c, dom.Node)]
    while stack:  # below the body, ten levels; a pair may reach the eleventh
        n, depth = stack.pop()
        tags[n.tag] += 1
        depths[depth] += 1
        below = [c for c in n.children if isinstance(c, dom.Node)]
        for c in below:
            pairs[f"{n.tag}>{c.tag}"] += 1
        if depth < 10:
            stack += [(c, depth + 1) for c in reversed(below)]
    classes = Counter(c for n in nodes for c in n.classes())
    rank = {c: i for i, c in enumerate(classes)}
    marks: dict[str, str] = {}
    for tag in LANDMARKS:
        n = next((n for n in nodes if n.tag == tag), None)
        if n is not None:
            marks[tag] = selector(n)
    for n in nodes:
        if n.attrs.get("role") in ROLES:
            marks[n.attrs["role"]] = selector(n)
    navs = [selector(n) for n in nodes if n.tag == "nav"]
    for n in nodes:
        if re.search("nav|menu|navigation", " ".join(n.classes()), re.I) and selector(n) not in navs:
            navs.append(selector(n))
    return {
        "tag_counts": dict(tags), "depth_distribution": dict(depths), "parent_child_pairs": dict(pairs.most_common(50)),
        "css_class_map": dict(classes.most_common(100)), "css_class_rank": {c: rank[c] for c, _ in classes.most_common(100)},
        "id_attributes": sorted({n.attrs["id"] for n in nodes if n.attrs.get("id")}), "semantic_landmarks": marks,
        "content_regions": _regions(nodes), "navigation_selectors": navs[:10],
        "pagination": _pages(nodes), "iframes": [_iframe(n) for n in nodes if n.tag == "iframe"], "script_signatures": _scripts(nodes),
        "content_hash": hashlib.md5(re.sub(r"\s+", " ", html or "").encode()).hexdigest(),
    }


def _regions(nodes: list[dom.Node]) -> list[dict]:
    """At most five regions: the article, or else main; then divs by the class that sounds like content, one per class."""
    tags = {n.tag for n in nodes}
    top = next((t for t in REGIONS if t in tags), None)
    named = [(top, top, *REGIONS[top])] if top else []
    sounding = (next((c for c in n.classes() if any(w in c.lower() for w in CONTENT_WORDS)), None) for n in nodes if n.tag == "div")
    named += [(c, f"div.{c}", (), 0.7) for c in dict.fromkeys(sounding) if c]
    return [{"name": name, "primary_selector": sel, "fallback_selectors": list(others), "confidence": sure} for name, sel, others, sure in named[:5]]


def _pages(nodes: list[dom.Node]) -> dict | None:
    box = next((n for n in nodes if re.search("pag|page-nav", " ".join(n.classes()), re.I)), None)
    box = box or next((n for n in nodes if n.tag == "nav" and re.search("pag", n.attrs.get("aria-label", ""), re.I)), None)
    links = [n for n in box.walk() if n.tag == "a"] if box else []
    find = lambda p: next((selector(n) for n in links if re.search(p, n.text(), re.I)), None)
    after = find("next|→|›|»")
    if not after:
        return None
    numbered = (n.attrs.get("href", "") for n in links if re.fullmatch(r"\d+", n.text()))
    href = next((h for h in numbered if "page" in h.lower()), None)
    return {"next_selector": after, "prev_selector": find("prev|←|‹|«"), "pattern": re.sub(r"\d+", "{n}", href) if href else None}


def _iframe(n: dom.Node) -> dict:
    src = n.attrs.get("src") or n.attrs.get("data-src", "")
    where = next((a.tag for a in n.ancestors() if a.tag in ("header", "footer", "aside", "nav", "article", "main")), "body")
    shape = re.sub(r"[0-9a-f]{8,}", "{hash}", re.sub(r"/\d+", "/{id}", src.split("?")[0]), flags=re.I)
    return {"selector": selector(n), "src_pattern": shape, "position": where, "is_dynamic": "data-src" in n.attrs or not n.attrs.get("src")}


def _scripts(nodes: list[dom.Node]) -> list[str]:
    out: list[str] = []
    for n in nodes:
        if n.tag == "script" and n.attrs.get("src"):
            m = re.search(r"/([^/]+\.js)", n.attrs["src"])
            out.append(m[1] if m else n.attrs["src"].rsplit("/", 1)[-1])
        elif n.tag == "script":
            out += [f for f in FRAMEWORKS if f in n.text(raw=True).lower()]
    return list(dict.fromkeys(out))[:20]


def structures(pages: DataFrame) -> DataFrame:
    """The structure of every page (page_id, html), parsed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            yield pd.DataFrame([{"page_id": i, **analyze(h)} for i, h in zip(b["page_id"], b["html"], strict=True)], columns=[c.split()[0] for c in _top(SCHEMA)])

    return pages.select("page_id", "html").mapInPandas(run, SCHEMA)


def _top(schema: str) -> list[str]:
    """The fields of a schema string, not those of its nested types."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def top_classes(s: str, n: int = 50) -> Column:
    """The n most frequent classes, ties by first appearance."""
    entries = F.transform(F.map_entries(f"{s}.css_class_map"), lambda e: F.struct((-e["value"]).alias("n"), F.col(f"{s}.css_class_rank")[e["key"]].alias("r"), e["key"].alias("k")))
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: e["k"])


def region_names(s: str) -> Column:
    return region_names_of(f"{s}.content_regions")


def region_names_of(regions: str) -> Column:
    return F.transform(regions, lambda r: r["name"])


def changes(pairs: DataFrame, breaking: float = 0.70) -> DataFrame:
    """`pairs` with structs `old` and `new`: the six component similarities, the weighted `similarity`, its class, whether a
    new strategy is needed (similarity under `breaking`) and the changed components (similarity under 0.9)."""
    keys = lambda s: F.map_keys(f"{s}.semantic_landmarks")
    same = F.col("old.content_hash") == F.col("new.content_hash")
    parts = {
        "tag": F.when(same, 1.0).otherwise(T.multiset_overlap(F.col("old.tag_counts"), F.col("new.tag_counts"))),
        "regions": T.jaccard(region_names("old"), region_names("new")), "navigation": T.jaccard(F.col("old.navigation_selectors"), F.col("new.navigation_selectors")),
        "landmarks": T.jaccard(keys("old"), keys("new")), "css": T.jaccard(top_classes("old"), top_classes("new")), "ids": T.jaccard(F.col("old.id_attributes"), F.col("new.id_attributes")),
    }
    out = pairs.select("*", *[c.alias(f"sim_{k}") for k, c in parts.items()])
    total = sum((F.col(f"sim_{k}") * w for k, (w, _, _) in PARTS.items()), F.lit(0.0))
    changed = F.filter(F.array(*[F.when(F.col(f"sim_{k}") < 0.9, k) for k in parts]), lambda x: x.isNotNull())
    out = out.withColumn("similarity", total).withColumn("changed", changed).withColumn("change_class", classify(F.col("similarity")))
    return out.withColumn("relearn", F.round("similarity", 9) < breaking)


def change_records(pairs: DataFrame, breaking: float = 0.70) -> DataFrame:
    """`pairs` with the columns of `changes` and `records`: for each changed component its change_type, name, similarity,
    whether it is breaking, confidence, reason, and what was added and removed (sorted; of landmarks also those whose
    selector changed). Evidence is cut to 20 entries, of ids to 30."""
    out = changes(pairs, breaking)
    keys = lambda s: F.map_keys(f"{s}.semantic_landmarks")
    sides = {
        "tag": (F.map_keys("old.tag_counts"), F.map_keys("new.tag_counts")), "regions": (region_names("old"), region_names("new")),
        "navigation": (F.col("old.navigation_selectors"), F.col("new.navigation_selectors")), "landmarks": (keys("old"), keys("new")),
        "css": (top_classes("old"), top_classes("new")), "ids": (F.col("old.id_attributes"), F.col("new.id_attributes")),
    }
    moved = F.filter(F.array_sort(F.array_intersect(keys("old"), keys("new"))), lambda k: F.col("old.semantic_landmarks")[k] != F.col("new.semantic_landmarks")[k])

    def record(k: str) -> Column:
        s, (_, kind, name), (old, new) = F.col(f"sim_{k}"), PARTS[k], sides[k]
        most = 30 if k == "ids" else 20
        cut = lambda c: F.slice(F.array_sort(c), 1, most)
        return F.when(s < 0.9, F.struct(
            F.lit(kind).alias("change_type"), F.lit(name).alias("component"), s.alias("similarity"), (s < breaking).alias("breaking"), (1 - s).alias("confidence"),
            F.format_string(f"{name} similarity: %.2f%%", s * 100).alias("reason"), cut(F.array_except(new, old)).alias("added"), cut(F.array_except(old, new)).alias("removed"),
            (moved if k == "landmarks" else F.array().cast("array<string>")).alias("moved")))

    return out.withColumn("records", F.filter(F.array(*[record(k) for k in PARTS]), lambda r: r.isNotNull()))


def has_breaking(records: Column) -> Column:
    return F.exists(records, lambda r: r["breaking"])


def compare(pairs: DataFrame) -> DataFrame:
    """`pairs` (old, new) with `similarity`: the mean Jaccard of tags, classes, ids and landmarks, over those that either has;
    0 where neither has any."""
    keys = lambda s, c: F.map_keys(f"{s}.{c}")
    parts = F.array(
        *[T.jaccard(keys("old", c), keys("new", c), None) for c in ("tag_counts", "css_class_map", "semantic_landmarks")],
        T.jaccard(F.col("old.id_attributes"), F.col("new.id_attributes"), None))
    some = F.filter(parts, lambda x: x.isNotNull())
    return pairs.withColumn("similarity", F.when(F.size(some) == 0, 0.0).otherwise(F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some)))


def compare_versions(pairs: DataFrame) -> DataFrame:
    """`pairs` (old, new) with the inspector's comparison: Jaccard of tags and of classes (1 for two empty sets), their mean,
    and what was added and removed of each, sorted."""
    tag, css = ((F.map_keys(f"old.{c}"), F.map_keys(f"new.{c}")) for c in ("tag_counts", "css_class_map"))
    diff = lambda a, b: F.array_sort(F.array_except(a, b))
    out = pairs.withColumn("tag_similarity", T.jaccard(*tag)).withColumn("class_similarity", T.jaccard(*css))
    out = out.withColumn("overall_similarity", (F.col("tag_similarity") + F.col("class_similarity")) / 2)
    return (out.withColumn("tags_added", diff(tag[1], tag[0])).withColumn("tags_removed", diff(*tag)).withColumn("classes_added", diff(css[1], css[0]))
            .withColumn("classes_removed", diff(*css)).withColumn("same_hash", F.col("old.content_hash") == F.col("new.content_hash")))


def monitor_fingerprint() -> Column:
    """Sixteen digits over tags with counts, the thirty most frequent classes, ids, landmarks and navigation, each sorted;
    texts, times and scores of a page don't count. The canonical string is our own."""
    pairs = F.transform(F.array_sort(F.map_entries("tag_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    entries = F.transform(F.map_entries("css_class_map"), lambda e: F.struct((-e["value"]).alias("n"), F.col("css_class_rank")[e["key"]].alias("r"), e["key"].alias("k")))
    css = F.array_sort(F.transform(F.slice(F.array_sort(entries), 1, 30), lambda e: e["k"]))
    named = (("tags", pairs), ("classes", css), ("ids", F.array_sort("id_attributes")), ("landmarks", F.array_sort(F.map_keys("semantic_landmarks"))), ("nav", F.array_sort("navigation_selectors")))
    return F.substring(F.sha2(F.concat_ws("|", *[F.when(F.size(c) > 0, F.concat(F.lit(f"{n}:"), F.array_join(c, ","))) for n, c in named]), 256), 1, 16)


def change_similarity(old: dict, new: dict) -> float:
    """The weighted similarity of `changes` for two structures in hand, for operators that go through pages in order."""
    share = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    ta, tb = dict(old["tag_counts"]), dict(new["tag_counts"])
    high = sum(max(ta.get(t, 0), tb.get(t, 0)) for t in ta.keys() | tb.keys())
    tag = 1.0 if old["content_hash"] == new["content_hash"] or not high else sum(min(ta.get(t, 0), tb.get(t, 0)) for t in ta.keys() | tb.keys()) / high

    def top(s: dict) -> set[str]:
        rank = dict(s["css_class_rank"])
        return {c for c, _ in sorted(dict(s["css_class_map"]).items(), key=lambda e: (-e[1], rank[e[0]]))[:50]}

    sims = {
        "tag": tag, "regions": share({r["name"] for r in old["content_regions"]}, {r["name"] for r in new["content_regions"]}),
        "navigation": share(set(old["navigation_selectors"]), set(new["navigation_selectors"])), "landmarks": share(set(dict(old["semantic_landmarks"])), set(dict(new["semantic_landmarks"]))),
        "css": share(top(old), top(new)), "ids": share(set(old["id_attributes"]), set(new["id_attributes"])),
    }
    return sum(s * PARTS[k][0] for k, s in sims.items())


def classify(similarity: Column) -> Column:
    s = F.round(similarity, 9)
    return F.when(s >= 0.95, "cosmetic").when(s >= 0.85, "minor").when(s >= 0.70, "moderate").otherwise("breaking")


def fingerprint(s: str = "") -> Column:
    """Twelve digits over ten features that tell variants of a page type apart."""
    c = lambda x: F.col(f"{s}.{x}" if s else x)
    n = lambda tag: F.coalesce(c("tag_counts")[tag], F.lit(0))
    has = lambda tag: F.concat(F.lit(f"{tag}:"), F.initcap((n(tag) > 0).cast("string")))
    marks = F.array_join(F.slice(F.array_sort(F.map_keys(c("semantic_landmarks"))), 1, 5), ",")
    return F.substring(F.md5(F.concat_ws(
        "|", *[has(t) for t in ("article", "video", "iframe", "table", "form")], F.concat(F.lit("nav:"), F.least(n("nav"), F.lit(5))),
        F.concat(F.lit("regions:"), F.size(c("content_regions"))), F.concat(F.lit("landmarks:"), F.when(marks == "", "none").otherwise(marks)),
        F.concat(F.lit("pagination:"), F.initcap(c("pagination").isNotNull().cast("string"))),
        F.concat(F.lit("img:"), F.least(F.floor(n("img") / 5).cast("int"), F.lit(10))))), 1, 12)


def variant_similarity(a: dict, b: dict) -> float:
    """Weighted mean over the parts that either page has."""
    ta, tb = dict(a["tag_counts"]), dict(b["tag_counts"])
    got: list[tuple[float, float]] = []
    share = lambda x, y: len(x & y) / len(x | y)
    if ta or tb:
        got.append((share(ta.keys(), tb.keys()), 0.3))
        if both := ta.keys() & tb.keys():
            got.append((sum(1 - abs(ta[t] - tb[t]) / max(ta[t], tb[t]) for t in both) / len(both), 0.2))
    for w, x, y in ((0.2, {r["name"] for r in a["content_regions"]}, {r["name"] for r in b["content_regions"]}), (0.15, set(dict(a["semantic_landmarks"])), set(dict(b["semantic_landmarks"])))):
        if x or y:
            got.append((share(x, y), w))
    got.append((1.0 if (a["pagination"] is None) == (b["pagination"] is None) else 0.5, 0.05))
    na, nb = len(a["navigation_selectors"]), len(b["navigation_selectors"])
    if max(na, nb):
        got.append((1 - abs(na - nb) / max(na, nb), 0.1))
    return sum(s * w for s, w in got) / sum(w for _, w in got)


def _compared(rows: DataFrame) -> DataFrame:
    """`rows` with what the similarity of variants looks at, and `shape`, a digest of it: names of regions and landmarks, whether
    there is pagination, and how much navigation; the rest of a structure isn't sent along."""
    names = region_names_of("content_regions")
    shape = F.struct(F.array_sort(F.map_entries("tag_counts")), F.array_sort(F.array_distinct(names)), F.array_sort(F.map_keys("semantic_landmarks")), F.col("pagination").isNull(), F.size("navigation_selectors"))
    return rows.select(
        "key", "seq", "page_id", "tag_counts", F.transform(names, lambda n: F.struct(n.alias("name"))).alias("content_regions"), F.transform_values("semantic_landmarks", lambda k, v: F.lit("")).alias("semantic_landmarks"),
        F.when(F.col("pagination").isNotNull(), "").alias("pagination"), F.transform("navigation_selectors", lambda n: F.lit("")).alias("navigation_selectors"), "fingerprint", F.md5(F.to_json(shape)).alias("shape"))


def _assigned(rows: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known = None, None
        for b in pieces(batches):
            out = []
            for r in b.to_dict("records"):
                if known is None or r["key"] != at:
                    at, known = r["key"], Variants(least, variant_similarity)
                _, i = known.best(r)
                if i is None:
                    known.add({k: r[k] for k in ("tag_counts", "content_regions", "semantic_landmarks", "pagination", "navigation_selectors", "fingerprint")})
                out.append((r["key"], r["page_id"], known.items[-1 if i is None else i]["fingerprint"], i is None))
            yield pd.DataFrame(out, columns=["key", "page_id", "variant_id", "started"])

    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, "key string, page_id long, variant_id string, started boolean")


def assign_variants(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """`rows` (key, seq, page_id, the structure's columns, fingerprint): each page in order joins the most similar variant
    of its key (at `least` or more) or starts one named by its fingerprint. Sequential within a key; the state is the
    key's variants with their index, not its pages."""
    return _assigned(_compared(rows), least)


def started_variants(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """The variants (key, page_id, variant_id) that pages start in `assign_variants`. A page shaped as an earlier one of its key
    finds at least the variant that the earlier one joined or started, so only first pages of a shape go through the key's one task."""
    rows = _compared(rows)
    rest = [c for c in rows.columns if c not in ("key", "shape")]
    first = rows.groupBy("key", "shape").agg(F.min_by(F.struct(*rest), F.struct("seq", "page_id")).alias("_r")).select("key", "shape", "_r.*")
    return _assigned(first, least).where("started").drop("started")


def describe() -> Column:
    """A page's structure in words."""
    n = lambda tag: F.coalesce(F.col("tag_counts")[tag], F.lit(0))
    total = F.aggregate(F.map_values("tag_counts"), F.lit(0), lambda a, x: a + x)
    say = lambda cond, words: F.when(cond, F.lit(words))
    return F.concat_ws(
        " ", F.concat(F.lit("Page with "), total, F.lit(" elements.")), say(n("p") > 10, "Text heavy."), say(n("img") > 10, "Image heavy."), say(n("a") > 50, "Link heavy."),
        F.when(F.size("semantic_landmarks") > 0, F.concat(F.lit("Landmarks: "), F.array_join(F.array_sort(F.map_keys("semantic_landmarks")), ", "), F.lit("."))),
        F.when(F.size("script_signatures") > 0, F.concat(F.lit("Scripts: "), F.array_join(F.array_sort("script_signatures"), ", "), F.lit("."))),
        say(F.size("css_class_map") > 50, "Rich styling."), say(F.col("pagination").isNotNull(), "Paginated."))


def describe_briefly(page_type: Column) -> Column:
    """The features by which similar pages are found, in fixed order."""
    n = lambda tag: F.coalesce(F.col("tag_counts")[tag], F.lit(0))
    total = F.aggregate(F.map_values("tag_counts"), F.lit(0), lambda a, x: a + x)
    has = lambda cond, word: F.when(cond, F.lit(f"has:{word}"))
    marks = F.transform(F.array_sort(F.map_keys("semantic_landmarks")), lambda k: F.concat(F.lit("landmark:"), k))
    return F.concat_ws(
        " ", F.concat(F.lit("type:"), page_type), F.when(total > 1000, "size:large").when(total > 200, "size:medium").otherwise("size:small"), has(n("article") > 0, "article"),
        has(n("table") > 0, "tables"), has(n("form") > 0, "forms"), has(n("nav") > 2, "complex-nav"), has(F.col("pagination").isNotNull(), "pagination"), has(F.size("iframes") > 0, "iframes"), marks)


def _most(column: str, n: int, show) -> Column:
    entries = F.transform(F.map_entries(column), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))
    return F.array_join(F.transform(F.slice(F.array_sort(entries), 1, n), show), ", ")


def summary(domain: Column, page_type: Column) -> Column:
    """What a language model would be told of a page: a line for each part that the page has; ties in counts by name."""
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    joined = lambda c: F.array_join(c, ", ")
    return F.concat_ws(
        "\n", F.concat(F.lit("Domain: "), domain), F.concat(F.lit("Page Type: "), page_type), line("Top Tags", _most("tag_counts", 10, lambda e: F.concat(e["k"], F.lit(":"), (-e["n"]).cast("string")))),
        line("Key CSS Classes", _most("css_class_map", 15, lambda e: e["k"])), line("Semantic Landmarks", joined(F.array_sort(F.map_keys("semantic_landmarks")))),
        line("Content Regions", joined(F.transform(F.slice("content_regions", 1, 5), lambda r: F.concat(r["name"], F.lit("("), r["primary_selector"], F.lit(")"))))),
        F.when(F.size("navigation_selectors") > 0, F.concat(F.lit("Navigation Count: "), F.size("navigation_selectors").cast("string"))), line("Iframes", joined(F.transform("iframes", lambda i: i["position"]))),
        line("Scripts", joined(F.slice("script_signatures", 1, 10))), F.when(F.col("pagination").isNotNull(), "Has Pagination: Yes"))


def describe_plainly(domain: Column, page_type: Column) -> Column:
    """One sentence, for where no better description can be had."""
    some = lambda c, before, after="": F.when(F.size(c) > 0, F.concat(F.lit(before), F.array_join(c, ", "), F.lit(after)))
    return F.concat(F.concat_ws(
        " ", F.concat(F.lit("Page on "), domain), F.when(page_type != "unknown", F.concat(F.lit("of type "), page_type)),
        some(F.slice(F.transform("content_regions", lambda r: r["name"]), 1, 3), "with content in "), some(F.slice(F.array_sort(F.map_keys("semantic_landmarks")), 1, 4), "using ", " landmarks")), F.lit("."))


def describe_change(old: Column, new: Column) -> Column:
    """Two descriptions as one text on a change."""
    return F.concat_ws("\n", F.lit("BEFORE:"), old, F.lit("AFTER:"), new)


def frameworks() -> Column:
    """Known frameworks that the page's script signatures name, in fixed order."""
    text = F.lower(F.array_join("script_signatures", " "))
    return F.filter(F.array(*[F.lit(f) for f in KNOWN_FRAMEWORKS]), lambda f: F.contains(text, f))


def to_json(structure: Column) -> Column:
    """A structure as JSON; depths become strings, as JSON has no other keys."""
    return F.to_json(structure)


def from_json(text: Column) -> Column:
    """The structure that `to_json` wrote, depths as numbers again."""
    s = F.from_json(text, SCHEMA.replace("map<int,int>", "map<string,int>"))
    return s.withField("depth_distribution", F.transform_keys(s["depth_distribution"], lambda k, v: k.cast("int")))
