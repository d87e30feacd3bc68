"""Comparisons of structures, their life, descriptions, strategies and baselines, over `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.functions import url as U
from quern.operators import compliance, lifecycle, setjoin, store, strategies, structure
from quern.plans.pages import paired
from quern.plans.urls import PARTS, case
from quern.sources.tables import table


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    """The structures of all pages with their site, type and order."""
    p = table(spark, sf, "pages").select("page_id", U.domain("url").alias("key"), U.classify(F.col("url"), U.PAGE_TYPES, "general").alias("page_type"), U.pattern(F.col("url")).alias("url_pattern"))
    return structure.structures(table(spark, sf, "pages")).join(p, "page_id")


def change_records(spark: SparkSession, sf: str) -> DataFrame:
    """The change records of consecutive pages of a site, one row each."""
    c = structure.change_records(paired(spark, sf))
    r = c.select("page_id", "relearn", structure.has_breaking(F.col("records")).alias("has_breaking"), F.explode("records").alias("r"))
    join = lambda c: F.array_join(c, ",")
    return r.select("page_id", "relearn", "has_breaking", "r.change_type", "r.component", "r.breaking", F.round("r.similarity", 9).alias("similarity"), F.round("r.confidence", 9).alias("confidence"), join(F.col("r.added")).alias("added"), join(F.col("r.removed")).alias("removed"))


def change_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Changes by site, kind and whether they are breaking."""
    c = structure.change_records(paired(spark, sf)).select("key", F.explode("records").alias("r"))
    return c.groupBy("key", "r.change_type", "r.breaking").agg(F.count(F.lit(1)).alias("n"))


def structure_compare(spark: SparkSession, sf: str) -> DataFrame:
    c = structure.compare(paired(spark, sf))
    return c.select("page_id", F.round("similarity", 9).alias("similarity"))


def version_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The inspector's comparison of consecutive pages of a site."""
    c = structure.compare_versions(paired(spark, sf))
    names = ("tags_added", "tags_removed", "classes_added", "classes_removed")
    return c.select("page_id", "same_hash", *[F.round(f"{n}_similarity", 9).alias(f"{n}_similarity") for n in ("tag", "class", "overall")], *[F.array_join(n, ",").alias(n) for n in names])


def life_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each page's structure: matched, adapted, learned, or learned anew after a thousand ids."""
    rows = _keyed(spark, sf).withColumn("fingerprint", structure.fingerprint()).withColumn("seq", F.col("page_id")).withColumn("at", F.col("page_id"))
    return lifecycle.life_cycle(rows, seconds=1000)


def monitor_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The records of a monitor that visits a site's pages as if they were one page in time."""
    return lifecycle.monitor(_keyed(spark, sf).withColumn("hash", structure.monitor_fingerprint()).withColumn("seq", F.col("page_id")))


def page_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Brief and plain descriptions of all pages, and the first lines of their summaries."""
    s = _keyed(spark, sf)
    lines = F.split(structure.summary(F.col("key"), F.col("page_type")), "\n")
    return s.select("page_id", structure.describe_briefly(F.col("page_type")).alias("brief"), structure.describe_plainly(F.col("key"), F.col("page_type")).alias("plain"), F.array_join(F.slice(lines, 1, 2), "|").alias("head"), F.array_join(structure.frameworks(), ",").alias("frameworks"))


def structure_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Structures written as JSON and read again are what they were."""
    s = structure.structures(table(spark, sf, "pages"))
    both = s.select("page_id", structure.to_json(F.struct(*s.columns)).alias("json"))
    return both.select("page_id", (structure.to_json(structure.from_json(F.col("json"))) == F.col("json")).alias("same"))


def signature_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a page's signature differs from that of the page before on its site; landmarks don't count."""
    pairs = paired(spark, sf)
    sig = lambda s: store.signature(F.col(f"{s}.tag_counts"), F.map_keys(f"{s}.css_class_map"), F.col(f"{s}.semantic_landmarks"))
    both = pairs.select("page_id", sig("old").alias("a"), sig("new").alias("b"))
    return both.select("page_id", (~store.same_signature(F.col("a"), F.col("b"))).alias("has_changed"))


def cached_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user's answers the latest, where it isn't older than a day at a fixed time: a cache with expiry."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    rows = e.where(F.col("ts") <= now).groupBy("user_id", "ts").agg(F.max_by("event_type", "event_id").alias("event_type"))
    return compliance.latest_valid(rows, "user_id", "ts", now, 86_400).select("user_id", "event_type")


def unexpired_structures(spark: SparkSession, sf: str) -> DataFrame:
    """Structures saved within the last two minutes of a day of page ids, by site."""
    p = table(spark, sf, "pages").select(U.domain("url").alias("domain"), F.timestamp_seconds("page_id").alias("captured_at"))
    return store.unexpired(p, "captured_at", 120, F.timestamp_seconds(F.lit(240))).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def variant_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Variants (here address patterns) of each site and type, and in all."""
    p = table(spark, sf, "pages").select(U.domain("url").alias("domain"), U.classify(F.col("url"), U.PAGE_TYPES, "general").alias("page_type"), U.pattern(F.col("url")).alias("variant_id"))
    return store.variant_stats(p)


def variant_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The variants of structures that all pages have, by site and type, in numbers."""
    rows = _keyed(spark, sf).withColumnRenamed("key", "domain").withColumn("key", F.concat(F.coalesce("domain", F.lit("")), F.lit("/"), "page_type")).withColumn("fingerprint", structure.fingerprint()).withColumn("seq", F.col("page_id"))
    found = structure.started_variants(rows).select("key", "variant_id").distinct()
    parts = F.split("key", "/")
    return store.variant_totals(found.select(parts[0].alias("domain"), parts[1].alias("page_type"), "variant_id"))


def _strategies(spark: SparkSession) -> DataFrame:
    """Strategies by language of the page: a selector that pages lack with one that they have, and some that always work."""
    rule = lambda p, *f, a=None, c=0.9: (p, list(f), "attribute" if a else "text", a, c)
    rows = [
        ("en", 1, "learned", {"title": rule("h2.old")}), ("en", 2, "learned", {"title": rule(".headline", "h1"), "links": rule("aside a", "nav a"), "content": rule("article")}),
        ("de", 4, "learned", {"title": rule("article h1", c=0.8), "lang": rule("html", a="lang"), "images": rule("img")}),
        ("fr", 1, "learned", {"title": rule("h1", c=1.0), "date": rule("time")}),
    ]
    return spark.createDataFrame(rows, strategies.STRATEGY)


def _by_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("key"), "html")


def strategy_apply(spark: SparkSession, sf: str) -> DataFrame:
    """What the rules give on all pages of a language that has a strategy; texts as hashes."""
    f = strategies.apply(_by_language(spark, sf), _strategies(spark)).select("page_id", F.explode("found").alias("f")).where("f.field <> 'content'")
    return f.select("page_id", "f.field", F.md5("f.value").alias("value_md5"), F.size("f.items").alias("n_items"), F.round("f.confidence", 9).alias("confidence"))


def strategy_adapt(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's strategy, adapted to it."""
    a = strategies.adapted(_by_language(spark, sf), _strategies(spark)).select("page_id", "version", F.explode("rules").alias("field", "rule"))
    return a.select("page_id", "version", "field", "rule.primary", F.round("rule.confidence", 9).alias("confidence"))


def strategy_validate(spark: SparkSession, sf: str) -> DataFrame:
    v = strategies.validated(_by_language(spark, sf), _strategies(spark))
    bad = F.array_sort(F.map_keys(F.map_filter("fields", lambda k, ok: ~ok)))
    return v.select("page_id", "valid", F.array_join(bad, ",").alias("failed"))


def strategy_override(spark: SparkSession, sf: str) -> DataFrame:
    """Each site's strategy (a version for each of its pages, the last one counts: titles, and content where it has an article
    page) after edits by hand: titles of the sites of an even number of pages, authors of those with at least five."""
    p = table(spark, sf, "pages").select("page_id", U.domain("url").alias("key"), F.contains("html", F.lit("<article")).alias("article"))
    rule = lambda sel, c: F.struct(F.lit(sel).alias("primary"), F.array().cast("array<string>").alias("fallbacks"), F.lit("text").alias("method"), F.lit(None).cast("string").alias("attribute"), F.lit(c).alias("confidence"))
    some = F.when(F.col("article"), F.create_map(F.lit("title"), rule("h1", 0.8), F.lit("content"), rule("article", 0.9))).otherwise(F.create_map(F.lit("title"), rule("h1", 0.8)))
    known = p.select("key", F.row_number().over(Window.partitionBy("key").orderBy("page_id")).alias("version"), F.lit("learned").alias("source"), some.alias("rules"))
    size = p.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    edit = lambda field, sel: F.struct(F.lit(field).alias("field"), F.lit(sel).alias("selector"))
    wanted = F.array_compact(F.array(F.when(F.col("n") % 2 == 0, edit("title", "h1.big")), F.when(F.col("n") >= 5, edit("author", ".by"))))
    o = strategies.overridden(known, size.select("key", F.inline(wanted))).select("key", "version", "source", F.explode("rules").alias("field", "rule"))
    return o.select("key", "version", "source", "field", "rule.primary", F.array_join("rule.fallbacks", ",").alias("fallbacks"), F.round("rule.confidence", 9).alias("confidence"))


def structure_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the newest strategy of their language, or without one."""
    p = _by_language(spark, sf).select("page_id", "key")
    j = lifecycle.with_strategy(p, _strategies(spark), ["key"])
    return j.select("page_id", "key", F.col("strategy.version").alias("version"), F.size(F.map_keys("strategy.rules")).alias("n_rules"))


def _baseline_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("domain"), F.when(F.col("vec_id") % 3 == 0, "article").otherwise("listing").alias("page_type"), "vec_id", "embedding")


def baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Baselines after two rounds of saving, where the later one counts, and the removal of those of one site."""
    b = _baseline_rows(spark, sf)
    first = store.save_baselines(None, b.where("vec_id % 2 = 0"), "vec_id")
    second = store.save_baselines(first, b.where("vec_id % 2 = 1"), "vec_id")
    gone = spark.createDataFrame([("3",)], "domain string")
    return store.delete(second, gone, ["domain"]).select("domain", "page_type", "vec_id")


def baseline_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against the baseline of its site and type; a vector without one is an error."""
    b = _baseline_rows(spark, sf)
    saved = store.save_baselines(None, b.where("domain <> '7'"), "vec_id")
    return store.drift(b, saved, ["domain", "page_type"]).groupBy("domain", "status").agg(F.count(F.lit(1)).alias("n"))


_TAGS = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)', 1), '(?is)<script[^>]*>.*?</script>', '<script>', 'g'), '(?is)<style[^>]*>.*?</style>', '<style>', 'g'), '(?s)<!--.*?-->', '', 'g')"
_SETS = f"""(SELECT page_id, domain, md5(regexp_replace(html, '\\s+', ' ', 'g')) AS hash, list_sort(list_distinct(regexp_extract_all({_TAGS}, '<([a-z][a-z0-9]*)', 1))) AS tags,
    list_sort(list_distinct(regexp_extract_all({_TAGS}, ' class="([^" ]+)"', 1))) AS classes FROM (SELECT page_id, html, {PARTS} FROM pages))"""
_MARKS = "list_filter(tags, lambda t: list_contains(['header','nav','main','article','section','aside','footer','figure','figcaption'], t))"
_PAIRS = f"""(SELECT * FROM (SELECT page_id, domain, hash, tags, classes, {_MARKS} AS marks, lag(page_id) OVER w AS p, lag(tags) OVER w AS tags0, lag(classes) OVER w AS classes0, lag({_MARKS}) OVER w AS marks0, lag(hash) OVER w AS hash0
    FROM {_SETS} WINDOW w AS (PARTITION BY domain ORDER BY page_id)) WHERE p IS NOT NULL)"""


def _jaccard(c: str, empty: str) -> str:
    return f"CASE WHEN len({c}) = 0 AND len({c}0) = 0 THEN {empty} ELSE len(list_intersect({c}, {c}0)) / len(list_distinct(list_concat({c}, {c}0))) END"


def _minus(a: str, b: str) -> str:
    return f"array_to_string(list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x))), ',')"


_LANG = "(SELECT page_id, html, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS key FROM pages)"
_H1 = r"replace(replace(replace(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_TYPE = case(U.PAGE_TYPES, "general", "page_type")
_MULTI = f"""(SELECT page_id, domain, hash, tags, classes, marks, list_ AS l, lag(list_) OVER w AS l0, lag(page_id) OVER w AS p, lag(tags) OVER w AS tags0, lag(classes) OVER w AS classes0, lag(marks) OVER w AS marks0, lag(hash) OVER w AS hash0
    FROM (SELECT *, {_MARKS} AS marks FROM {_SETS}) JOIN (SELECT page_id, regexp_extract_all({_TAGS}, '<([a-z][a-z0-9]*)', 1) AS list_ FROM pages) USING (page_id) WINDOW w AS (PARTITION BY domain ORDER BY page_id))"""
_OVERLAP = """CASE WHEN hash = hash0 OR len(l) + len(l0) = 0 THEN 1.0 ELSE list_sum(list_transform(list_distinct(list_concat(l, l0)), lambda t: least(len(list_filter(l, lambda x: x = t)), len(list_filter(l0, lambda x: x = t)))))
    / list_sum(list_transform(list_distinct(list_concat(l, l0)), lambda t: greatest(len(list_filter(l, lambda x: x = t)), len(list_filter(l0, lambda x: x = t))))) END"""
_ONE = "CASE WHEN list_contains({0}, '{1}') = list_contains({0}0, '{1}') THEN 1.0 ELSE 0.0 END"
_SIMS = f"""(SELECT *, 0.3 * tag + 0.25 * regions + 0.15 * navigation + 0.15 * landmarks + 0.1 * css + 0.05 AS similarity FROM (SELECT page_id, p, domain, tags, tags0, marks, marks0, classes, classes0, {_OVERLAP} AS tag, {_ONE.format('tags', 'article')} AS regions,
    {_ONE.format('tags', 'nav')} AS navigation, {_jaccard('marks', '1.0')} AS landmarks, {_jaccard('classes', '1.0')} AS css FROM {_MULTI} WHERE p IS NOT NULL))"""
_CLASS = "CASE WHEN round(similarity, 9) >= 0.95 THEN 'cosmetic' WHEN round(similarity, 9) >= 0.85 THEN 'minor' WHEN round(similarity, 9) >= 0.7 THEN 'moderate' ELSE 'breaking' END"
_KINDS = (("tag", "structure_reorganized", "tag_hierarchy", "tags"), ("regions", "content_relocated", "content_regions", None), ("navigation", "url_pattern_changed", "navigation", None), ("landmarks", "structure_reorganized", "semantic_landmarks", "marks"), ("css", "class_renamed", "css_classes", "classes"))


def _side(k: str, c: str | None, a: str, b: str) -> str:
    """What one side has and the other lacks, of a component."""
    if c:
        return _minus(f"{c}{a}", f"{c}{b}")
    name = {"regions": "article", "navigation": "nav"}[k]
    return f"CASE WHEN list_contains(tags{a}, '{name}') AND NOT list_contains(tags{b}, '{name}') THEN '{name}' ELSE '' END"


_RECORDS = "(" + " UNION ALL ".join(f"SELECT page_id, domain AS key, round(similarity, 9) < 0.7 AS relearn, '{kind}' AS change_type, '{name}' AS component, {k} AS s, {_side(k, c, '', '0')} AS added, {_side(k, c, '0', '')} AS removed FROM {_SIMS} WHERE {k} < 0.9" for k, kind, name, c in _KINDS) + ")"
def structure_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Of each page, how many have the same tags as often, how many others are alike in them at 0.9, and the best of other tags."""
    shapes = structure.structures(table(spark, sf, "pages")).select("page_id", "tag_counts")
    return setjoin.similar(shapes, "page_id", "tag_counts", 0.9).select("page_id", "copies", "n_similar", F.round("best", 9).alias("best"))


QUERIES = {f.__name__: f for f in (
    structure_similar, change_records, change_counters, structure_compare, version_compare, life_cycle, monitor_changes, page_descriptions, structure_round_trip, signature_changes, cached_responses, unexpired_structures, variant_stats, variant_totals, strategy_apply, strategy_adapt,
    strategy_validate, strategy_override, structure_strategies, baselines, baseline_drift)}
ORACLE_SQL = {
    "structure_similar": f"""WITH t AS (SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all({_TAGS}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL), s AS (SELECT page_id, sum(n) AS n FROM t GROUP BY 1),
      low AS (SELECT a.page_id AS a, b.page_id AS b, sum(least(a.n, b.n)) AS low FROM t a JOIN t b USING (tag) WHERE a.page_id <> b.page_id GROUP BY ALL),
      sim AS (SELECT a, b, low = x.n AND low = y.n AS same, low / (x.n + y.n - low) AS s FROM low JOIN s x ON x.page_id = a JOIN s y ON y.page_id = b)
      SELECT page_id, 1 + count(*) FILTER (same) AS copies, count(*) FILTER (s >= 0.9) AS n_similar, round(max(s) FILTER (NOT same AND s >= 0.9), 9) AS best FROM pages LEFT JOIN sim ON a = page_id GROUP BY 1""",
    "change_detect": f"""SELECT page_id, p AS previous_id, round(similarity, 9) AS similarity, {_CLASS} AS change_class, array_to_string(list_filter([{', '.join(f"CASE WHEN {k} < 0.9 THEN '{k}' END" for k, *_ in _KINDS)}], lambda x: x IS NOT NULL), ',') AS changed FROM {_SIMS}""",
    "change_class_counts": f"SELECT {_CLASS} AS change_class, count(*) AS n FROM {_SIMS} GROUP BY 1",
    "change_records": f"SELECT page_id, relearn, bool_or(s < 0.7) OVER (PARTITION BY page_id) AS has_breaking, change_type, component, s < 0.7 AS breaking, round(s, 9) AS similarity, round(1 - s, 9) AS confidence, added, removed FROM {_RECORDS}",
    "change_counters": f"SELECT key, change_type, s < 0.7 AS breaking, count(*) AS n FROM {_RECORDS} GROUP BY ALL",
    "structure_compare": f"SELECT page_id, round(list_avg(list_filter([{_jaccard('tags', 'NULL')}, {_jaccard('classes', 'NULL')}, {_jaccard('marks', 'NULL')}], lambda x: x IS NOT NULL)), 9) AS similarity FROM {_PAIRS}",
    "version_compare": f"""SELECT page_id, hash = hash0 AS same_hash, round(t, 9) AS tag_similarity, round(c, 9) AS class_similarity, round((t + c) / 2, 9) AS overall_similarity, {_minus('tags', 'tags0')} AS tags_added,
      {_minus('tags0', 'tags')} AS tags_removed, {_minus('classes', 'classes0')} AS classes_added, {_minus('classes0', 'classes')} AS classes_removed FROM (SELECT *, {_jaccard('tags', '1.0')} AS t, {_jaccard('classes', '1.0')} AS c FROM {_PAIRS})""",
    "signature_changes": f"SELECT page_id, NOT (list_sort(l) = list_sort(l0) AND classes = classes0) AS has_changed FROM {_MULTI} WHERE p IS NOT NULL",
    "cached_responses": "SELECT user_id, event_type FROM (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00') WHERE k = 1 AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-30 12:00:00'",
    "unexpired_structures": f"SELECT domain, count(*) AS n FROM (SELECT page_id, {PARTS} FROM pages) WHERE page_id + 120 > 240 GROUP BY 1",
    "structure_round_trip": "SELECT page_id, true AS same FROM pages",
    "page_descriptions": f"""SELECT page_id, concat_ws(' ', 'type:' || page_type, CASE WHEN n > 1000 THEN 'size:large' WHEN n > 200 THEN 'size:medium' ELSE 'size:small' END, CASE WHEN list_contains(tags, 'article') THEN 'has:article' END,
        CASE WHEN list_contains(tags, 'table') THEN 'has:tables' END, CASE WHEN list_contains(tags, 'form') THEN 'has:forms' END, CASE WHEN len(list_filter(list_, lambda t: t = 'nav')) > 2 THEN 'has:complex-nav' END,
        CASE WHEN list_contains(tags, 'iframe') THEN 'has:iframes' END, array_to_string(list_transform(list_sort(marks), lambda m: 'landmark:' || m), ' ')) AS brief,
      concat_ws(' ', 'Page on ' || domain, 'of type ' || page_type, CASE WHEN list_contains(tags, 'article') THEN 'with content in article' WHEN list_contains(tags, 'main') THEN 'with content in main' END,
        'using ' || array_to_string(list_sort(marks)[1:4], ', ') || ' landmarks') || '.' AS plain, concat('Domain: ', domain, '|Page Type: ', page_type) AS head, '' AS frameworks
      FROM (SELECT *, {_MARKS} AS marks, len(list_) AS n FROM (SELECT page_id, domain, {_TYPE}, list_distinct(list_) AS tags, list_ FROM (SELECT page_id, url, {PARTS}, regexp_extract_all({_TAGS}, '<([a-z][a-z0-9]*)', 1) AS list_ FROM pages)))""",
    "variant_stats": f"""SELECT * FROM (SELECT domain, page_type, count(DISTINCT v) AS variants FROM (SELECT domain, {_TYPE}, array_to_string(list_transform(string_split(path, '/'), lambda s:
        CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{{id}}' WHEN regexp_matches(s, '^[\\p{{L}}\\p{{N}}_-]+$') AND contains(s, '-') THEN '{{slug}}' ELSE s END), '/') AS v FROM (SELECT url, {PARTS} FROM pages)) GROUP BY ALL)""",
    "strategy_apply": f"""SELECT page_id, 'title' AS field, md5({_H1}) AS value_md5, 0 AS n_items, CASE key WHEN 'en' THEN 0.81::DOUBLE WHEN 'de' THEN 0.8 ELSE 1.0 END AS confidence FROM {_LANG} WHERE key IN ('en', 'de', 'fr') AND {_H1} <> ''
      UNION ALL SELECT page_id, 'lang', md5(key), 0, 0.9 FROM {_LANG} WHERE key = 'de'
      UNION ALL SELECT page_id, 'links', NULL, n, 0.81 FROM (SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1), '<a href="[^"]+"')) AS n FROM {_LANG} WHERE key = 'en') WHERE n > 0""",
    "strategy_adapt": f"""SELECT page_id, 3 AS version, 'title' AS field, 'article h1' AS primary, 0.68::DOUBLE AS confidence FROM {_LANG} WHERE key = 'en' AND {_H1} <> '' UNION ALL SELECT page_id, 3, 'content', 'article', 0.855 FROM {_LANG} WHERE key = 'en'
      UNION ALL SELECT page_id, 5, 'title', 'article h1', 0.76 FROM {_LANG} WHERE key = 'de' AND {_H1} <> '' UNION ALL SELECT page_id, 5, 'lang', 'html', 0.855 FROM {_LANG} WHERE key = 'de' UNION ALL SELECT page_id, 2, 'title', 'h1', 0.95 FROM {_LANG} WHERE key = 'fr' AND {_H1} <> ''""",
    "strategy_validate": f"SELECT page_id, key = 'en' AS valid, CASE key WHEN 'de' THEN 'images' WHEN 'fr' THEN 'date' ELSE '' END AS failed FROM {_LANG} WHERE key IN ('en', 'de', 'fr')",
    "strategy_override": f"""WITH s AS (SELECT domain AS key, count(*) AS n, arg_max(contains(html, '<article'), page_id) AS article FROM (SELECT page_id, html, {PARTS} FROM pages) GROUP BY 1 HAVING count(*) % 2 = 0 OR count(*) >= 5)
      SELECT key, CAST(n + 1 AS INT) AS version, 'manual' AS source, field, "primary", fallbacks, confidence FROM (SELECT key, n, 'title' AS field, CASE n % 2 WHEN 0 THEN 'h1.big' ELSE 'h1' END AS "primary", CASE n % 2 WHEN 0 THEN 'h1' ELSE '' END AS fallbacks, CASE n % 2 WHEN 0 THEN 1.0::DOUBLE ELSE 0.8 END AS confidence FROM s
        UNION ALL SELECT key, n, 'author', '.by', '', 1.0 FROM s WHERE n >= 5 UNION ALL SELECT key, n, 'content', 'article', '', 0.9 FROM s WHERE article)""",
    "structure_strategies": f"SELECT page_id, key, CASE key WHEN 'en' THEN 2 WHEN 'de' THEN 4 WHEN 'fr' THEN 1 END AS version, CASE key WHEN 'en' THEN 3 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 END AS n_rules FROM {_LANG}",
    "baselines": """SELECT domain, page_type, coalesce(max(vec_id) FILTER (vec_id % 2 = 1), max(vec_id)) AS vec_id FROM (SELECT CAST(label AS VARCHAR) AS domain, CASE WHEN vec_id % 3 = 0 THEN 'article' ELSE 'listing' END AS page_type, vec_id FROM embeddings) WHERE domain <> '3' GROUP BY ALL""",
    "baseline_drift": """WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS domain, CASE WHEN vec_id % 3 = 0 THEN 'article' ELSE 'listing' END AS page_type, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), b AS (SELECT domain, page_type, arg_max(v, vec_id) AS q FROM e WHERE domain <> '7' GROUP BY ALL)
      SELECT domain, CASE WHEN q IS NULL THEN 'error' WHEN round(list_cosine_similarity(v, q), 6) < 0.85 THEN 'drifted' ELSE 'ok' END AS status, count(*) AS n FROM e LEFT JOIN b USING (domain, page_type) GROUP BY ALL""",
}
