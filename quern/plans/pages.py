"""Structure, link, extraction and personal-data queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.functions import tables, url as U
from quern.operators import extract, pii, structure
from quern.plans.urls import PARTS
from quern.sources.tables import table

SIMPLE = tuple(k for k in pii.PATTERNS if k != "name")
#: Body without scripts, styles and comments, as the tag counts see it.
BODY = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), '(?is)<script[^>]*>.*?</script>', '<script>', 'g'), '(?is)<style[^>]*>.*?</style>', '<style>', 'g'), '(?s)<!--.*?-->', '', 'g')"


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Elements by tag over all bodies, as native expressions: the count without the limit of ten levels."""
    body = F.regexp_extract("html", r"(?is)<body[^>]*>(.*)</body>", 1)
    for p, r in ((r"(?is)<script[^>]*>.*?</script>", "<script>"), (r"(?is)<style[^>]*>.*?</style>", "<style>"), (r"(?s)<!--.*?-->", "")):
        body = F.regexp_replace(body, p, r)
    tags = F.explode(F.regexp_extract_all(body, F.lit("<([A-Za-z][A-Za-z0-9]*)"), 1)).alias("tag")
    return table(spark, sf, "pages").select("page_id", tags).groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = structure.structures(table(spark, sf, "pages"))
    return s.select(F.explode("css_class_map").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages"))


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(F.regexp_replace("html", r"\s+", " ")).alias("content_hash"))


def page_structures(spark: SparkSession, sf: str) -> DataFrame:
    return structure.structures(table(spark, sf, "pages")).select("page_id", F.size("tag_counts").alias("n_tags"), F.size("parent_child_pairs").alias("n_pairs"), F.size("content_regions").alias("n_regions"), F.size("navigation_selectors").alias("n_navs"), F.array_join(F.array_sort(F.map_keys("semantic_landmarks")), ",").alias("landmarks"), structure.fingerprint().alias("fingerprint"), structure.describe().alias("description"))


def landmarks(spark: SparkSession, sf: str) -> DataFrame:
    s = structure.structures(table(spark, sf, "pages"))
    return s.select(F.explode("semantic_landmarks").alias("landmark", "selector")).groupBy("landmark").agg(F.count(F.lit(1)).alias("n"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    return extract.page_links(table(spark, sf, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if("is_external").alias("n_external"))


def link_domains(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.follow(extract.page_links(table(spark, sf, "pages")))
    return rows.groupBy(U.domain("norm_url").alias("domain")).agg(F.count_distinct("norm_url").alias("n_urls"))


def paired(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", U.domain("url").alias("key"))
    s = structure.structures(table(spark, sf, "pages"))
    both = p.join(s, "page_id").select("key", "page_id", F.struct(*s.columns).alias("new"))
    order = Window.partitionBy("key").orderBy("page_id")
    return both.withColumn("old", F.lag("new").over(order)).where("old is not null")


def change_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive pages of a domain compared."""
    c = structure.changes(paired(spark, sf))
    return c.select("page_id", F.col("old.page_id").alias("previous_id"), F.round("similarity", 9).alias("similarity"), "change_class", F.array_join("changed", ",").alias("changed"))


def tag_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The tag component of consecutive pages of a domain, over uncapped native tag counts."""
    body = F.regexp_extract("html", r"(?is)<body[^>]*>(.*)</body>", 1)
    tags = F.regexp_extract_all(body, F.lit("<([a-z][a-z0-9]*)"), 1)
    counted = F.transform(F.array_distinct(tags), lambda t: F.struct(t.alias("k"), F.size(F.filter(tags, lambda x: x == t)).alias("v")))
    p = table(spark, sf, "pages").select("page_id", U.domain("url").alias("key"), F.map_from_entries(counted).alias("m"))
    order = Window.partitionBy("key").orderBy("page_id")
    rows = p.withColumn("o", F.lag("m").over(order)).where("o is not null")
    from quern.functions import text as T
    return rows.select("page_id", F.round(T.multiset_overlap(F.col("o"), F.col("m")), 9).alias("similarity"))


def change_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return change_detect(spark, sf).groupBy("change_class").agg(F.count(F.lit(1)).alias("n"))


def variant_assign(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", U.domain("url").alias("key"))
    s = structure.structures(table(spark, sf, "pages"))
    rows = s.join(p, "page_id").withColumn("fingerprint", structure.fingerprint()).withColumn("seq", F.col("page_id"))
    return structure.assign_variants(rows)


def structure_history(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of each domain's pages, the newest ten."""
    p = table(spark, sf, "pages").select("page_id", U.domain("url").alias("domain"))
    up, down = Window.partitionBy("domain").orderBy("page_id"), Window.partitionBy("domain").orderBy(F.desc("page_id"))
    return p.withColumn("version", F.row_number().over(up)).withColumn("age", F.row_number().over(down)).where("age <= 10").select("domain", "version", "page_id")


def strategy_infer(spark: SparkSession, sf: str) -> DataFrame:
    e = extract.extractions(table(spark, sf, "pages"))
    return e.select(F.explode("strategy").alias("field", "rule")).groupBy("field", "rule.selector").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rule.confidence"), 6).alias("confidence"))


def extract_content(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extractions(table(spark, sf, "pages")).select("page_id", "success", "title", F.length("content").alias("n_content"), F.md5("content").alias("content_md5"), "date", F.round("confidence", 6).alias("confidence"))


def extraction_validity(spark: SparkSession, sf: str) -> DataFrame:
    return extract.validity(extract.extractions(table(spark, sf, "pages"))).groupBy("success", "valid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pii.counts(table(spark, sf, "documents"), kinds=SIMPLE)


def pii_matches(spark: SparkSession, sf: str) -> DataFrame:
    return pii.matches(table(spark, sf, "documents"))


def pii_strong(spark: SparkSession, sf: str) -> DataFrame:
    """E-mail, card and IP matches that pass their rules, with confidence."""
    m = pii.matches(table(spark, sf, "documents"), kinds=("email", "credit_card", "ip_address"))
    return m.groupBy("doc_id", "pii_type").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.min("value").alias("first_value"))


def pii_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """The matches of `pii_matches`, by the table function in SQL."""
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, m.* FROM {docs} d, LATERAL quern_pii(d.text) m", docs=table(spark, sf, "documents"))


def links_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """Links of each page by kind, by the table function in SQL."""
    tables.register(spark)
    return spark.sql(
        "SELECT p.page_id, l.link_type, count(*) AS n, count_if(l.is_external) AS n_external FROM {pages} p, LATERAL quern_links(p.url, p.html) l GROUP BY ALL", pages=table(spark, sf, "pages"))


def page_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and contents by the page function, in SQL."""
    tables.register(spark)
    return spark.sql("SELECT p.page_id, x.success, md5(x.title) AS title_md5, md5(x.content) AS content_md5 FROM {pages} p, LATERAL quern_page(p.url, p.html) x", pages=table(spark, sf, "pages"))


def pii_redact(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without what any of the fourteen kinds finds; overlapping matches are replaced one after another."""
    d = pii.processed(table(spark, sf, "documents"), "redact", alert_on_sensitive=False)
    return d.select("doc_id", "n_matches", F.md5("text").alias("text_md5"))


def pii_pseudonymize(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return pii.processed(turns, "pseudonymize", key="turn_id", salt="a salt for tests").select("turn_id", "n_matches", F.md5("text").alias("text_md5"))


def pii_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return pii.processed(table(spark, sf, "documents"), "redact").where("excluded").select("doc_id", F.array_join("categories", ",").alias("categories"))


EMAIL = pii.PATTERNS["email"][0]
LUHN = "(list_sum(list_transform(string_split(v, ''), lambda c, i: CASE WHEN i % 2 = 0 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"


def _count(k: str) -> str:
    p = (("(?i)" if pii.PATTERNS[k][1] else "") + pii.PATTERNS[k][0]).replace("'", "''")
    return f"len(regexp_extract_all(text, '{p}')) AS {k}"


# The rules of `pii.RULES` and the windows of `pii.detect` in SQL, over a match `value` at `s` to `e` of `text`, its digits `v`.
_AROUND = "lower(substr(text, greatest(s - %d, 0) + 1, least(s, %d) + (e - s) + %d))"
_BEFORE = "lower(substr(text, greatest(s - 20, 0) + 1, least(s, 20)))"
_RULES = {
    "phone": r"length(v) >= 7 AND NOT regexp_full_match(value, '\d{4}[-/]\d{2}[-/]\d{2}|\d+\.\d+\.\d+')",
    "ip_address": rf"list_max(list_transform(string_split(value, '.'), lambda x: CAST(x AS INT))) < 256 AND NOT regexp_matches({_BEFORE}, 'version|v\d|\.jar|\.dll')",
    "ssn": "length(v) = 9 AND left(v, 3) NOT IN ('000', '666') AND left(v, 1) <> '9'", "credit_card": LUHN, "address": "length(value) >= 15",
    "name": f"value NOT IN ({', '.join(repr(p) for p in sorted(pii.PLACES))})",
    "driver_license": f"regexp_matches({_AROUND % (50, 50, 50)}, 'license|driver')", "passport": f"contains({_AROUND % (50, 50, 50)}, 'passport')",
}
#: RE2's \b knows ASCII only, so other letters stand as _ where matches are looked for; values come from the text itself.
_FLAT = "regexp_replace(text, '[ªµºÀ-ÖØ-öø-ʯͰ-ͳͶ-ϿЀ-ҁҊ-ԯ]', '_', 'g')"


def _found(kind: str, source: str) -> str:
    """SQL for the matches of a kind in `source` (id, text, t): what lies between them gives their places."""
    p = (("(?i)" if pii.PATTERNS[kind][1] else "") + pii.PATTERNS[kind][0]).replace("'", "''")
    base, words, number = pii.PATTERNS[kind][2], pii.PATTERNS[kind][3], list(pii.PATTERNS).index(kind)
    near = " OR ".join(f"contains({_AROUND % (30, 30, 30)}, '{w}')" for w in words) or "false"
    category = f"'{pii.SENSITIVE[kind]}'" if kind in pii.SENSITIVE else "CAST(NULL AS VARCHAR)"
    return f"""SELECT id, {number} AS k, '{kind}' AS pii_type, value, s, e, CAST(CASE WHEN {near} THEN {min(1.0, round(base + 0.15, 6))} ELSE {base} END AS DOUBLE) AS confidence, {category} AS category FROM (
      SELECT id, text, s, s + length(m) AS e, substr(text, s + 1, length(m)) AS value, regexp_replace(m, '[^0-9]', '', 'g') AS v FROM (
        SELECT id, text, m, CAST(sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (
          SELECT id, text, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(string_split_regex(t, '{p}')) AS gap, unnest(range(len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM {source}) WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE m IS NOT NULL)
      WHERE {_RULES.get(kind, 'true')}"""


def _matches(table_: str, key: str, kinds: tuple[str, ...] = tuple(pii.PATTERNS)) -> str:
    """SQL for common tables `d` (id, text, t) and `f`, the matches of `kinds` in it."""
    return f"d AS (SELECT {key} AS id, text, {_FLAT} AS t FROM {table_}), f AS ({' UNION ALL '.join(_found(k, 'd') for k in kinds)})"


def _replaced(mark: str) -> str:
    """SQL for the texts of `d` with every match of `f` replaced by `mark`, from the right."""
    return f"""(SELECT id, coalesce(n, 0) AS n_matches, CASE WHEN n IS NULL THEN text ELSE struct_extract(list_reduce(ms, lambda a, x: {{t: substr(a.t, 1, x.s) || x.t || substr(a.t, x.e + 1), s: x.s, e: x.e}}, {{t: text, s: 0::BIGINT, e: 0::BIGINT}}), 't') END AS new
      FROM d LEFT JOIN (SELECT id, count(*) AS n, list({{t: {mark}, s: s, e: e}} ORDER BY s DESC, e DESC, k) AS ms FROM f GROUP BY 1) USING (id))"""


# Texts of elements of the test pages, and what the extractor's default selectors choose on them.
def _text(x: str) -> str:
    x = f"regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')"
    for name, char in (("nbsp", " "), ("copy", "©"), ("middot", "·"), ("quot", '"'), ("#39", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_EXTRACTED = f"""(SELECT *, title <> '' AND content IS NOT NULL AS success, ((CASE WHEN title <> '' THEN 0.85 ELSE 0 END) + coalesce(sure, 0)) / ((title <> '')::INT + (sure IS NOT NULL)::INT) AS confidence FROM (
  SELECT page_id, title, CASE WHEN length(art) >= 100 THEN art WHEN length(body) >= 100 THEN body END AS content, CASE WHEN length(art) >= 100 THEN 'article' WHEN length(body) >= 100 THEN 'body' END AS sel, CASE WHEN length(art) >= 100 THEN 0.9 WHEN length(body) >= 100 THEN 0.75 END AS sure FROM (
    SELECT page_id, {_text("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, {_text("regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)")} AS art, {_text("regexp_extract(html, '(?is)<body[^>]*>(.*)', 1)")} AS body FROM pages)))"""
_PII_MATCHES = f"""WITH {_matches('documents', 'doc_id')} SELECT id AS doc_id, pii_type, value, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", confidence, category FROM f"""
_LAG = "SELECT page_id, regexp_extract_all(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), '<([a-z][a-z0-9]*)', 1) AS t, domain, lag(page_id) OVER (PARTITION BY domain ORDER BY page_id) AS prev FROM (SELECT page_id, html, %s FROM pages)" % PARTS
QUERIES = {f.__name__: f for f in (
    tag_counts, class_counts, content_hash, page_structures, landmarks, links, link_domains, change_detect, tag_similarity, change_class_counts, variant_assign, structure_history,
    strategy_infer, extract_content, extraction_validity, pii_counts, pii_matches, pii_lateral, links_lateral, page_lateral, pii_strong, pii_redact, pii_pseudonymize, pii_excluded)}
ORACLE_SQL = {
    "tag_counts": f"SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, lower(unnest(regexp_extract_all({BODY}, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages) GROUP BY 1",
    "class_counts": "SELECT class, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[a-z][^>]* class=\"([^\" ]+)\"', 1)) AS class FROM pages) GROUP BY 1",
    "content_hash": r"SELECT page_id, md5(regexp_replace(html, '\s+', ' ', 'g')) AS content_hash FROM pages",
    "landmarks": "SELECT t AS landmark, count(*) AS n FROM pages, (SELECT unnest(['header','nav','main','article','section','aside','footer','figure','figcaption']) AS t) WHERE regexp_matches(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), concat('<', t, '[ >]')) GROUP BY 1",
    "structure_history": f"SELECT domain, version, page_id FROM (SELECT domain, page_id, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS version, row_number() OVER (PARTITION BY domain ORDER BY page_id DESC) AS age FROM (SELECT page_id, {PARTS} FROM pages)) WHERE age <= 10",
    "tag_similarity": f"""WITH p AS ({_LAG}), c AS (SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(t) AS tag FROM p) GROUP BY ALL),
      j AS (SELECT p.page_id, coalesce(a.tag, b.tag) AS tag, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM p JOIN (SELECT page_id AS id, * EXCLUDE page_id FROM c) a ON a.id = p.page_id LEFT JOIN c b ON b.page_id = p.prev AND b.tag = a.tag WHERE p.prev IS NOT NULL
        UNION ALL SELECT p.page_id, b.tag, 0, b.n FROM p JOIN c b ON b.page_id = p.prev WHERE NOT EXISTS (SELECT 1 FROM c a WHERE a.page_id = p.page_id AND a.tag = b.tag))
      SELECT p.page_id, coalesce(s.similarity, 1.0) AS similarity FROM p LEFT JOIN (SELECT page_id, round(sum(least(x, y)) / sum(greatest(x, y)), 9) AS similarity FROM j GROUP BY 1) s USING (page_id) WHERE p.prev IS NOT NULL""",
    "links": "SELECT page_id, count(DISTINCT h) AS n_links, count(DISTINCT h) FILTER (regexp_matches(h, '^https?://')) AS n_external FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"#]+)\"', 1)) AS h FROM pages) GROUP BY 1",
    "pii_counts": f"SELECT doc_id, {', '.join(_count(k) for k in SIMPLE)} FROM documents",
    "extract_content": f"SELECT page_id, success, title, length(content) AS n_content, md5(content) AS content_md5, CAST(NULL AS VARCHAR) AS date, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM {_EXTRACTED}",
    "strategy_infer": f"SELECT field, selector, count(*) AS n, round(avg(c), 6) AS confidence FROM (SELECT 'title' AS field, 'article h1' AS selector, 0.85::DOUBLE AS c FROM {_EXTRACTED} WHERE title <> '' UNION ALL SELECT 'content', sel, CAST(sure AS DOUBLE) FROM {_EXTRACTED} WHERE sel IS NOT NULL) GROUP BY ALL",
    "extraction_validity": f"SELECT success, success AND length(title) >= 5 AND length(content) >= 100 AND confidence >= 0.5 AS valid, count(*) AS n, round(avg(CAST(confidence AS DOUBLE)), 6) AS confidence FROM {_EXTRACTED} GROUP BY ALL",
    "page_lateral": f"SELECT page_id, success, md5(title) AS title_md5, md5(content) AS content_md5 FROM {_EXTRACTED}",
    "pii_matches": _PII_MATCHES,
    "pii_lateral": _PII_MATCHES,
    "links_lateral": "SELECT page_id, 'anchor' AS link_type, count(DISTINCT h) AS n, count(DISTINCT h) FILTER (regexp_matches(h, '^https?://')) AS n_external FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"#]+)\"', 1)) AS h FROM pages) GROUP BY 1",
    "pii_strong": f"WITH {_matches('documents', 'doc_id', ('email', 'credit_card', 'ip_address'))} SELECT id AS doc_id, pii_type, count(*) AS n, max(confidence) AS confidence, min(value) AS first_value FROM f GROUP BY ALL",
    "pii_redact": f"WITH {_matches('documents', 'doc_id')} SELECT id AS doc_id, n_matches, md5(new) AS text_md5 FROM {_replaced("'[REDACTED:' || pii_type || ']'")}",
    "pii_pseudonymize": f"WITH {_matches('conversations', 'conv_id * 1000 + turn')} SELECT id AS turn_id, n_matches, md5(new) AS text_md5 FROM {_replaced("'[' || pii_type || ':' || left(sha256('a salt for tests:' || pii_type || ':' || value), 8) || ']'")}",
    "pii_excluded": f"WITH {_matches('documents', 'doc_id')} SELECT id AS doc_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM f WHERE category IS NOT NULL GROUP BY 1",
}
