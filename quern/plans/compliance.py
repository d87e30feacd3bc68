"""Compliance queries over `pages` with inline rule tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import url as U
from quern.operators import compliance as C
from quern.plans.urls import PARTS
from quern.sources.tables import table

#: Robots files of the example hosts, by the last label of the domain.
FILES = [
    ("com", "User-agent: *\nDisallow: /fr/\nAllow: /fr/1\nCrawl-delay: 2\nDisallow: /*7$\n\nUser-agent: quern\nDisallow: /en/\nAllow: /en/2\nSitemap: https://example.com/s.xml", 200),
    ("net", "User-agent: *\nDisallow: /es # none\nAllow: /es/4\n\nUser-agent: other\nDisallow: /", 200),
    ("org", "", 503),
]


def _robots(spark: SparkSession) -> DataFrame:
    return C.robots(spark.createDataFrame(FILES, "domain string, content string, status int"))


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.substring_index(U.domain("url"), ".", -1).alias("domain"), U.path("url").alias("path"))


def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    out = C.allowed(_urls(spark, sf), C.agent_rules(_robots(spark), "quernbot/1.0"))
    return out.select(F.col("key").alias("page_id"), "allowed")


def robots_allowed_other(spark: SparkSession, sf: str) -> DataFrame:
    """For an agent without a group of its own."""
    out = C.allowed(_urls(spark, sf), C.agent_rules(_robots(spark), "someone"))
    return out.select(F.col("key").alias("page_id"), "allowed")


def _site_robots(spark: SparkSession, sf: str) -> DataFrame:
    """A robots file for each site of `pages`: its addresses' first parts disallowed, a delay of as many seconds as it has pages,
    and a sitemap for each of its languages."""
    p = table(spark, sf, "pages").select("page_id", U.domain("url").alias("domain"), F.concat(F.lit("/"), F.split_part(U.path("url"), F.lit("/"), F.lit(2))).alias("part"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))
    lines = lambda c, form: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: F.format_string(form, x)), "\n")
    site = p.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), lines("part", "Disallow: %s").alias("rules"), lines("lang", "Sitemap: https://maps.example.com/%s.xml").alias("maps"))
    content = F.concat_ws("\n", F.lit("User-agent: *"), F.format_string("Crawl-delay: %d", "n"), "rules", F.lit("User-agent: other"), F.lit("Disallow: /"), "maps")
    return C.robots(site.select("domain", content.alias("content"), F.lit(200).alias("status")))


def robots_delays(spark: SparkSession, sf: str) -> DataFrame:
    """Delay, rules and sitemaps of each site's robots file."""
    parsed = _site_robots(spark, sf)
    rules = C.agent_rules(parsed, "someone").groupBy("domain").agg(F.max("crawl_delay").alias("crawl_delay"), F.count("pattern").alias("n_rules"))
    return rules.join(parsed.select("domain", F.size("sitemaps").alias("n_sitemaps")), "domain")


RULES_OWN = "(VALUES ('com', 8, '/en/', false, '^/en/'), ('com', 9, '/en/2', true, '^/en/2'), ('net', 2, '/es', false, '^/es'), ('net', 3, '/es/4', true, '^/es/4'), ('org', 0, '/', false, '^/')) r(domain, line_no, pattern, allow, regex)"
RULES_STAR = "(VALUES ('com', 2, '/fr/', false, '^/fr/'), ('com', 3, '/fr/1', true, '^/fr/1'), ('com', 5, '/*7$', false, '^/.*7$'), ('net', 2, '/es', false, '^/es'), ('net', 3, '/es/4', true, '^/es/4'), ('org', 0, '/', false, '^/')) r(domain, line_no, pattern, allow, regex)"


def _allowed(rules: str) -> str:
    return f"""SELECT page_id, coalesce(allow, true) AS allowed FROM (SELECT p.page_id, r.allow, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.pattern) DESC NULLS LAST, line_no) AS k
      FROM (SELECT page_id, string_split(domain, '.')[-1] AS tld, path FROM (SELECT page_id, {PARTS} FROM pages)) p LEFT JOIN {rules} ON r.domain = p.tld AND regexp_matches(p.path, r.regex)) WHERE k = 1"""


def decided(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("key"), "url", U.domain("url").alias("domain"))
    block = spark.createDataFrame([("www.example.com",), (" EXAMPLE.org ",)], "domain string")
    ok = robots_allowed(spark, sf).withColumnRenamed("page_id", "key")
    rows = C.blocked_domain(pages, block).join(ok, "key")
    basis = C.authorization(
        F.col("blocked"), F.col("domain").startswith("blog."), F.col("url").contains("ref="), F.col("allowed"), F.col("domain").contains("th."), F.col("domain").startswith("m."))
    return rows.withColumn("basis", basis)


def authorization(spark: SparkSession, sf: str) -> DataFrame:
    return decided(spark, sf).select(F.col("key").alias("page_id"), "basis", F.col("basis").isin("explicit_permission", "public_access").alias("authorized"))


def fetch_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = decided(spark, sf)
    return rows.groupBy(C.gate(U.is_private("url"), F.col("basis"), F.col("allowed")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


AUTH = f"""SELECT page_id, allowed, CASE WHEN domain = 'www.example.com' OR domain LIKE '%.www.example.com' OR domain = 'example.org' OR domain LIKE '%.example.org' THEN 'blocklist'
  WHEN domain LIKE 'blog.%' THEN 'explicit_permission' WHEN contains(url, 'ref=') THEN 'authentication_required' WHEN NOT allowed THEN 'robots_txt'
  WHEN contains(domain, 'th.') THEN 'cease_desist' WHEN domain LIKE 'm.%' THEN 'terms_of_service' ELSE 'public_access' END AS basis
FROM (SELECT page_id, url, {PARTS} FROM pages) JOIN ({_allowed(RULES_OWN)}) USING (page_id)"""


def terms_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The rules for terms of service, run over the documents (their prose has chance matches)."""
    restrictions, concerns, advice = C.terms(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(restrictions, ",").alias("restrictions"), F.array_join(concerns, ",").alias("concerns"), advice.alias("recommendation"))


def _found(rules: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{n}' END" for p, n in rules) + "], lambda x: x IS NOT NULL), ',')"


TERMS = f"""SELECT doc_id, {_found(C.PROHIBITIONS)} AS restrictions, {_found(C.CONCERNS)} AS concerns,
  CASE WHEN {_found(C.PROHIBITIONS)} <> '' THEN 'block' ELSE 'proceed_with_caution' END AS recommendation FROM documents"""


def js_required(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.coalesce(C.needs_scripts(F.col("html")), F.lit("none")).alias("reason"), F.length(C.visible_text(F.col("html"))).alias("n_visible"))


def _alt(signs: list[str]) -> str:
    return "|".join(re.escape(s.lower()) for s in signs).replace("'", "''").replace("\\\n", "\\n")


VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
JS = f"""SELECT page_id, CASE WHEN regexp_matches(lower(html), '{_alt(C.FRAMEWORKS)}') THEN 'framework' WHEN regexp_matches(lower(html), '{_alt(C.MINIMAL)}') THEN 'minimal'
  WHEN len(regexp_extract_all(lower(html), '<script')) >= 5 AND length({VISIBLE}) < 500 THEN 'script_heavy'
  WHEN regexp_matches(lower(array_to_string(regexp_extract_all(html, '(?is)<noscript[^>]*>(.*?)</noscript>', 1), ' ')), '{C.NOSCRIPT}') THEN 'noscript' ELSE 'none' END AS reason,
  length({VISIBLE}) AS n_visible FROM pages"""


def fetch_route(spark: SparkSession, sf: str) -> DataFrame:
    r = C.route(F.col("url"), F.lit(200), F.col("html"), "[.]org", "/en/1")
    return table(spark, sf, "pages").select("page_id", r.alias("source"), F.lower("html").rlike("captcha|verify you are human|access denied|unusual traffic|cf-challenge|are you a robot").alias("captcha"))


ROUTE = f"""SELECT page_id, CASE WHEN regexp_matches(url, '[.]org') THEN 'http' WHEN regexp_matches(url, '/en/1') THEN 'render' WHEN reason <> 'none' THEN 'render' ELSE 'http' END AS source,
  regexp_matches(lower(html), 'captcha|verify you are human|access denied|unusual traffic|cf-challenge|are you a robot') AS captcha FROM pages JOIN ({JS}) USING (page_id)"""

QUERIES = {f.__name__: f for f in (robots_allowed, robots_allowed_other, robots_delays, authorization, fetch_gate, terms_analysis, js_required, fetch_route)}
ORACLE_SQL = {
    "robots_allowed": _allowed(RULES_OWN), "robots_allowed_other": _allowed(RULES_STAR),
    "robots_delays": f"""SELECT domain, CAST(count(*) AS DOUBLE) AS crawl_delay, count(DISTINCT string_split(path, '/')[2]) AS n_rules, count(DISTINCT regexp_extract(html, '<html lang="([a-z]+)"', 1)) AS n_sitemaps
      FROM (SELECT html, {PARTS} FROM pages) GROUP BY 1""",
    "authorization": f"SELECT page_id, basis, basis IN ('explicit_permission', 'public_access') AS authorized FROM ({AUTH})",
    "fetch_gate": f"SELECT CASE WHEN basis NOT IN ('explicit_permission', 'public_access') THEN 'blocked_legal' WHEN NOT allowed THEN 'blocked_robots' ELSE 'success' END AS status, count(*) AS n FROM ({AUTH}) GROUP BY 1",
    "terms_analysis": TERMS, "js_required": JS, "fetch_route": ROUTE,
}
