"""URL queries over `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.functions import url as U
from quern.sources.tables import table

URL = "url"
S = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
#: Parts of an address in DuckDB, over a relation with `url`.
PARTS = f"""lower(regexp_extract(url, {S}, 1)) AS scheme, lower(regexp_extract(url, {S}, 2)) AS domain,
  CASE WHEN regexp_replace(regexp_extract(url, {S}, 3), ';[^/]*$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, {S}, 3), ';[^/]*$', '') END AS path,
  regexp_extract(url, {S}, 4) AS query"""


def case(rules: U.Rules, default: str, name: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{label}'" for label, p in rules) + f" ELSE '{default}' END AS {name}"


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", U.domain(URL).alias("domain"), U.scheme(URL).alias("scheme"), U.path(URL).alias("path"), U.depth(URL).alias("depth"),
        U.is_valid(URL).alias("valid"), U.is_resource(URL).alias("resource"), U.base_domain(URL).alias("base"), U.is_private(URL).alias("private"))


URL_PARTS = f"""SELECT page_id, domain, scheme, path, len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth,
  scheme IN ('http', 'https') AND domain <> '' AS valid, regexp_matches(lower(path), '[.]({'|'.join(U.RESOURCES)})$') AS resource,
  array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') AS base,
  regexp_matches(domain, '^(localhost|10[.]|127[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])') AS private
FROM (SELECT page_id, {PARTS} FROM pages)"""


def url_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(U.pattern(URL).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


URL_PATTERN = f"""SELECT pattern, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, array_to_string(list_transform(string_split(path, '/'), lambda s:
  CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{{id}}' WHEN regexp_matches(lower(s), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN '{{uuid}}'
  WHEN regexp_matches(s, '^[\\p{{L}}\\p{{N}}_-]+$') AND contains(s, '-') THEN '{{slug}}' ELSE s END), '/') AS pattern FROM (SELECT page_id, {PARTS} FROM pages)) GROUP BY pattern"""


def page_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", U.classify(URL, U.PAGE_TYPES, "general").alias("page_type"), U.classify(URL, U.NEWS_TYPES, "homepage").alias("news_type"),
        U.classify(URL, [*U.NEWS_TYPES[:8], ("sports", "/sports|/sport"), *U.NEWS_TYPES[8:]], "homepage").alias("news_ml_type"),
        U.classify(URL, U.SPORTS_TYPES, "homepage").alias("sports_type"), U.classify(URL, U.SITEMAP_TYPES, "content").alias("sitemap_type"))


PAGE_TYPES = f"""SELECT page_id, {case(U.PAGE_TYPES, 'general', 'page_type')}, {case(U.NEWS_TYPES, 'homepage', 'news_type')},
  {case([*U.NEWS_TYPES[:8], ("sports", "/sports|/sport"), *U.NEWS_TYPES[8:]], 'homepage', 'news_ml_type')},
  {case(U.SPORTS_TYPES, 'homepage', 'sports_type')}, {case(U.SITEMAP_TYPES, 'content', 'sitemap_type')} FROM pages"""


def _normal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.domain(URL).alias("domain"), U.normalize(URL).alias("norm_url"))


NORMAL = f"""SELECT page_id, domain, concat(scheme, '://', CASE scheme WHEN 'http' THEN regexp_replace(domain, ':80$', '') WHEN 'https' THEN regexp_replace(domain, ':443$', '') ELSE domain END,
  regexp_replace(path, '/+', '/', 'g'), CASE WHEN q <> '' THEN concat('?', q) ELSE '' END) AS norm_url
FROM (SELECT *, coalesce(array_to_string(list_transform(list_sort(list_transform(list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''),
  lambda x: {{'k': url_decode(replace(string_split(x, '=')[1], '+', ' ')), 'v': url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, strpos(x, '=') + 1) ELSE '' END, '+', ' '))}}),
  lambda x: NOT list_contains({list(U.TRACKING)!r}, lower(x.k)) AND NOT regexp_matches(lower(x.k), '^({'|'.join(U.SESSION)})')),
  lambda x, i: {{'k': x.k, 'i': i, 'x': replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')}})), lambda e: e.x), '&'), '') AS q FROM (SELECT page_id, {PARTS} FROM pages))"""


def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _normal(spark, sf)


def url_normalize_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of each normalized address, then the three best addresses of each domain."""
    first = _normal(spark, sf).groupBy("domain", "norm_url").agg(F.min("page_id").alias("page_id"))
    order = Window.partitionBy("domain").orderBy(U.depth(F.col("norm_url")), "norm_url")
    return first.withColumn("rank", F.row_number().over(order)).where("rank <= 3")


DEDUP = f"""SELECT * FROM (SELECT domain, norm_url, page_id, row_number() OVER (PARTITION BY domain ORDER BY
  len(list_filter(string_split(regexp_extract(norm_url, {S}, 3), '/'), lambda s: s <> '')), norm_url) AS rank
  FROM (SELECT domain, norm_url, min(page_id) AS page_id FROM ({NORMAL}) GROUP BY ALL)) WHERE rank <= 3"""


def url_depth_hist(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(U.depth(URL).alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(U.domain(URL)).alias("domains"))


DEPTH = f"""SELECT len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth, count(*) AS n, count(DISTINCT domain) AS domains FROM (SELECT page_id, {PARTS} FROM pages) GROUP BY 1"""


def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", F.md5(URL).alias("url_key"), F.substring(F.md5(URL), 1, 12).alias("target_hash"), U.file_name(URL).alias("file_name"),
        F.size(U.terms_urls(URL)).alias("n_terms"), F.element_at(U.terms_urls(URL), 3).alias("tos_url"))


URL_KEYS = f"""SELECT page_id, md5(url) AS url_key, substr(md5(url), 1, 12) AS target_hash, concat(substr(regexp_replace(CASE WHEN l = '' THEN 'index' ELSE l END, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), 1, 50), '_', substr(md5(url), 1, 12)) AS file_name,
  6 AS n_terms, concat(lower(regexp_extract(url, {S}, 1)), '://', regexp_extract(url, {S}, 2), '/tos') AS tos_url
FROM (SELECT page_id, url, string_split(rtrim(path, '/'), '/')[-1] AS l FROM (SELECT page_id, url, {PARTS} FROM pages))"""


def url_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Pattern matching, article-like and category-like addresses, substring search."""
    return table(spark, sf, "pages").select(
        "page_id", U.matches(URL, ["/*/{n}", "/en/**", "/[bad"]).alias("matches"), U.is_article(URL).alias("article_like"),
        U.is_news_category(URL).alias("category_like"), F.lower(URL).contains("example.net").alias("found"),
        U.same_domain(URL, F.lit("http://www.example.com/"), True).alias("same_base"))


URL_PREDICATES = f"""SELECT page_id, regexp_matches(path, '^/[^/]+/[^/]+$') OR regexp_matches(path, '^/en/.*$') AS matches,
  (regexp_matches(p, '[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}') OR regexp_matches(p, '[0-9]{{5,}}') OR length(p) - length(replace(p, '-', '')) >= 2) AND contains(p, '/') AND NOT regexp_matches(raw, '/page/[0-9]+/?$') AS article_like,
  regexp_matches(p, '^[A-Za-z]{{1,20}}$') AND p NOT IN ('video','videos','live','watch','listen','account','login','signup','subscribe','search','about','contact','privacy','terms','jobs','careers','press','newsletters','weather') AS category_like,
  contains(lower(url), 'example.net') AS found, array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') = 'example.com' AS same_base
FROM (SELECT page_id, url, {PARTS}, regexp_extract(url, {S}, 3) AS raw, trim(regexp_extract(url, {S}, 3), '/') AS p FROM pages)"""

def url_form_values(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses that carry what people wrote, escaped in one of three ways, back in one form."""
    t = table(spark, sf, "conversations")
    raw = F.regexp_replace("text", r"[\x00-\x1f]", " ")
    by_plus, by_hex = U.escape(raw), F.replace(U.escape(raw), F.lit("+"), F.lit("%20"))
    written = F.when(F.col("turn") % 3 == 0, by_plus).when(F.col("turn") % 3 == 1, by_hex).otherwise(F.regexp_replace(by_hex, "%2[cC]", ","))
    url = F.concat(F.lit("HTTP://Www.Example.com:80//s;v=1?q="), written, F.lit("&utm%5Fsource=mail&b=&a=1&a=0&SID9=x#top"))
    return t.select("conv_id", "turn", U.normalize(url).alias("norm_url"))


def resolved_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links in several relative forms on every page, made absolute."""
    forms = F.explode(F.array(*[F.lit(x) for x in ("/a/b", "?x=1", "//cdn.example.org/c.js", "https://other.example.org/", "#part")])).alias("link")
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), forms)
    return p.select("page_id", "link", U.resolve(F.col("url"), F.col("link")).alias("resolved"))


def article_links(spark: SparkSession, sf: str) -> DataFrame:
    """The five addresses of each site that look most like articles: longest paths of digits or hyphens first."""
    p = table(spark, sf, "pages").where(U.part(URL, 3).rlike("[0-9]{3}")).select("page_id", U.domain(URL).alias("domain"), (U.hyphens(URL)).alias("hyphens"), URL)
    order = Window.partitionBy("domain").orderBy(F.desc("hyphens"), URL, "page_id")
    return p.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("domain", "rank", "page_id")


#: Names of sections that sites use, and the general ones they stand for.
SECTIONS = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "EN": "never"}


def section_names(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by the general name of their first path segment; segments that the dictionary lacks are left out."""
    p = table(spark, sf, "pages").select(F.regexp_extract(U.path(URL), "^/([^/]*)", 1).alias("section"))
    return U.same_category(p, "section", SECTIONS).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_SECTION_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in SECTIONS.items())
FORMS = r"""SELECT conv_id, turn, concat('http://www.example.com/s?a=1&a=0&b=&q=', replace(url_encode(regexp_replace(text, '[\x00-\x1f]', ' ', 'g')), '%20', '+')) AS norm_url FROM conversations"""
#: Leading digits of the addresses below: inside and beside the ranges that are set aside.
_LEADS = ("", "fe80", "fec0", "febf", "fc", "fd00", "ff02", "20010db8", "20010db9", "2001002", "200101", "200102", "2002", "3fff0", "3fff1", "2", "3", "0" * 20 + "ffff", "0" * 31, "0064ff9b", "4", "200100040112", "200100040113")


def private_ipv6(spark: SparkSession, sf: str) -> DataFrame:
    """IPv6 addresses made from all events, written in full, shortened, or with port and zone, and whether they are private."""
    k = F.col("event_id")
    lead = F.element_at(F.array(*[F.lit(x) for x in _LEADS]), (k % len(_LEADS) + 1).cast("int"))
    digits = F.concat(lead, F.substr(F.md5(k.cast("string")), F.length(lead) + 1))
    digits = F.when(k % 4 == 1, F.concat(F.substring(digits, 1, 12), F.lit("0" * 16), F.substring(F.md5(k.cast("string")), 1, 4))).otherwise(digits)
    groups = F.transform(F.regexp_extract_all(digits, F.lit("[0-9a-f]{4}"), F.lit(0)), lambda g: F.regexp_replace(g, "^0{1,3}", ""))  # digits are made once, not once a group
    full = F.array_join(groups, ":")
    short = F.concat(F.array_join(F.slice(groups, 1, 3), ":"), F.lit("::"), groups[7])
    url = F.when(k % 4 == 1, F.concat(F.lit("http://["), short, F.lit("]/a"))).when(k % 4 == 2, F.concat(F.lit("https://u@["), F.upper(full), F.lit("%eth0]:8080/"))).otherwise(F.concat(F.lit("http://["), full, F.lit("]:80")))
    return table(spark, sf, "events").select("event_id", url.alias("url")).select("event_id", U.is_private("url").alias("private"))


def _ranges() -> str:
    """Rows of (first, last, private) of IPv6 networks, narrow ones to come before wide ones, with the length of the prefix."""
    import ipaddress

    nets = [("::/0", True), ("2000::/3", False), ("ff00::/8", False), ("fec0::/10", False), ("2001::/23", True), ("2001:1::1/128", False), ("2001:1::2/128", False), ("2001:3::/32", False), ("2001:4:112::/48", False),
            ("2001:20::/28", False), ("2001:30::/28", False), ("2001:db8::/32", True), ("2002::/16", True), ("3fff::/20", True), ("::ffff:0:0/96", False)]
    four = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "240.0.0.0/4", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24"]
    nets += [(f"::ffff:{n.split('/')[0]}/{96 + int(n.split('/')[1])}", True) for n in four]
    rows = [(ipaddress.ip_network(n), p) for n, p in nets]
    return ", ".join(f"('{int(n[0]):032x}', '{int(n[-1]):032x}', {n.prefixlen}, {str(p).lower()})" for n, p in rows)


PRIVATE6 = f"""WITH a AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS m, {list(_LEADS)}[event_id % {len(_LEADS)} + 1] AS lead FROM events),
  d AS (SELECT event_id, CASE WHEN event_id % 4 = 1 THEN substr(lead || substr(m, length(lead) + 1), 1, 12) || repeat('0', 16) || substr(m, 1, 4) ELSE lead || substr(m, length(lead) + 1) END AS digits FROM a)
  SELECT event_id, arg_max(private, bits) AS private FROM d JOIN (VALUES {_ranges()}) r(first, last, bits, private) ON digits BETWEEN first AND last GROUP BY 1"""

QUERIES = {f.__name__: f for f in (
    url_parts, url_pattern, page_types, url_normalize, url_normalize_dedup, url_depth_hist, url_keys, url_predicates, url_form_values, resolved_links, article_links, section_names, private_ipv6)}
ORACLE_SQL = {
    "url_parts": URL_PARTS, "url_pattern": URL_PATTERN, "page_types": PAGE_TYPES, "url_normalize": NORMAL, "url_normalize_dedup": DEDUP,
    "url_depth_hist": DEPTH, "url_keys": URL_KEYS, "url_predicates": URL_PREDICATES, "url_form_values": FORMS, "private_ipv6": PRIVATE6,
    "resolved_links": """SELECT page_id, link, CASE WHEN link LIKE 'http%' THEN link WHEN link LIKE '//%' THEN concat(regexp_extract(u, '^([a-z]+:)', 1), link) WHEN link LIKE '/%' THEN concat(regexp_extract(u, '^([a-z]+://[^/]+)', 1), link)
      ELSE concat(u, link) END AS resolved FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, unnest(['/a/b', '?x=1', '//cdn.example.org/c.js', 'https://other.example.org/', '#part']) AS link FROM pages)""",
    "article_links": f"""SELECT domain, rank, page_id FROM (SELECT domain, page_id, row_number() OVER (PARTITION BY domain ORDER BY length(p) - length(replace(p, '-', '')) DESC, url, page_id) AS rank
      FROM (SELECT page_id, url, {PARTS}, trim(regexp_extract(url, {S}, 3), '/') AS p FROM pages) WHERE regexp_matches(regexp_extract(url, {S}, 3), '[0-9]{{3}}')) WHERE rank <= 5""",
    "section_names": f"SELECT category, count(*) AS n FROM (SELECT regexp_extract(path, '^/([^/]*)', 1) AS section FROM (SELECT {PARTS} FROM pages)) JOIN (VALUES {_SECTION_ROWS}) v(section, category) USING (section) GROUP BY 1",
}
