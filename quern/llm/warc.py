"""Resolution of not-modified revisits.

A revisit record (a server said 304) is joined to the latest earlier full response of its canonical address. The
join is an as-of join over time slices: the last response of each address and slice is found first, carried forward
over an address's slices (a bounded number of rows), and completed by a window inside each slice, so that an address
with a third of all records is still many tasks. Validators must agree, and only headers that a not-modified answer
may update are taken from it. DataFrame operations only; payloads aren't moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.llm.common import read

# Headers that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """An address without scheme, fragment, default port, leading www. and trailing slash, host in lower case, parameters
    sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))).otherwise(""))


def resolve(records: DataFrame, *, slices: int = 64) -> DataFrame:
    """One row per revisit of (record_id long, url, ts long, kind, headers map<string,string>): record_id, address, ts,
    refers_to (record_id of the response or null), status and headers.

    kind is 'response' or 'revisit'; others are ignored. status is 'resolved', 'no_response' (none earlier) or 'mismatch'
    (an etag, or without etags a last-modified date, that differs from the response's, or none in common). headers are the
    response's with the permitted ones of the revisit, for resolved revisits; else the revisit's own. Earlier means a
    smaller ts; of responses with one ts the one of largest record_id counts. Null addresses, times and headers: a
    response without address or time is never referred to, a revisit without them finds none, null headers are none.
    Repeated revisits are rows of their own. An empty table gives no rows; other columns are ignored.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.where("kind in ('response', 'revisit')").select(
        F.col("record_id").cast("long").alias("record_id"), canonical(F.col("url")).alias("address"), F.col("ts").cast("long").alias("ts"),
        (F.col("kind") == "response").alias("full"), F.coalesce(F.col("headers"), empty).alias("headers"),
    )
    usable = F.col("address").isNotNull() & F.col("ts").isNotNull()
    cuts = rows.where(usable).select(F.percentile_approx("ts", [i / slices for i in range(1, slices)], 1000).alias("q")).first()["q"] or []
    slice_ = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>"), lambda c: c <= F.col("ts")))
    timed = rows.where(usable).withColumn("slice", slice_)
    response = F.when(F.col("full"), F.struct("ts", "record_id", "headers"))
    latest = timed.groupBy("address", "slice").agg(F.max_by(response, F.when(F.col("full"), F.struct("ts", "record_id"))).alias("last"))
    before = Window.partitionBy("address").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("address", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("address", "slice").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = timed.withColumn("own", F.last(response, ignorenulls=True).over(inside)).where("not full")
    found = found.join(carried, ["address", "slice"]).select("record_id", "address", "ts", "headers", F.coalesce("own", "carried").alias("r"))
    lost = rows.where(~usable & ~F.col("full")).select("record_id", "address", "ts", "headers", F.lit(None).cast(found.schema["r"].dataType).alias("r"))
    out = found.union(lost)
    mine, theirs = (lambda h: F.col("headers")[h]), (lambda h: F.col("r.headers")[h])
    agree = F.coalesce(mine("etag") == theirs("etag"), mine("last-modified") == theirs("last-modified"), F.lit(False))
    status = F.when(F.col("r").isNull(), "no_response").when(agree, "resolved").otherwise("mismatch")
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("r.headers", lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    out = out.withColumn("status", status)
    return out.select(
        "record_id", "address", "ts", F.when(F.col("status") == "resolved", F.col("r.record_id")).alias("refers_to"), "status",
        F.when(F.col("status") == "resolved", merged).otherwise(F.col("headers")).alias("headers"),
    )


def records(pages: DataFrame) -> DataFrame:
    """Crawl records made from `pages`, which hold none: each page is a response at the time page_id; a third are fetched again
    2000 later with another etag; and half, by a hash, are asked for again up to 5000 later, at an address spelled in
    another way (host in upper case, default port, parameters turned round, fragment), and answered as not modified. One in
    eight of these has an etag of its own, so that it meets a changed response."""
    n = F.conv(F.substring(F.md5(F.concat("url", F.lit("|"), F.col("page_id").cast("string"))), 1, 6), 16, 10).cast("long")
    site, rest = F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract("url", "[?]([^#]*)", 1)
    turned = F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.reverse(F.split(query, "&")), "&")))
    port = F.when(F.startswith(F.lower("url"), F.lit("https:")), ":443").otherwise(":80")
    port = F.when(site.rlike(":[0-9]+$"), "").otherwise(port)
    other = F.concat(F.regexp_extract(site, "^([A-Za-z]+://)", 1), F.upper(F.regexp_extract(site, "://(.*)$", 1)), port, rest, turned, F.lit("#again"))
    tag = lambda k: F.substring(F.md5(F.concat(canonical(F.col("url")), F.lit(k))), 1, 12)

    def row(number: int, url: Column, ts: Column, kind: str, etag: Column, length: Column) -> Column:
        headers = F.create_map(F.lit("etag"), etag, F.lit("date"), ts.cast("string"), F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), length.cast("string"))
        return F.struct((F.col("page_id") * 3 + number).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(kind).alias("kind"), headers.alias("headers"))

    page = F.col("page_id")
    made = F.array(
        row(0, F.col("url"), page, "response", tag("a"), F.length("html")),
        F.when(n % 3 == 0, row(1, F.col("url"), page + 2000, "response", tag("b"), F.length("html") + 1)),
        F.when(F.floor(n / 3) % 2 == 0, row(2, other, page + 1 + F.floor(n / 6) % 5000, "revisit", F.when(F.floor(n / 7) % 8 == 0, tag("c")).otherwise(tag("a")), F.lit(0))),
    )
    return pages.where("url is not null and page_id is not null").select(F.explode(F.filter(made, lambda r: r.isNotNull())).alias("r")).select("r.*")


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits made from all pages (see `records`), by canonical address, with the resolved headers."""
    done = resolve(records(read(spark, sf_dir, "pages")))
    return done.select(
        "record_id", "address", "refers_to", "status", F.col("headers")["date"].alias("header_date"),
        F.col("headers")["content-length"].alias("header_length"), F.col("headers")["etag"].alias("header_etag"),
    )


_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':(80|443)$', ''), '^www[.]', '')"
_PATH = "regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '')"
_QUERY = "regexp_extract(url, '[?]([^#]*)', 1)"
OP8_SQL = f"""
WITH p AS (
  SELECT page_id, length(html) AS n, CAST(('0x' || substr(md5(url || '|' || page_id), 1, 6)) AS BIGINT) AS k,
         {_HOST} || {_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || array_to_string(list_sort(string_split({_QUERY}, '&')), '&') ELSE '' END AS address
  FROM pages),
f AS (
  SELECT page_id * 3 AS id, page_id AS ts, address, substr(md5(address || 'a'), 1, 12) AS etag, n FROM p
  UNION ALL
  SELECT page_id * 3 + 1, page_id + 2000, address, substr(md5(address || 'b'), 1, 12), n + 1 FROM p WHERE k % 3 = 0),
r AS (
  SELECT page_id * 3 + 2 AS id, page_id + 1 + (k // 6) % 5000 AS ts, address,
         substr(md5(address || CASE WHEN (k // 7) % 8 = 0 THEN 'c' ELSE 'a' END), 1, 12) AS etag
  FROM p WHERE (k // 3) % 2 = 0),
j AS (
  SELECT r.id, r.ts, r.address, r.etag, f.id AS prev, f.etag AS was, f.n,
         row_number() OVER (PARTITION BY r.id ORDER BY f.ts DESC NULLS LAST, f.id DESC) AS i
  FROM r LEFT JOIN f ON f.address = r.address AND f.ts < r.ts)
SELECT id AS record_id, address, CASE WHEN was = etag THEN prev END AS refers_to,
       CASE WHEN prev IS NULL THEN 'no_response' WHEN was = etag THEN 'resolved' ELSE 'mismatch' END AS status,
       CAST(ts AS VARCHAR) AS header_date, CASE WHEN was = etag THEN CAST(n AS VARCHAR) ELSE '0' END AS header_length, etag AS header_etag
FROM j WHERE i = 1
"""
