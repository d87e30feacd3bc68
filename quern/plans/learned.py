"""Classifier, sitemap and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import schedule as S
from quern.operators import learn, structure
from quern.plans import events as E
from quern.sources import shared, sitemap
from quern.sources.tables import table
from quern.streaming import stateful

PATHS_SQL = "['/sitemap.xml', '/sitemap_index.xml', '/sitemap-index.xml', '/sitemaps.xml', '/sitemap.xml.gz']"


def classifier_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all vectors as a classifier trained on them predicts."""
    e = table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("string"))
    model, _ = learn.train(e, "label")
    return learn.predict(model, e).select("vec_id", "label", "predicted", F.round("confidence", 6).alias("confidence"))


def description_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed embeddings of page descriptions."""
    d = structure.structures(table(spark, sf, "pages")).select("page_id", structure.describe().alias("description"))
    return learn.embed(d, "description").select("page_id", F.size("embedding").alias("dims"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


def sitemap_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap files made from the pages of each site, parsed again and filtered."""
    p = table(spark, sf, "pages")
    site = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    item = F.concat(F.lit("<url><loc>"), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</loc><lastmod>2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"),
                    F.lit("</lastmod><changefreq>"), F.when(F.col("page_id") % 3 == 0, "Daily").otherwise("often"), F.lit("</changefreq><priority>"), (F.col("page_id") % 13 / 10).cast("string"), F.lit("</priority></url>"))
    files = p.groupBy(F.concat(site, F.lit("/sitemap.xml")).alias("url")).agg(F.encode(F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), F.array_join(F.sort_array(F.collect_list(item)), ""), F.lit("</urlset>")), "utf-8").alias("content"))
    rows = sitemap.entries(files)
    rows = rows.where(sitemap.keep(F.col("priority"), F.col("modified"), 0.3, F.lit("2024-01-10").cast("timestamp")))
    return rows.select("loc", F.date_format("modified", "yyyy-MM-dd").alias("day"), "changefreq", F.round("priority", 6).alias("priority"))


SITEMAP = """SELECT url AS loc, concat('2024-01-', lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0')) AS day, CASE WHEN page_id % 3 = 0 THEN 'daily' END AS changefreq, round(least((page_id % 13) / 10, 1.0), 6) AS priority
  FROM pages WHERE ((page_id % 13) = 0 OR (page_id % 13) / 10 >= 0.3) AND page_id % 28 + 1 >= 10"""


def sitemap_discovery(spark: SparkSession, sf: str) -> DataFrame:
    sites = table(spark, sf, "pages").select(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1).alias("url")).distinct()
    tried = sites.select("url", F.explode(F.array(*[F.lit(p) for p in sitemap.PATHS])).alias("p"))
    responses = tried.select(F.concat("url", "p").alias("url"), F.when(F.substring(F.md5(F.concat("url", "p")), 1, 1) < "4", 200).otherwise(404).alias("status"))
    return sitemap.discover(sites, responses)


DISCOVERY = f"""SELECT url, arg_min(u, k) AS sitemap_url FROM (SELECT url, concat(url, p) AS u, k FROM (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS url FROM pages), (SELECT unnest({PATHS_SQL}) AS p, unnest(range(5)) AS k))
  WHERE substr(md5(u), 1, 1) < '4' GROUP BY 1"""


def lastmod_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written in the usual forms of sitemaps, read back."""
    e = table(spark, sf, "events")
    forms = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy-MM-dd'T'HH:mm:ssXXX", "'on' yyyy"]
    text = F.lit(None)
    for i, f in enumerate(forms):
        text = F.when(F.col("event_id") % 5 == i, F.date_format("ts", f)).otherwise(text)
    return e.select("event_id", S.lastmod(text).alias("modified"))


LASTMOD = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('month', ts) WHEN 3 THEN date_trunc('second', ts) END AS modified FROM events"""


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("failed", F.col("event_type") == "error")


def stream_alert_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """The batch query's result, from a stream."""
    alerts = _stream(spark, sf).select("event_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), "ts")
    return shared.drained(stateful.throttle(alerts, 360))


def stream_domain_health(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows that the watermark has closed."""
    e = _stream(spark, sf).select(F.col("user_id").cast("string").alias("domain"), "ts", "failed", F.col("value").alias("ms"))
    return shared.drained(stateful.health(e)).select("domain", "start", "requests", "errors", F.round("mean_ms", 6).alias("mean_ms"))


QUERIES = {f.__name__: f for f in (classifier_predict, description_embedding, sitemap_urls, sitemap_discovery, lastmod_parse, stream_alert_throttle, stream_domain_health)}
ORACLE_SQL = {
    "sitemap_urls": SITEMAP, "sitemap_discovery": DISCOVERY, "lastmod_parse": LASTMOD, "stream_alert_throttle": E.THROTTLE,
    "description_embedding": "SELECT page_id, 384 AS dims, 1.0::DOUBLE AS norm FROM pages",
    "stream_domain_health": """SELECT CAST(user_id AS VARCHAR) AS domain, date_trunc('hour', ts) AS start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_ms
      FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
}
