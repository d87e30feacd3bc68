"""Queries over versioned stores, with `pages` as structures and `events` as schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import url as U
from quern.operators import store, structure
from quern.plans import crawl
from quern.plans.urls import PARTS, case
from quern.sources import archive, shared
from quern.sources.tables import table


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select(U.domain("url").alias("domain"), U.classify(F.col("url"), U.PAGE_TYPES, "general").alias("page_type"), "page_id", F.timestamp_seconds("page_id").alias("captured_at"))


def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of pages saved one after the other; the newest five versions stay."""
    rows = _pages(spark, sf)
    empty = rows.where("false").withColumn("version", F.lit(0))
    first = store.save(empty, rows.where("page_id < 120"), ["domain", "page_type"])
    return store.save(first, rows.where("page_id >= 120"), ["domain", "page_type"], 5).select("domain", "page_type", "version", "page_id")


def store_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pages(spark, sf)
    saved = store.save(rows.where("false").withColumn("version", F.lit(0)), rows, ["domain", "page_type"])
    return store.latest(saved, ["domain", "page_type"]).select("domain", "page_type", "version", "page_id")


def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return store.stats(_pages(spark, sf), ["domain", "page_type"])


def structure_signatures(spark: SparkSession, sf: str) -> DataFrame:
    s = structure.structures(table(spark, sf, "pages"))
    sig = store.signature(F.col("tag_counts"), F.map_keys("css_class_map"), F.col("semantic_landmarks"))
    return s.select(sig.alias("s")).groupBy("s.tags", "s.classes").agg(F.count(F.lit(1)).alias("n"))


def schedule_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each user's schedule after all events, paused ones left out of the due list."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    keyed = e.withColumn("at", F.struct("ts", "event_id"))
    state = store.upsert(keyed.where("event_id < 5000"), keyed.where("event_id >= 5000"), ["user_id"], "at")
    return state.select("user_id", "event_type", (F.col("event_type") != "error").alias("enabled"))


def conversation_json(spark: SparkSession, sf: str) -> DataFrame:
    """Turns wrapped as fenced JSON, every other one broken, and read back."""
    body = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("role", "turn"))).otherwise("{broken")
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    v = store.clean_json(fenced)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.try_variant_get(v, "$.role", "string").alias("role_back"), v.isNotNull().alias("parsed"))


_P = f"(SELECT domain, page_id, {case(U.PAGE_TYPES, 'general', 'page_type')} FROM (SELECT page_id, url, {PARTS} FROM pages))"
def stored_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages, written to a WARC archive in two commits and read again."""
    archive.register(spark)
    at, p = shared.fresh(spark, "pages"), table(spark, sf, "pages").withColumn("fetched_at", F.timestamp_seconds("page_id"))
    for part in ("page_id % 2 = 0", "page_id % 2 <> 0 OR page_id IS NULL"):
        p.where(part).write.format("quern_pages").mode("append").save(at)
    done = spark.read.format("quern_pages").load(at)
    return done.select("page_id", "url", F.unix_seconds("fetched_at").alias("seconds"), "status_code", F.md5("html").alias("html_md5"), "status")


def stored_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """The frontier of all pages, written as a version and read again."""
    archive.register(spark)
    at = shared.fresh(spark, "frontier")
    crawl.frontier_rows(spark, sf).withColumn("state", F.lit("queued")).withColumn("attempts", F.lit(0)).write.format("quern_frontier").mode("append").save(at)
    done = spark.read.format("quern_frontier").load(at)
    return done.select("url", "domain", "depth", F.round("priority", 9).alias("priority"), F.round("score", 9).alias("score"), "state", "attempts")


QUERIES = {f.__name__: f for f in (store_versions, store_latest, store_stats, structure_signatures, schedule_upsert, conversation_json, stored_pages, stored_frontier)}
ORACLE_SQL = {
    "store_versions": f"SELECT domain, page_type, version, page_id FROM (SELECT *, row_number() OVER (PARTITION BY domain, page_type ORDER BY page_id) AS version, row_number() OVER (PARTITION BY domain, page_type ORDER BY page_id DESC) AS age FROM {_P}) WHERE age <= 5",
    "store_latest": f"SELECT domain, page_type, count(*) AS version, max(page_id) AS page_id FROM {_P} GROUP BY ALL",
    "store_stats": f"SELECT 'domain' AS level, domain AS value, count(*) AS n FROM {_P} GROUP BY 2 UNION ALL SELECT 'page_type', page_type, count(*) FROM {_P} GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM {_P}",
    "schedule_upsert": "SELECT user_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS event_type, arg_max(event_type, {'t': ts, 'i': event_id}) <> 'error' AS enabled FROM events GROUP BY 1",
    "conversation_json": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS role_back, turn % 2 = 0 AS parsed FROM conversations",
    "stored_pages": "SELECT page_id, url, page_id AS seconds, 200 AS status_code, md5(html) AS html_md5, 'success' AS status FROM pages",
    "stored_frontier": f"SELECT url, domain, depth, round(priority, 9) AS priority, round(score, 9) AS score, 'queued' AS state, 0 AS attempts FROM {crawl.PRIO}",
}
