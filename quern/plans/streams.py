"""Streams over `events` whose state has timers, and the monitor as a stream over `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import url as U
from quern.plans import events as E
from quern.plans.work import _LOG, KINDS
from quern.sources import shared
from quern.sources.tables import table
from quern.streaming import monitor, timers


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """`events` as a stream: the table may be a file or a folder of files."""
    rows = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def claim_log(events: DataFrame) -> DataFrame:
    """Events as what happened to an address (here the user)."""
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return events.select(F.col("user_id").cast("string").alias("url"), F.coalesce(F.element_at(names, F.col("event_type")), F.lit("add")).alias("kind"), F.concat(F.lit("w"), F.col("event_id") % 4).alias("worker"), "ts", "event_id")


def stream_stale_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that had no answer for six hours."""
    return shared.drained(timers.stale_claims(claim_log(event_stream(spark, sf)), 21_600))


def stream_alert_flush(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of each type and user that are sent, at most once in six hours, and summaries of those suppressed since."""
    rows = event_stream(spark, sf).select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), "ts", "event_id")
    return shared.drained(timers.alerts(rows, 360))


def stream_lost_leases(spark: SparkSession, sf: str) -> DataFrame:
    """Leases of each user on each kind of event that had no beat for two days."""
    rows = event_stream(spark, sf).select(F.col("user_id").cast("string").alias("worker"), F.col("event_type").alias("job_id"), "ts", "event_id")
    return shared.drained(timers.lost_leases(rows, 172_800))


def stream_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """The records of a monitor that visits a site's pages in four batches, in order of their ids, from a stream."""
    at, pages = shared.fresh(spark, "monitor"), table(spark, sf, "pages").select("page_id", "url", "html")
    cuts = pages.select(F.percentile_approx("page_id", [0.25, 0.5, 0.75], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c < F.col("page_id")))
    for k in range(len(cuts) + 1):  # each time the stream goes on where it ended
        pages.where(part == k).write.mode("append").parquet(f"{at}/pages")
        source = spark.readStream.schema(pages.schema).parquet(f"{at}/pages")
        monitor.watch(source, at, U.domain, every=None).awaitTermination()
    return monitor.records(spark, at)


#: The watermark at the end: the largest time, in milliseconds, less a minute.
_MARK = "(SELECT epoch_ms(max(ts)) - 60000 FROM events)"
QUERIES = {f.__name__: f for f in (stream_stale_claims, stream_alert_flush, stream_lost_leases, stream_monitor)}
ORACLE_SQL = {
    "stream_stale_claims": f"""SELECT url, worker, ts AS claimed_at FROM (SELECT *, lead(ts) OVER (PARTITION BY url ORDER BY ts, event_id) AS next FROM {_LOG} WHERE kind <> 'add')
      WHERE kind = 'claim' AND (next - ts > INTERVAL 6 HOUR OR next IS NULL AND epoch_ms(ts) + 21600000 < {_MARK})""",
    "stream_alert_flush": f"""WITH t AS (SELECT event_id, key, sent, ts, sum(CAST(sent AS INT)) OVER (PARTITION BY key ORDER BY ts, event_id) AS g FROM ({E.THROTTLE}) JOIN (SELECT event_id, ts FROM events) USING (event_id)),
      s AS (SELECT key, g, max(ts) FILTER (sent) AS start, count(*) FILTER (NOT sent) AS n, arg_max(event_id, {{'t': ts, 'i': event_id}}) AS event_id, g = max(g) OVER (PARTITION BY key) AS latest FROM t GROUP BY key, g)
      SELECT key, 'sent' AS kind, event_id, 1::BIGINT AS n FROM t WHERE sent UNION ALL
      SELECT key, 'summary', event_id, n FROM s WHERE n > 1 AND (NOT latest OR epoch_ms(start) + 21600000 < {_MARK})""",
    "stream_lost_leases": f"""SELECT worker, job_id, ts AS last_beat FROM (SELECT CAST(user_id AS VARCHAR) AS worker, event_type AS job_id, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next FROM events)
      WHERE next - ts > INTERVAL 2 DAY OR next IS NULL AND epoch_ms(ts) + 172800000 < {_MARK}""",
}
