"""Metrics, rate limits, alerts, leases and jobs over `events`, read as a fetch log: user_id is the domain, event_type
the outcome ('error' a failure), value the response time in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.operators import limits
from quern.sources.tables import table

BOUNDS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 100.0]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")


def fetch_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative buckets per outcome, with the sum and count that such a histogram carries: one pass, no exploded rows."""
    e = _events(spark, sf).groupBy("event_type").agg(
        *[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)], F.count("value").alias("total"), F.round(F.sum("value"), 4).alias("sum_value"))
    le = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)])).alias("h")
    return e.select("event_type", le, "total", "sum_value").select("event_type", "h.le", "h.n", "total", "sum_value")


def rolling_mean20(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return _events(spark, sf).select("event_id", F.round(F.avg("value").over(w), 6).alias("mean20"))


def error_streak_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive errors after each event and the delay they lead to: base 1, doubled up to five times, at most 60."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    island = F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order)
    rows = _events(spark, sf).withColumn("island", island)
    streak = F.sum(F.col("failed").cast("long")).over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id"))
    return rows.select("event_id", streak.alias("streak")).withColumn("delay", F.least(F.pow(F.lit(2.0), F.least("streak", F.lit(5))), F.lit(60.0)))


def domain_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("ts").alias("last_request"), F.count_if(F.col("event_type") == "click").alias("clicks"))


def crawler_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).agg(F.count_if(~F.col("failed")).alias("crawled"), F.count_if("failed").alias("failed"), F.count_distinct("user_id").alias("domains"), F.round(F.sum("value"), 4).alias("bytes"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("mean_k"))


def state_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rollup of outcomes and days: per pair, per outcome and overall, in one pass."""
    return _events(spark, sf).rollup("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("day").cast("string").alias("day"), "n")


def alert_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of each type and domain, sent at most once in six hours."""
    return limits.throttle(_events(spark, sf).select("event_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), "ts"), 360).select("event_id", "key", "sent")


def alert_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Suppressed alerts by key, where there are several."""
    return alert_throttle(spark, sf).where("not sent").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def alert_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Severity of an event's alert and whether it passes the gate (warning or more)."""
    severity = F.when(F.col("failed"), F.when(F.col("value") > 100, "critical").otherwise("error")).when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return _events(spark, sf).groupBy(severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(severity == "info", False).otherwise(True)).alias("passes"))


def stale_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims (the last event of a user) older than 300 seconds at a fixed time."""
    last = _events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("claimed_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return last.where(F.col("claimed_at") < F.lit("2024-01-30 12:00:00").cast("timestamp") - F.expr("interval 300 seconds"))


def active_workers(spark: SparkSession, sf: str) -> DataFrame:
    last = _events(spark, sf).where("event_type <> 'error'").groupBy("user_id").agg(F.max("ts").alias("beat"))
    active = F.col("beat") > F.lit("2024-01-30 20:00:00").cast("timestamp") - F.expr("interval 8 hours")
    return last.groupBy(F.when(active, "active").otherwise("dead").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def job_status(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts, failures and state of each user's job: failed after three errors in a row at the end."""
    e = _events(spark, sf)
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last3 = e.withColumn("k", F.row_number().over(order)).where("k <= 3").groupBy("user_id").agg(F.count_if("failed").alias("f"))
    out = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("failed").alias("failures")).join(last3, "user_id")
    return out.select("user_id", "attempts", "failures", F.when(F.col("f") == 3, "failed").when(F.col("f") > 0, "retry").otherwise("completed").alias("state"))


def run_history(spark: SparkSession, sf: str) -> DataFrame:
    """The ten newest of the hundred entries that are kept of each user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf).withColumn("k", F.row_number().over(order)).where("k <= 10").select("user_id", "k", "event_id")


def rate_limit_waits(spark: SparkSession, sf: str) -> DataFrame:
    """Waits of each user's requests under an adaptive limit, replayed in order."""
    return limits.replay(_events(spark, sf).select("event_id", F.col("user_id").cast("string").alias("domain"), "ts", "failed", (F.col("event_type") == "purchase").alias("limited"), F.col("value").alias("ms")))


def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return limits.bucket(_events(spark, sf).select("event_id", F.col("user_id").cast("string").alias("domain"), "ts"), 0.0002, 2)


def adaptive_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Recrawl minutes after a user's whole history: halved by a change, 1.5 times after three visits without one, 5 to 10080."""
    runs = _events(spark, sf).select("user_id", F.struct("ts", "event_id").alias("seq"), (F.col("event_type") == "purchase").alias("changed"))
    return limits.interval(runs).select("user_id", F.round("minutes", 6).alias("minutes"))


EV = "(SELECT *, event_type = 'error' AS failed FROM events)"
THROTTLE = f"""WITH RECURSIVE e AS (SELECT event_id, concat_ws(':', event_type, user_id) AS key, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT event_id, key, ts AS last, k, true AS sent FROM e WHERE k = 1 UNION ALL
    SELECT e.event_id, e.key, CASE WHEN e.ts - r.last < INTERVAL 360 MINUTE THEN r.last ELSE e.ts END, e.k, NOT (e.ts - r.last < INTERVAL 360 MINUTE) FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
  SELECT event_id, key, sent FROM r"""
BUCKET = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT event_id, user_id, k, 1.0::DOUBLE AS tokens, t AS at, 0.0::DOUBLE AS wait FROM e WHERE k = 1 UNION ALL
    SELECT event_id, user_id, k, CASE WHEN n < 1 THEN 0.0 ELSE n - 1 END, CASE WHEN n < 1 THEN now + (1 - n) / 0.0002 ELSE now END, CASE WHEN n < 1 THEN (1 - n) / 0.0002 ELSE 0.0 END FROM (
      SELECT e.event_id, e.user_id, e.k, greatest(e.t, r.at) AS now, least(2.0, r.tokens + (greatest(e.t, r.at) - r.at) * 0.0002::DOUBLE) AS n FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
  SELECT event_id, round(wait, 6) AS wait FROM r"""
WAITS = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, event_type = 'error' AS failed, event_type = 'purchase' AS limited, value AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  s AS (SELECT event_id, user_id, 0::BIGINT AS k, NULL::DOUBLE AS last, 1.0::DOUBLE AS delay, 0 AS errors, []::DOUBLE[] AS times, NULL::DOUBLE AS adjusted, 0.0::DOUBLE AS wait FROM e WHERE k = 1 UNION ALL
    SELECT event_id, user_id, k, last, CASE WHEN limited THEN least(delay * 2, 60.0) WHEN failed OR NOT turn THEN delay WHEN list_avg(times) < 100 THEN greatest(delay * 0.9::DOUBLE, 0.5) WHEN list_avg(times) > 2000 THEN least(delay * 1.2::DOUBLE, 60.0) ELSE delay END,
      CASE WHEN failed OR limited THEN errors + 1 ELSE 0 END, times, CASE WHEN failed OR limited OR NOT turn THEN adjusted ELSE last END, wait FROM (
      SELECT *, adjusted IS NULL OR last - adjusted >= 60 AS turn FROM (
        SELECT event_id, user_id, k, failed, limited, delay, errors, adjusted, CASE WHEN failed OR limited THEN times ELSE list_append(times, ms)[-20:] END AS times, now + w AS last, w AS wait FROM (
          SELECT *, CASE WHEN last IS NULL THEN 0.0 ELSE greatest(0.0, CASE WHEN errors > 0 THEN least(delay * pow(2.0, least(errors, 5)), 60.0) ELSE delay END - (now - last)) END AS w FROM (
            SELECT e.event_id, e.user_id, e.k, e.failed, e.limited, e.ms, s.last, s.delay, s.errors, s.times, s.adjusted, greatest(e.t, coalesce(s.last, 0)) AS now FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))))
  SELECT event_id, round(wait, 6) AS wait, round(delay, 6) AS delay FROM s WHERE k > 0"""
QUERIES = {f.__name__: f for f in (
    fetch_counters, latency_histogram, rolling_mean20, error_streak_backoff, domain_stats, crawler_stats, state_counts, alert_throttle, alert_summaries, alert_gate,
    stale_claims, active_workers, job_status, run_history, rate_limit_waits, token_bucket, adaptive_interval)}
ORACLE_SQL = {
    "fetch_counters": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL",
    "latency_histogram": f"SELECT event_type, le, count(*) FILTER (value <= le) AS n, count(value) AS total, round(sum(value), 4) AS sum_value FROM events, (SELECT unnest({BOUNDS})::DOUBLE AS le) GROUP BY ALL",
    "rolling_mean20": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING), 6) AS mean20 FROM events",
    "error_streak_backoff": f"""SELECT event_id, streak, least(pow(2.0, least(streak, 5)), 60.0) AS delay FROM (SELECT event_id, CAST(sum(CAST(failed AS INT)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak
      FROM (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM {EV}))""",
    "domain_stats": f"SELECT user_id, count(*) AS requests, count(*) FILTER (failed) AS errors, round(avg(value), 6) AS mean_value, max(ts) AS last_request, count(*) FILTER (event_type = 'click') AS clicks FROM {EV} GROUP BY 1",
    "crawler_stats": f"SELECT count(*) FILTER (NOT failed) AS crawled, count(*) FILTER (failed) AS failed, count(DISTINCT user_id) AS domains, round(sum(value), 4) AS bytes, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM {EV}",
    "state_counts": "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))",
    "alert_throttle": THROTTLE, "token_bucket": BUCKET, "rate_limit_waits": WAITS,
    "alert_summaries": f"SELECT key, count(*) AS n FROM ({THROTTLE}) WHERE NOT sent GROUP BY 1 HAVING count(*) > 1",
    "alert_gate": f"SELECT CASE WHEN failed THEN CASE WHEN value > 100 THEN 'critical' ELSE 'error' END WHEN event_type = 'purchase' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n, bool_or(failed OR event_type = 'purchase') AS passes FROM {EV} GROUP BY 1",
    "stale_claims": "SELECT user_id, max(ts) AS claimed_at, arg_max(event_type, {'t': ts, 'i': event_id}) AS state FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 300 SECOND",
    "active_workers": "SELECT CASE WHEN b > TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 8 HOUR THEN 'active' ELSE 'dead' END AS state, count(*) AS n FROM (SELECT user_id, max(ts) AS b FROM events WHERE event_type <> 'error' GROUP BY 1) GROUP BY 1",
    "job_status": f"""SELECT user_id, count(*) AS attempts, count(*) FILTER (failed) AS failures, CASE count(*) FILTER (failed AND k <= 3) WHEN 3 THEN 'failed' WHEN 0 THEN 'completed' ELSE 'retry' END AS state
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {EV}) GROUP BY 1""",
    "run_history": "SELECT user_id, k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10",
    "adaptive_interval": """WITH RECURSIVE e AS (SELECT user_id, event_type = 'purchase' AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 1440.0::DOUBLE AS m, 0 AS n FROM e UNION ALL
        SELECT e.user_id, e.k, CASE WHEN c THEN greatest(m * 0.5, 5) WHEN n >= 2 THEN least(m * 1.5, 10080) ELSE m END, CASE WHEN c OR n >= 2 THEN 0 ELSE n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
      SELECT user_id, round(arg_max(m, k), 6) AS minutes FROM r GROUP BY 1""",
}
