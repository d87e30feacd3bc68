"""Schedules and jobs from a log of commands, and alerts on what a crawl finds; `events` are the log, a user a schedule, a job or a
site, and a day of events a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.functions import url as U
from quern.operators import alerts, control, pii, recrawl, structure
from quern.plans import compliance, lifecycle, pages
from quern.sources.tables import table

SCHEDULE = {"signup": "add", "error": "remove", "view": "pause", "click": "resume"}
JOB = {"signup": "create", "click": "start", "view": "pause", "purchase": "add", "error": "cancel"}


def _command(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")].alias("command")


def schedule_control(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's schedule after all commands: signups add, errors remove, views pause, clicks resume."""
    cron = F.when(F.col("event_id") % 2 == 0, "0 * * * *").otherwise("0 0 * * *").alias("cron")
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("target"), "ts", "event_id", _command(SCHEDULE), cron)
    return control.schedules(e, ["ts", "event_id"])


def recrawl_round(spark: SparkSession, sf: str) -> DataFrame:
    """Users' schedules at a midnight and the plans after a round six hours later: purchases meanwhile are changes, users with an error fail."""
    start, now = F.lit("2024-01-15").cast("timestamp"), F.lit("2024-01-15 06:00:00").cast("timestamp")
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("target"), "ts", "event_id", "event_type", _command(SCHEDULE), F.when(F.col("event_id") % 2 == 0, "0 * * * *").otherwise("0 0 * * *").alias("cron"))
    plans = recrawl.merged(None, control.schedules(e.where(F.col("ts") < start), ["ts", "event_id"]), start)
    news = e.where((F.col("ts") >= start) & (F.col("ts") < now)).groupBy("target").agg(F.bool_or(F.col("event_type") == "purchase").alias("changed"), F.max(F.when(F.col("event_type") == "error", "fetch failed")).alias("error"))
    done, runs = recrawl.run(plans, now, lambda due: due.select("target").join(news, "target", "left"))
    return done.join(runs.select("target", "error"), "target", "left").select("target", "enabled", "next_run", "last_run", "last_change", "runs", "failures", "error")


def job_control(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's job after all commands: signups create it, clicks start, views pause and errors cancel it, purchases add addresses."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), "ts", "event_id", _command(JOB), F.floor("value").alias("n_urls"))
    return control.jobs(e, ["ts", "event_id"])


def alerts_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts on all changes between consecutive pages of a site whose similarity is under 0.95."""
    types = table(spark, sf, "pages").select("page_id", U.classify(F.col("url"), U.PAGE_TYPES, "general").alias("page_type"))
    c = structure.changes(pages.paired(spark, sf)).select("page_id", F.col("key").alias("domain"), F.round("similarity", 9).alias("similarity"), F.col("relearn").alias("breaking"))
    a = alerts.structure_changed(c.where("similarity < 0.95").join(types, "page_id"))
    return a.select("severity", "title", "message", "domain", F.get_json_object("details", "$.breaking").alias("breaking"))


def alerts_complete(spark: SparkSession, sf: str) -> DataFrame:
    """An alert for each day's crawl, with all its totals as details, and whether the default gate lets it pass."""
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    day = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(n("view", "click", "purchase").alias("pages_crawled"), n("error").alias("pages_failed"), n("signup").alias("pages_blocked"))
    a = alerts.complete(day)
    return a.select("severity", "message", F.get_json_object("details", "$.day").alias("day"), (F.col("severity") != "info").alias("passes"))


def alerts_personal(spark: SparkSession, sf: str) -> DataFrame:
    """An alert for each document with personal data, with all its kinds."""
    m = pii.matches(table(spark, sf, "documents")).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), "pii_type")
    return alerts.personal(m, "redact").select("severity", "title", "message", "url", "details")


def alerts_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """An alert for each page whose authorization keeps it from being fetched."""
    basis = compliance.authorization(spark, sf).where("not authorized").select("page_id", F.col("basis").alias("reason"))
    rows = table(spark, sf, "pages").select("page_id", "url").join(basis, "page_id").withColumn("block_type", F.lit("authorization"))
    return alerts.blocked(rows).select("severity", "title", "message", "url", "details")


_EV = "(SELECT *, {'t': ts, 'i': event_id} AS o FROM events)"
_BEFORE = "(SELECT *, {'t': ts, 'i': event_id} AS o FROM events WHERE ts < TIMESTAMP '2024-01-15')"
_LAST = "SELECT user_id, arg_max(event_type, o) AS c, max(o) AS o, arg_max(event_id, o) AS i FROM {0} WHERE event_type IN ({1}) GROUP BY 1"
QUERIES = {f.__name__: f for f in (schedule_control, recrawl_round, job_control, alerts_structure, alerts_complete, alerts_personal, alerts_blocked)}
ORACLE_SQL = {
    "schedule_control": f"""SELECT CAST(l.user_id AS VARCHAR) AS target, CASE WHEN l.i % 2 = 0 THEN '0 * * * *' ELSE '0 0 * * *' END AS cron, NOT coalesce(w.o > l.o AND w.c = 'view', false) AS enabled
      FROM ({_LAST.format(_EV, "'signup', 'error'")}) l LEFT JOIN ({_LAST.format(_EV, "'view', 'click'")}) w USING (user_id) WHERE l.c = 'signup'""",
    "recrawl_round": f"""WITH p AS (SELECT l.user_id, l.i % 2 = 0 AS hourly, NOT coalesce(w.o > l.o AND w.c = 'view', false) AS enabled FROM ({_LAST.format(_BEFORE, "'signup', 'error'")}) l LEFT JOIN ({_LAST.format(_BEFORE, "'view', 'click'")}) w USING (user_id) WHERE l.c = 'signup'),
      n AS (SELECT user_id, bool_or(event_type = 'purchase') AS changed, bool_or(event_type = 'error') AS failed FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-15 06:00:00' GROUP BY 1),
      d AS (SELECT p.*, enabled AND hourly AS due, coalesce(failed, false) AS failed, coalesce(changed, false) AS changed FROM p LEFT JOIN n USING (user_id))
      SELECT CAST(user_id AS VARCHAR) AS target, enabled, CASE WHEN due THEN TIMESTAMP '2024-01-15 07:00:00' WHEN hourly THEN TIMESTAMP '2024-01-15 01:00:00' ELSE TIMESTAMP '2024-01-16' END AS next_run,
        CASE WHEN due THEN TIMESTAMP '2024-01-15 06:00:00' END AS last_run, CASE WHEN due AND changed AND NOT failed THEN TIMESTAMP '2024-01-15 06:00:00' END AS last_change,
        CAST(due AS BIGINT) AS runs, CAST(due AND failed AS BIGINT) AS failures, CASE WHEN due AND failed THEN 'fetch failed' END AS error FROM d""",
    "job_control": f"""SELECT CAST(e.user_id AS VARCHAR) AS job_id, CASE arg_max(event_type, e.o) FILTER (event_type <> 'purchase') WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'view' THEN 'paused' ELSE 'cancelled' END AS state,
      CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (event_type IN ('signup', 'purchase')), 0) AS BIGINT) AS n_urls, bool_or(event_type = 'click') AS started, arg_max(event_type, e.o) FILTER (event_type <> 'purchase') = 'error' AS ended
      FROM {_EV} e JOIN (SELECT user_id, max(o) AS born FROM {_EV} WHERE event_type = 'signup' GROUP BY 1) b ON b.user_id = e.user_id AND e.o >= born GROUP BY e.user_id""",
    "alerts_structure": f"""SELECT CASE WHEN b THEN 'error' ELSE 'warning' END AS severity, 'Structure change detected: ' || domain AS title, domain, CAST(b AS VARCHAR) AS breaking,
      'Page type ''' || page_type || ''' structure changed. Similarity: ' || printf('%.1f', round(s * 100, 1)) || '%. ' || CASE WHEN b THEN 'Requires re-learning extraction strategy.' ELSE 'Minor change detected.' END AS message
      FROM (SELECT page_id, domain, round(similarity, 9) AS s, round(similarity, 9) < 0.7 AS b FROM {lifecycle._SIMS}) JOIN (SELECT page_id, {lifecycle._TYPE} FROM (SELECT page_id, url, {lifecycle.PARTS} FROM pages)) USING (page_id) WHERE s < 0.95""",
    "alerts_complete": """SELECT 'info' AS severity, 'Crawled ' || count(*) FILTER (event_type IN ('view', 'click', 'purchase')) || ' pages, ' || count(*) FILTER (event_type = 'error') || ' failed, ' || count(*) FILTER (event_type = 'signup') || ' blocked.' AS message,
      CAST(CAST(ts AS DATE) AS VARCHAR) AS day, false AS passes FROM events GROUP BY CAST(ts AS DATE)""",
    "alerts_personal": f"""SELECT 'warning' AS severity, 'PII detected in crawled content' AS title, 'Found PII types: ' || array_to_string(k, ', ') || '. Action taken: redact' AS message, 'doc:' || doc_id AS url,
      '{{"pii_types":["' || array_to_string(k, '","') || '"],"action":"redact"}}' AS details FROM (SELECT doc_id, list_sort(list(DISTINCT pii_type)) AS k FROM ({pages.ORACLE_SQL["pii_matches"]}) GROUP BY 1)""",
    "alerts_blocked": f"""SELECT 'info' AS severity, 'URL blocked: authorization' AS title, 'URL was blocked due to compliance check: ' || basis AS message, url, '{{"block_type":"authorization","reason":"' || basis || '"}}' AS details
      FROM pages JOIN ({compliance.ORACLE_SQL["authorization"]}) USING (page_id) WHERE NOT authorized""",
}
