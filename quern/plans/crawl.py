"""Frontier and schedule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import schedule as S, url as U
from quern.operators import frontier as R
from quern.plans.urls import NORMAL, PARTS, case
from quern.sources.tables import table


def frontier_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "url", U.domain("url").alias("domain"), U.depth("url").alias("depth"), U.normalize("url").alias("norm_url"))
    boost = [F.col("url").contains("/en/"), F.col("url").contains("page=2")]
    return p.withColumn("priority", R.discovered_priority(F.col("url"), F.col("depth"), boost)).withColumn("score", R.pop_score(F.col("priority"), F.col("depth")))


PRIO = """(SELECT *, -priority + 0.001::DOUBLE * depth AS score FROM (SELECT *, greatest(0.1::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, p1 + b * 0.2::DOUBLE) * (1 - depth * 0.05::DOUBLE))) AS priority FROM (
  SELECT *, greatest(0.1::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, base + b * 0.2::DOUBLE) * (1 - depth * 0.05::DOUBLE))) AS p1 FROM (
  SELECT page_id, url, domain, len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth, CAST(contains(url, '/en/') AS INT) + CAST(contains(url, 'page=2') AS INT) AS b,
    CASE WHEN regexp_matches(lower(url), '/article|/post|/news|/blog') THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS base FROM (SELECT page_id, url, %s FROM pages)))))""" % PARTS


def frontier_scores(spark: SparkSession, sf: str) -> DataFrame:
    f = frontier_rows(spark, sf)
    return f.select("page_id", F.round("priority", 9).alias("priority"), F.round("score", 9).alias("score"), F.round(R.claim_score(F.col("priority"), F.col("depth"), F.col("page_id")), 6).alias("claim"), F.round(R.retry_priority(F.col("priority"), F.col("page_id") % 4), 9).alias("retry"))


def frontier_pop(spark: SparkSession, sf: str) -> DataFrame:
    f = frontier_rows(spark, sf).withColumn("score", F.round("score", 9))
    return R.pop(f, 2).select("domain", "rank", "page_id")


def discovered_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Second-level addresses that pass admission, those of the first fifty pages seen already."""
    f = frontier_rows(spark, sf).withColumn("score", F.round("score", 9))
    seen = f.where("page_id < 50")
    out = R.admit(f, seen, max_depth=2, allowed=["example.com", "example.net"], cap=3)
    return out.select("domain", "norm_url")


def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    f = frontier_rows(spark, sf)
    return f.groupBy("domain").agg(F.count(F.lit(1)).alias("queued"), F.count_distinct("norm_url").alias("added"), F.round(F.max("priority"), 9).alias("best"))


SCHEDULES = [("a", "0 9 * * 1-5"), ("b", "*/15 * * * *"), ("c", "0 0 1 * *"), ("d", "30 6,18 * * *"), ("e", "0 0 * * 0"), ("f", "5 0 29 2 *"), ("g", "0 0 31 11 *")]


def _crons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEDULES, "target string, cron string")


def cron_match(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("ts")
    pairs = e.join(F.broadcast(_crons(spark)), F.lit(True))
    return pairs.where(S.matches(F.col("cron"), F.col("ts"))).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def cron_next_run(spark: SparkSession, sf: str) -> DataFrame:
    """The next run of every schedule after each user's last event."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("after"))
    rows = last.join(F.broadcast(_crons(spark)), F.lit(True)).withColumn("target", F.concat_ws("-", "target", F.col("user_id").cast("string")))
    return S.next_run(rows).select("target", "next_run")


def due_schedules(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("after"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    rows = S.next_run(last.withColumn("cron", F.lit("0 */6 * * *"))).where("state <> 'error'")
    return rows.where(F.col("next_run") <= F.lit("2024-01-30 18:00:00").cast("timestamp")).select("user_id", "next_run")


def changefreq_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Schedules and scores of sitemap entries made from documents: priority from the length, frequency from the id."""
    d = table(spark, sf, "documents")
    freq = F.element_at(F.array(*[F.lit(f[0]) for f in S.FREQUENCIES], F.lit("sometimes")), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = d.select("doc_id", freq.alias("freq"), F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("priority"), (F.col("doc_id") % 40).alias("age"))
    return rows.select("doc_id", S.frequency(F.col("freq"), 2).alias("cron"), F.round(S.sitemap_score(F.col("priority"), F.col("freq"), F.col("age")), 6).alias("score"), ((F.col("priority") == 0) | (F.col("priority") >= 0.3)).alias("passes"))


_HOURS = "SELECT user_id, max(ts) AS after, arg_max(event_type, {'t': ts, 'i': event_id}) AS state FROM events GROUP BY 1"


def _cron_sql(minute: str, hour: str, dom: str, month: str, dow: str) -> str:
    def f(p: str, v: str) -> str:
        if p == "*":
            return "true"
        if p.startswith("*/"):
            return f"{v} % {p[2:]} = 0"
        if "," in p:
            return f"{v} IN ({p})"
        return f"{v} BETWEEN {p.replace('-', ' AND ')}" if "-" in p else f"{v} = {p}"
    return " AND ".join([f(minute, "minute(t)"), f(hour, "hour(t)"), f(dom, "day(t)"), f(month, "month(t)"), f(dow, "(isodow(t) - 1)")])


_MATCH = " UNION ALL ".join(f"SELECT '{k}' AS target, ts FROM (SELECT ts, ts AS t FROM events) WHERE {_cron_sql(*c.split())}" for k, c in SCHEDULES)
_NEXT = f"""WITH u AS (SELECT user_id, max(ts) AS after FROM events GROUP BY 1), m AS (SELECT t FROM range((SELECT date_trunc('minute', min(after)) FROM u), (SELECT max(after) FROM u) + INTERVAL 366 DAY, INTERVAL 1 MINUTE) r(t)),
  hits AS ({" UNION ALL ".join(f"SELECT '{k}' AS k, t FROM m WHERE {_cron_sql(*c.split())}" for k, c in SCHEDULES)}),
  x AS (SELECT user_id, after, date_trunc('minute', after) AS floor, k FROM u, (SELECT unnest({[k for k, _ in SCHEDULES]}) AS k) n),
  found AS (SELECT x.*, hits.t FROM x ASOF LEFT JOIN hits ON x.k = hits.k AND x.floor < hits.t)
  SELECT concat(k, '-', user_id) AS target, CASE WHEN t <= floor + INTERVAL 525600 MINUTE THEN t ELSE after + INTERVAL 1 DAY END AS next_run FROM found"""
TYPED = f"(SELECT domain, page_id, {case(U.PAGE_TYPES, 'general', 'page_type')} FROM (SELECT page_id, url, {PARTS} FROM pages))"
QUERIES = {f.__name__: f for f in (frontier_scores, frontier_pop, discovered_admission, queue_stats, cron_match, cron_next_run, due_schedules, changefreq_schedule)}
ORACLE_SQL = {
    "frontier_scores": f"SELECT page_id, round(priority, 9) AS priority, round(score, 9) AS score, round((1 - priority) * 1e6 + depth * 1000 + page_id, 6) AS claim, round(priority * pow(0.5, page_id % 4), 9) AS retry FROM {PRIO}",
    "frontier_pop": f"SELECT domain, rank, page_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(score, 9), url) AS rank FROM {PRIO}) WHERE rank <= 2",
    "discovered_admission": f"""SELECT domain, norm_url FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score, url) AS k FROM (
      SELECT domain, norm_url, arg_min(url, {{'s': round(score, 9), 'u': url}}) AS url, min(round(score, 9)) AS score FROM {PRIO} JOIN (SELECT page_id, norm_url FROM ({NORMAL})) USING (page_id)
      WHERE depth <= 2 AND (domain IN ('example.com', 'example.net') OR domain LIKE '%.example.com' OR domain LIKE '%.example.net')
        AND norm_url NOT IN (SELECT norm_url FROM ({NORMAL}) WHERE page_id < 50) GROUP BY 1, 2)) WHERE k <= 3""",
    "queue_stats": f"SELECT domain, count(*) AS queued, count(DISTINCT norm_url) AS added, round(max(priority), 9) AS best FROM {PRIO} JOIN (SELECT page_id, norm_url FROM ({NORMAL})) USING (page_id) GROUP BY 1",
    "cron_match": f"SELECT target, count(*) AS n FROM ({_MATCH}) GROUP BY 1",
    "cron_next_run": _NEXT,
    "due_schedules": f"SELECT user_id, next_run FROM (SELECT user_id, state, date_trunc('day', after) + INTERVAL 6 HOUR * (floor(hour(after) / 6) + 1) AS next_run FROM ({_HOURS})) WHERE state <> 'error' AND next_run <= TIMESTAMP '2024-01-30 18:00:00'",
    "changefreq_schedule": """SELECT doc_id, CASE f WHEN 0 THEN '*/5 * * * *' WHEN 1 THEN '0 * * * *' WHEN 2 THEN '0 0 * * *' WHEN 3 THEN '0 0 * * 0' WHEN 4 THEN '0 0 1 * *' WHEN 5 THEN '0 0 1 1 *' END AS cron,
      round(CASE WHEN p = 0 THEN 5 ELSE p * 10 END + CASE WHEN f < 7 THEN 5 - f ELSE 0 END + CASE WHEN age < 1 THEN 5 WHEN age < 7 THEN 3 WHEN age < 30 THEN 1 ELSE 0 END, 6) AS score, p = 0 OR p >= 0.3 AS passes
      FROM (SELECT doc_id, doc_id % 8 AS f, least(n_chars / 5000, 1.0::DOUBLE) AS p, doc_id % 40 AS age FROM documents)""",
}
