"""Claims, notices, counters, gauges, logs and reach: what keeps a crawl going, over `events` and `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import url as U
from quern.operators import claims, compliance, frontier, limits, metrics
from quern.plans import compliance as C, crawl
from quern.plans.urls import PARTS
from quern.sources import sitemap
from quern.sources.tables import table

#: Events read as a claim log: what happened to an address (here the user) in order.
KINDS = {"view": "add", "click": "claim", "signup": "claim", "purchase": "complete", "error": "fail"}


def _log(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("url"), F.struct("ts", "event_id").alias("seq"), F.coalesce(F.element_at(names, F.col("event_type")), F.lit("add")).alias("kind"),
        F.concat(F.lit("w"), F.col("event_id") % 4).alias("worker"), F.when(F.col("value") > 50, F.lit("timeout")).alias("error"))


def claim_states(spark: SparkSession, sf: str) -> DataFrame:
    """What the log leaves of each address."""
    return claims.task_states(_log(spark, sf), 40)


def claim_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Pages done, failed and left by site (here the last digit)."""
    return claims.domain_totals(claim_states(spark, sf), F.substring("url", -1, 1))


def claim_next(spark: SparkSession, sf: str) -> DataFrame:
    """The next claims of four workers, by the score of the global queue; all other pages stay as they are."""
    f = crawl.frontier_rows(spark, sf)
    tasks = f.select(F.col("page_id").cast("string").alias("url"), F.when(F.col("page_id") % 7 == 0, "completed").otherwise("queued").alias("state"), (F.col("page_id") % 3).cast("int").alias("attempts"), F.round(frontier.claim_score(F.col("priority"), F.col("depth"), F.col("page_id")), 6).alias("score"))
    workers = spark.createDataFrame([("a", 3), ("b", 1), ("c", 4), ("d", 2)], "worker string, slots int")
    done = claims.claim(tasks, workers, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return done.select("url", "state", "attempts", "worker")


def job_workers(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs (event types) with their workers (users) and those active in the last day."""
    e = table(spark, sf, "events")
    seen = e.groupBy(F.col("event_type").alias("job_id"), F.col("user_id").alias("worker")).agg(F.max("ts").alias("beat"))
    state = F.when(F.col("beat") > F.lit("2024-01-29 20:00:00").cast("timestamp"), "active").otherwise("dead")
    jobs = e.select(F.col("event_type").alias("job_id")).distinct().union(spark.createDataFrame([("idle",)], "job_id string"))
    return claims.job_workers(jobs, seen.withColumn("state", state))


def notices(spark: SparkSession, sf: str) -> DataFrame:
    """Sites after cease-and-desist notices: every notice also blocks its site, so that the list is the basis."""
    p = table(spark, sf, "pages").select(U.domain("url").alias("domain")).distinct()
    given = p.where(F.col("domain").startswith("m.")).select(F.upper("domain").alias("domain"), F.lit("2024-02-01").cast("date").alias("received"), F.lit("R-1").alias("reference"))
    given = given.union(given.select("domain", F.lit("2024-01-01").cast("date"), F.lit("R-0")))
    block, records = compliance.record_notices(spark.createDataFrame([("www.example.org",)], "domain string"), given)
    hit = compliance.blocked_domain(p.withColumn("key", F.col("domain")), block)
    basis = F.when(F.col("blocked"), "blocklist").otherwise("public_access")
    return hit.select("domain", basis.alias("basis")).join(records.select("domain", "received", "notes"), "domain", "left")


def block_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that were not fetched, by site and reason."""
    return metrics.blocked(C.decided(spark, sf).select("domain", "basis", "allowed"))


def fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log of all fetches by kind of event."""
    d = C.decided(spark, sf).select("url", "domain", "basis", "allowed", C.C.gate(U.is_private("url"), F.col("basis"), F.col("allowed")).alias("status"))
    return metrics.log(d).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def gauges(spark: SparkSession, sf: str) -> DataFrame:
    """The latest value, the number of values and of errors of each user's gauge."""
    e = table(spark, sf, "events")
    return metrics.gauges(e.select(F.col("user_id").cast("string").alias("name"), F.struct("ts", "event_id").alias("at"), "value", (F.col("event_type") == "error").alias("failed")))


def histograms(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of document lengths by language, and their sum and count."""
    d = table(spark, sf, "documents")
    return metrics.histogram(d, ["lang"], F.col("n_chars").cast("double"), [100, 500, 1000, 5000, 10000, 50000, 100000])


def schedule_status(spark: SparkSession, sf: str) -> DataFrame:
    """Schedules in all, enabled and due at a fixed time; a schedule is a user's last event, enabled unless that is an error."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("next_run"), (F.max_by("event_type", F.struct("ts", "event_id")) != "error").alias("enabled"))
    return metrics.schedules(last, F.lit("2024-01-30 12:00:00").cast("timestamp"))


def store_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A store of structures in numbers: saved, sites, kinds of pages, those with an embedding, and the last save."""
    p = table(spark, sf, "pages").select(U.domain("url").alias("domain"), U.classify(F.col("url"), U.PAGE_TYPES, "general").alias("page_type"), "page_id")
    return metrics.store_totals(p.withColumn("embedded", F.col("page_id") % 2 == 0), "page_id")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as a graph: each leads to those of twice and thrice its id."""
    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("url"), F.explode(F.array(F.col("page_id") * 2, F.col("page_id") * 3)).alias("t"))
    return p.select("url", F.col("t").cast("string").alias("target"))


def crawl_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by their distance from the second, at most six."""
    seeds = spark.createDataFrame([("1",)], "url string")
    return frontier.crawl(seeds, _links(spark, sf), 6, frontier.shared_cut)


def sitemap_index(spark: SparkSession, sf: str) -> DataFrame:
    """Pages found from an index of sitemaps: index files list index files that list the sites' sitemaps."""
    p = table(spark, sf, "pages").select("url", F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.lit("/sitemap.xml")).alias("file"))
    entry = lambda at, kind, loc: (at.alias("sitemap_url"), F.lit(kind).alias("kind"), loc.alias("loc"))
    files = p.select("file").distinct()
    shard = F.concat(F.lit("http://index/"), F.pmod(F.xxhash64("file"), F.lit(3)).cast("string"))
    parsed = p.select(*entry(F.col("file"), "url", F.col("url"))).union(files.select(*entry(shard, "sitemap", F.col("file"))))
    parsed = parsed.union(files.select(*entry(F.lit("http://index/"), "sitemap", shard)).distinct()).union(files.limit(1).select(*entry(F.lit("http://index/0"), "sitemap", F.lit("http://index/"))))
    starts = spark.createDataFrame([("http://index/",)], "url string")
    return sitemap.follow(starts, parsed, cut=frontier.shared_cut).groupBy("sitemap_url").agg(F.count(F.lit(1)).alias("n"))


def crawl_delay_waits(spark: SparkSession, sf: str) -> DataFrame:
    """Waits under the delays that sites ask for, which override the adaptive ones: a site (user) of an even id asks for 30 seconds."""
    e = table(spark, sf, "events").where("event_type <> 'error' and event_type <> 'purchase'")
    rows = e.select("event_id", F.col("user_id").cast("string").alias("domain"), "ts", F.lit(False).alias("failed"), F.lit(False).alias("limited"), F.lit(500.0).alias("ms"), F.when(F.col("user_id") % 2 == 0, 30.0).otherwise(0.1).alias("crawl_delay"))
    return limits.replay(rows).select("event_id", "wait")


_LOG = "(SELECT CAST(user_id AS VARCHAR) AS url, ts, event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " ELSE 'add' END AS kind, concat('w', event_id % 4) AS worker, CASE WHEN value > 50 THEN 'timeout' END AS error FROM events)"
_STATES = f"""(SELECT url, CASE WHEN kind IS NULL THEN 'queued' WHEN kind = 'claim' THEN 'processing' WHEN kind = 'complete' THEN 'completed' WHEN attempts = 0 OR attempts >= 40 THEN 'failed' ELSE 'queued' END AS state, attempts, worker, error
  FROM (SELECT url, count(*) FILTER (kind = 'claim') AS attempts FROM {_LOG} GROUP BY 1) LEFT JOIN (SELECT url, kind, worker, error FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS k FROM {_LOG} WHERE kind <> 'add') WHERE k = 1) USING (url))"""
_CLAIMED = f"""SELECT url, CASE WHEN r <= 10 THEN 'processing' ELSE state END AS state, attempts + CASE WHEN r <= 10 THEN 1 ELSE 0 END AS attempts, CASE WHEN r <= 3 THEN 'a' WHEN r <= 4 THEN 'b' WHEN r <= 8 THEN 'c' WHEN r <= 10 THEN 'd' END AS worker FROM (
  SELECT *, CASE WHEN state = 'queued' THEN row_number() OVER (PARTITION BY state ORDER BY score, url) END AS r FROM (SELECT CAST(page_id AS VARCHAR) AS url, CASE WHEN page_id % 7 = 0 THEN 'completed' ELSE 'queued' END AS state, page_id % 3 AS attempts,
    round((1 - priority) * 1e6 + depth * 1000 + page_id, 6) AS score FROM {crawl.PRIO}))"""
QUERIES = {f.__name__: f for f in (
    claim_states, claim_totals, claim_next, job_workers, notices, block_counters, fetch_log, gauges, histograms, schedule_status, store_totals, crawl_reach, sitemap_index, crawl_delay_waits)}
ORACLE_SQL = {
    "claim_states": f"SELECT url, state, attempts, CASE WHEN state = 'processing' THEN worker END AS worker, CASE WHEN state = 'failed' THEN coalesce(error, 'Max retries exceeded') END AS error FROM {_STATES}",
    "claim_totals": f"SELECT right(url, 1) AS domain, count(*) FILTER (state = 'completed') AS pages_crawled, count(*) FILTER (state = 'failed') AS pages_failed, count(*) FILTER (state IN ('queued', 'processing')) AS pages_left, CAST(sum(attempts) AS BIGINT) AS attempts FROM {_STATES} GROUP BY 1",
    "claim_next": _CLAIMED,
    "job_workers": """SELECT job_id, count(worker) AS workers, count(*) FILTER (beat > TIMESTAMP '2024-01-29 20:00:00') AS active FROM (SELECT DISTINCT event_type AS job_id FROM events UNION ALL SELECT 'idle') LEFT JOIN (
      SELECT event_type AS job_id, user_id AS worker, max(ts) AS beat FROM events GROUP BY ALL) USING (job_id) GROUP BY 1""",
    "notices": f"""SELECT domain, CASE WHEN domain LIKE 'm.%' OR domain = 'www.example.org' OR domain LIKE '%.www.example.org' OR exists(SELECT 1 FROM (SELECT DISTINCT domain AS d FROM (SELECT {PARTS} FROM pages) WHERE domain LIKE 'm.%') WHERE ends_with(p.domain, '.' || d)) THEN 'blocklist' ELSE 'public_access' END AS basis,
      CASE WHEN domain LIKE 'm.%' THEN DATE '2024-02-01' END AS received, CASE WHEN domain LIKE 'm.%' THEN 'Reference: R-1' END AS notes FROM (SELECT DISTINCT domain FROM (SELECT {PARTS} FROM pages)) p""",
    "block_counters": f"SELECT domain, CASE WHEN basis NOT IN ('explicit_permission', 'public_access') THEN basis ELSE 'robots' END AS reason, count(*) AS n FROM ({C.AUTH}) JOIN (SELECT page_id, domain FROM (SELECT page_id, {PARTS} FROM pages)) USING (page_id) WHERE basis NOT IN ('explicit_permission', 'public_access') OR NOT allowed GROUP BY ALL",
    "fetch_log": f"""WITH s AS (SELECT CASE WHEN basis NOT IN ('explicit_permission', 'public_access') THEN 'blocked_legal' WHEN NOT allowed THEN 'blocked_robots' ELSE 'success' END AS status FROM ({C.AUTH}))
      SELECT event, count(*) AS n FROM (SELECT unnest(['fetch_start', 'robots_check', CASE WHEN status = 'success' THEN 'fetch_success' ELSE 'fetch_blocked' END]) AS event FROM s) GROUP BY 1""",
    "gauges": "SELECT CAST(user_id AS VARCHAR) AS name, arg_max(value, {'t': ts, 'i': event_id}) AS latest, count(*) AS n_values, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "histograms": "SELECT lang, le, count(*) FILTER (n_chars <= le) AS n, count(n_chars) AS total, round(sum(n_chars), 4)::DOUBLE AS sum_value FROM documents, (SELECT unnest([100, 500, 1000, 5000, 10000, 50000, 100000])::DOUBLE AS le) GROUP BY ALL",
    "schedule_status": "SELECT count(*) AS total, count(*) FILTER (e) AS enabled, count(*) FILTER (e AND t <= TIMESTAMP '2024-01-30 12:00:00') AS due FROM (SELECT max(ts) AS t, arg_max(event_type, {'t': ts, 'i': event_id}) <> 'error' AS e FROM events GROUP BY user_id)",
    "store_totals": f"SELECT count(*) AS saved, count(DISTINCT domain) AS domains, count(DISTINCT (domain, page_type)) AS page_types, count(DISTINCT (domain, page_type)) FILTER (page_id % 2 = 0) AS embedded, max(page_id) AS last_save FROM {crawl.TYPED}",
    "crawl_reach": """WITH RECURSIVE r AS (SELECT 1::BIGINT AS id, 0 AS d UNION SELECT id * f, d + 1 FROM r, (SELECT unnest([2, 3]) AS f) WHERE d < 6 AND id IN (SELECT page_id FROM pages)) SELECT CAST(id AS VARCHAR) AS url, min(d) AS depth FROM r GROUP BY 1""",
    "sitemap_index": "SELECT concat(regexp_extract(url, '^([a-z]+://[^/]+)', 1), '/sitemap.xml') AS sitemap_url, count(*) AS n FROM pages GROUP BY 1",
    "crawl_delay_waits": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, CASE WHEN user_id % 2 = 0 THEN 30.0 ELSE 0.5 END::DOUBLE AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type NOT IN ('error', 'purchase')),
      r AS (SELECT event_id, user_id, k, t AS last, 0.0::DOUBLE AS wait FROM e WHERE k = 1 UNION ALL
        SELECT e.event_id, e.user_id, e.k, greatest(e.t, r.last) + greatest(0.0, e.d - (greatest(e.t, r.last) - r.last)), greatest(0.0, e.d - (greatest(e.t, r.last) - r.last)) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
      SELECT event_id, round(wait, 6) AS wait FROM r""",
}
