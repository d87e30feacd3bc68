"""Claims of addresses by workers: what their log leaves of each address, and the next claims, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.operators import ranking


def task_states(log: DataFrame, max_attempts: int = 3) -> DataFrame:
    """The state of each address after `log` (url, seq, kind, worker, error), kind 'add', 'claim', 'complete' or 'fail':
    url, state, attempts, worker (of a claim that is open), error (of an address given up).

    A claim is an attempt. After a failure an address is queued again while it had fewer than `max_attempts`, else it has
    failed; a failure without a claim fails at once. Adding an address again changes nothing, save that of one that
    was completed or failed it makes no task.
    """
    last = F.max_by(F.struct("kind", "worker", "error"), F.when(F.col("kind") != "add", F.col("seq")))
    per = log.groupBy("url").agg(F.count_if(F.col("kind") == "claim").alias("attempts"), last.alias("l"))
    kind = F.col("l.kind")
    over = (F.col("attempts") == 0) | (F.col("attempts") >= max_attempts)
    state = F.when(kind.isNull(), "queued").when(kind == "claim", "processing").when(kind == "complete", "completed").when(over, "failed").otherwise("queued")
    out = per.select("url", state.alias("state"), "attempts", F.when(state == "processing", F.col("l.worker")).alias("worker"), F.when(state == "failed", F.coalesce("l.error", F.lit("Max retries exceeded"))).alias("error"))
    return out


def claim(tasks: DataFrame, workers: DataFrame, at) -> DataFrame:
    """`tasks` (url, state, attempts, score) with the first queued ones, by score and then url, claimed by the `workers`
    (worker, slots): as many as there are slots, in order of the workers' names. attempts counts the claim.

    Workers' slots are numbered by a running sum, the first tasks are ranked, and equal numbers meet: neither the queue nor the
    slots are ever one partition, and nothing is broadcast for being thought small.
    """
    ends = ranking.numbered(workers.where("slots > 0"), ["worker"], "last", F.col("slots"))
    slot = ends.select("worker", F.explode(F.sequence(F.col("last") - F.col("slots") + 1, "last")).alias("rank"))
    slots = workers.where("slots > 0").agg(F.sum("slots")).first()[0] or 0
    first = ranking.leading(tasks.where("state = 'queued'").select("url", "score"), slots, ["score", "url"])
    got = first.join(slot, "rank").select("url", "worker")
    out = tasks.drop("worker", "claimed_at").join(got, "url", "left")
    mine = F.col("worker").isNotNull()
    return out.withColumn("attempts", F.col("attempts") + mine.cast("int")).withColumn("state", F.when(mine, "processing").otherwise(F.col("state"))).withColumn("claimed_at", F.when(mine, at))


def domain_totals(states: DataFrame, domain) -> DataFrame:
    """Pages crawled, failed and still to come of each domain, from task states: a failure counts once it isn't tried again."""
    return states.groupBy(domain.alias("domain")).agg(
        F.count_if(F.col("state") == "completed").alias("pages_crawled"), F.count_if(F.col("state") == "failed").alias("pages_failed"),
        F.count_if(F.col("state").isin("queued", "processing")).alias("pages_left"), F.sum("attempts").alias("attempts"))


def job_workers(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """Jobs (job_id, ...) with the number of their workers and of those active, from `workers` (worker, job_id, state)."""
    per = workers.groupBy("job_id").agg(F.count(F.lit(1)).alias("workers"), F.count_if(F.col("state") == "active").alias("active"))
    return jobs.join(per, "job_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("workers", "active")})
