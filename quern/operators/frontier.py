"""Frontier ranking, admission and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions import url as U


def pop_score(priority: Column, depth: Column) -> Column:
    """Of the per-domain queue; the least comes first."""
    return -priority + 0.001 * depth


def claim_score(priority: Column, depth: Column, seconds: Column) -> Column:
    """Of the global queue; the least comes first, and a tenth of priority weighs as much as a day and four hours of age."""
    return (1 - priority) * 1e6 + depth * 1000 + seconds


def adjust(priority: Column, boosts: list[Column], depth: Column) -> Column:
    """Plus 0.2 for each boost, at most 1, less a twentieth per level of depth, within 0.1 and 1."""
    for b in boosts:
        priority = F.when(b, F.least(F.lit(1.0), priority + 0.2)).otherwise(priority)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), priority * (1 - depth * 0.05)))


def discovered_priority(url: Column, depth: Column, boosts: list[Column]) -> Column:
    """A discovered link is adjusted twice: when its priority is set and when it is added."""
    base = F.when(F.lower(url).rlike("/article|/post|/news|/blog"), 0.7).otherwise(0.5)
    return adjust(adjust(base, boosts, depth), boosts, depth)


def retry_priority(priority: Column, retries: Column) -> Column:
    return priority * F.pow(F.lit(0.5), retries)


def pop(frontier: DataFrame, n: int, by: str = "domain") -> DataFrame:
    """The first n entries (url, `by`, score) of each queue, ties by url."""
    order = Window.partitionBy(by).orderBy("score", "url")
    return frontier.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def admit(links: DataFrame, seen: DataFrame, *, max_depth: int, allowed: list[str], cap: int) -> DataFrame:
    """Links (url, norm_url, domain, depth, score) not deeper than max_depth, of an allowed domain or a subdomain, unseen,
    one per normalized address, and at most `cap` per domain."""
    ok = F.lit(not allowed)
    for d in allowed:
        ok = ok | (F.col("domain") == d) | F.col("domain").endswith("." + d)
    rows = links.where((F.col("depth") <= max_depth) & ok).join(seen.select("norm_url").distinct(), "norm_url", "left_anti")
    first = rows.groupBy("domain", "norm_url").agg(F.min_by(F.struct("url", "depth", "score"), F.struct("score", "url")).alias("r")).select("domain", "norm_url", "r.*")
    return pop(first, cap).drop("rank")


def shared_cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder; the session must have one (spark.checkpoint.dir)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir", "")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int, cut) -> DataFrame:
    """Breadth-first reach over an edge table (url, target): (url, depth) of everything within max_depth of the seeds.

    Each level joins only the newest addresses; `cut` breaks the lineage (`shared_cut` on a cluster).
    """
    done = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    front = done
    for depth in range(1, max_depth + 1):
        step = links.join(front.select("url"), "url").select(F.col("target").alias("url")).distinct()
        front = cut(step.join(done.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        done = done.union(front)
    return done
