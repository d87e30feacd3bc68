"""Counters, gauges, histograms and logs of a crawl as aggregates; each in one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bases of authorization that let a fetch go on.
OPEN = ("explicit_permission", "public_access")


def blocked(rows: DataFrame) -> DataFrame:
    """Fetches that weren't made, of `rows` (domain, basis, allowed), by domain and reason: the basis of the refusal, or robots
    where the site is permitted; unknown where neither is known."""
    reason = F.when(~F.col("basis").isin(*OPEN), F.col("basis")).when(~F.col("allowed"), "robots").when(F.col("basis").isNull(), "unknown")
    return rows.withColumn("reason", reason).where("reason is not null").groupBy("domain", "reason").agg(F.count(F.lit(1)).alias("n"))


def personal(matches: DataFrame, action: str) -> DataFrame:
    """Matches of personal data (pii_type) by kind, with what is done about them."""
    return matches.groupBy("pii_type").agg(F.count(F.lit(1)).alias("n")).withColumn("action", F.lit(action))


def log(fetches: DataFrame) -> DataFrame:
    """The events that a log would have of each of `fetches` (url, domain, status, basis, allowed): its start, the robots check
    and its end. An append-only table is the sink."""
    done = F.when(F.col("status") == "success", "fetch_success").when(F.col("status").startswith("blocked"), "fetch_blocked").otherwise("fetch_error")
    detail = F.to_json(F.struct("status", "basis", "allowed"))
    return fetches.select("url", "domain", F.posexplode(F.array(F.lit("fetch_start"), F.lit("robots_check"), done)).alias("step", "event"), detail.alias("detail"))


def gauges(rows: DataFrame) -> DataFrame:
    """The latest value by `at` of each gauge of `rows` (name, at, value, failed), with how often it was set and how often it failed."""
    return rows.groupBy("name").agg(F.max_by("value", "at").alias("latest"), F.count(F.lit(1)).alias("n_values"), F.count_if("failed").alias("errors"))


def histogram(rows: DataFrame, by: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative buckets of a value (le, n) by key, with total and sum: counted in one pass, spread afterwards."""
    counted = rows.groupBy(*by).agg(*[F.count_if(value <= b).alias(f"_b{i}") for i, b in enumerate(bounds)], F.count(value).alias("total"), F.round(F.sum(value), 4).alias("sum_value"))
    spread = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("h")
    return counted.select(*by, spread, "total", "sum_value").select(*by, "h.le", "h.n", "total", "sum_value")


def schedules(rows: DataFrame, now: Column) -> DataFrame:
    """Schedules (enabled, next_run) in all, enabled and due."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(F.col("enabled") & (F.col("next_run") <= now)).alias("due"))


def store_totals(rows: DataFrame, at: str) -> DataFrame:
    """A store (domain, page_type, embedded, `at`) in numbers."""
    key = F.struct("domain", "page_type")
    return rows.agg(
        F.count(F.lit(1)).alias("saved"), F.count_distinct("domain").alias("domains"), F.count_distinct(key).alias("page_types"), F.count_distinct(F.when(F.col("embedded"), key)).alias("embedded"), F.max(at).alias("last_save"))
