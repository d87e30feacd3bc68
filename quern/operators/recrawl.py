"""Rounds of recrawling: what is due is handed to a function of the user's, and its answer becomes the next plan and a history.

A plan is a row (target, cron, enabled, next_run, last_run, last_change, runs, failures); plans are what `control.schedules` leaves
of a log of commands, brought up to date by `merged`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import schedule as S
from quern.operators.frontier import shared_cut

PLAN = {"target": "string", "cron": "string", "enabled": "boolean", "next_run": "timestamp", "last_run": "timestamp", "last_change": "timestamp", "runs": "bigint", "failures": "bigint"}
ANSWER = "target string, changed boolean, error string"


def _next(rows: DataFrame, after: Column) -> DataFrame:
    """`rows` with next_run after a time by their cron."""
    return S.next_run(rows.drop("next_run").withColumn("after", after)).drop("after")


def merged(plans: DataFrame | None, schedules: DataFrame, at: Column) -> DataFrame:
    """The plans of `schedules` (target unique, cron, enabled) at a time: those known keep their history, and their next run while the cron
    is the same; others are new; known plans without a schedule are gone. A schedule without a cron is never due."""
    now = schedules.select("target", "cron", "enabled")
    if plans is None:
        known = now.select("target", *[F.lit(None).cast(t).alias(f"_{c}") for c, t in PLAN.items() if c != "target"]).where("false")
    else:
        known = plans.select("target", *[F.col(c).cast(t).alias(f"_{c}") for c, t in PLAN.items() if c != "target"])
    both = _next(now.join(known, "target", "left"), at)
    same = F.col("cron") == F.col("_cron")
    zero = lambda c: F.coalesce(f"_{c}", F.lit(0).cast("bigint")).alias(c)
    when = F.when(F.col("cron").isNotNull(), F.when(same, F.coalesce("_next_run", "next_run")).otherwise(F.col("next_run")))
    return both.select("target", "cron", "enabled", when.alias("next_run"), F.col("_last_run").alias("last_run"), F.col("_last_change").alias("last_change"), zero("runs"), zero("failures"))


def run(plans: DataFrame, at: Column, call: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame] = shared_cut) -> tuple[DataFrame, DataFrame]:
    """One round: the plans after it, and its runs (target, at, success, changed, error).

    `call` gets the enabled plans that are due at the time and returns (target, changed, error) for them, error null where all went well;
    a target that it leaves out has failed. Its answer is written once, so that its effects don't happen again when results are read.
    A run moves next_run to the first time after `at`, however many were missed.
    """
    due = F.coalesce(F.col("enabled") & (F.col("next_run") <= at), F.lit(False))
    given = call(plans.where(due)).select(F.col("target"), F.col("changed").cast("boolean").alias("changed"), F.col("error").cast("string").alias("error"))
    answer = cut(given.groupBy("target").agg(F.bool_or("changed").alias("_changed"), F.max("error").alias("_error"), F.lit(True).alias("_answered")))
    both = plans.withColumn("_due", due).join(answer, "target", "left")
    error = F.when(F.col("_answered").isNull(), "no answer").otherwise(F.col("_error"))
    both = both.withColumn("_error", F.when(F.col("_due"), error)).withColumn("_ok", F.col("_due") & F.col("_error").isNull())
    both = both.withColumn("_changed", F.col("_ok") & F.coalesce("_changed", F.lit(False))).withColumn("_was", F.col("next_run"))
    after = _next(both, at)
    one = lambda c: F.when(c, 1).otherwise(0)
    done = after.select(
        "target", "cron", "enabled", F.when(F.col("_due"), F.col("next_run")).otherwise(F.col("_was")).alias("next_run"), F.when(F.col("_due"), at).otherwise(F.col("last_run")).alias("last_run"),
        F.when(F.col("_changed"), at).otherwise(F.col("last_change")).alias("last_change"), (F.col("runs") + one(F.col("_due"))).alias("runs"), (F.col("failures") + one(F.col("_due") & ~F.col("_ok"))).alias("failures"))
    runs = both.where("_due").select("target", at.alias("at"), F.col("_ok").alias("success"), F.col("_changed").alias("changed"), F.col("_error").alias("error"))
    return done, runs


def by_target(call: Callable[[str, dict], object]) -> Callable[[DataFrame], DataFrame]:
    """A function of one target and its plan, as a dict, called where the rows are; something true means that the target has changed, an
    exception that the run failed. It may be called again for a target if an executor is lost."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                try:
                    out.append((r["target"], bool(call(r["target"], r)), None))
                except Exception as e:  # noqa: BLE001 - one target's failure is a result, not the job's
                    out.append((r["target"], False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["target", "changed", "error"])

    return lambda due: due.mapInPandas(each, ANSWER)
