"""Ranks and running sums over a whole table, and its first n rows, without one task for all of it.

A range partitioning deals rows out in order; sums over partitions, of which there are as many as partitions, say where
each of them starts; and rows are numbered inside their partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.sources import shared


def numbered(rows: DataFrame, order: list[str], name: str = "rank", weight: Column | None = None) -> DataFrame:
    """`rows` with the running sum of `weight` (1 for a rank from 1) in `order`, ties in any order. A null weight counts as 0.

    Many rows of one value in all columns of `order` are one partition.
    """
    weight = F.lit(1) if weight is None else weight
    spread = rows.withColumn("_w", F.coalesce(weight.cast("long"), F.lit(0))).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    spread = shared.written(spread)  # two evaluations of a range partitioning need not agree
    total, starts = 0, []
    for part, n in sorted(tuple(r) for r in spread.groupBy("_part").agg(F.sum("_w")).collect()):  # a row per partition
        starts.append((part, total))
        total += n
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _start long"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = spread.withColumn("_sum", F.sum("_w").over(inside)).join(start, "_part")
    return done.withColumn(name, F.col("_start") + F.col("_sum")).drop("_w", "_part", "_start", "_sum")


def leading(rows: DataFrame, n: int, order: list[str], name: str = "rank") -> DataFrame:
    """The first n of `rows` in `order` (nulls first) with their rank from 1.

    A quantile of the first column in `order`, which must be a number, bounds the rows that may be among them; only these are
    dealt out and ranked. The bound is checked by a count, and raised until it leaves n rows or all.
    """
    first, total = F.col(order[0]), rows.count()
    share = n / total if total else 1.0
    some = rows
    while n > 0 and 0 < share < 0.5:
        share = min(1.0, 1.1 * share + 0.001)
        bound = rows.agg(F.percentile_approx(first, share, 10_000)).first()[0]
        if bound is not None:
            some = rows.where(first.isNull() | (first <= F.lit(bound)))
            if some.count() >= n:
                break
        share, some = share * 2, rows
    return numbered(some, order, name).where(F.col(name) <= n) if n > 0 else rows.withColumn(name, F.lit(0).cast("long")).where("false")
