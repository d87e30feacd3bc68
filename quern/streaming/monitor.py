"""The monitor as a running stream: every micro-batch of visits is compared with what earlier ones have left.

A batch writes two folders named by its number: the records of the changes it found, and what is known of the keys it
saw. It reads only what batches before it wrote, and overwrites its own folders, so that a batch that is run again after
a crash gives the same rows once. What is known is a log of such folders with a full copy every `COPY` batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import lifecycle, structure

#: Batches between full copies of what is known: a batch reads at most so many folders of what is known.
COPY = 20
_STATE = ("key", "page_id", "hash", "known_version", *lifecycle.COLUMNS)


def known(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """What batches before `batch` know: the newest row of each key, or None before the first."""
    if not batch:
        return None
    first = (batch - 1) // COPY * COPY  # the last full copy
    log = spark.read.parquet(*[f"{path}/known/{k}" for k in range(first, batch)])
    newest = log.groupBy("key").agg(F.max("batch").alias("batch"))
    return log.join(newest, ["key", "batch"], "left_semi").select(*_STATE)


def step(batch: DataFrame, number: int, path: str, key: Callable, breaking: float = 0.70) -> None:
    """One batch of pages (page_id, url, html) under `path`; `key` gives the key of a page from its url column."""
    spark = batch.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}/{number}")
        return spark.read.parquet(f"{path}/{name}/{number}")

    shapes = structure.structures(batch).withColumn("hash", structure.monitor_fingerprint())
    rows = shapes.join(batch.select("page_id", key("url").alias("key")), "page_id").withColumn("known_version", F.lit(0))
    rows = kept(rows.select(F.col("page_id").alias("seq"), (F.monotonically_increasing_id() + 1).alias("row"), *_STATE), "parsed")  # pages are parsed once
    before = known(spark, path, number)
    if before is not None:
        mine = before.join(rows.select("key").distinct(), "key", "left_semi")
        rows = rows.unionByName(mine.withColumn("seq", F.lit(None).cast("long")).withColumn("row", F.lit(0).cast("long")))
    done = kept(lifecycle.visits(rows, breaking=breaking).where("n > 0"), "visits")
    last = done.groupBy("key").agg(F.max_by(F.struct("stored", "current_hash", "version"), "n").alias("s"))
    last = last.select("key", F.col("s.stored").alias("row"), F.col("s.current_hash").alias("hash"), F.col("s.version").alias("known_version"))
    new = last.join(rows.drop("seq", "hash", "known_version"), ["key", "row"]).select(*_STATE)
    if before is not None and number % COPY == 0:
        new = new.unionByName(before.join(last.select("key"), "key", "left_anti"))
    kept(new.withColumn("batch", F.lit(number)), "known")


def watch(pages: DataFrame, path: str, key: Callable, *, every: str | None = "1 minute", breaking: float = 0.70) -> StreamingQuery:
    """Starts the monitor over a stream of pages (page_id, url, html), a batch `every` so often; with None it ends once all pages
    that are there now have been seen. Started again with the same `path`, it goes on where it was stopped or killed."""
    writer = pages.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda batch, number: step(batch, number, path, key, breaking))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all changes found so far, as `lifecycle.monitor` gives them."""
    return spark.read.parquet(f"{path}/visits/*").where(F.col("change_type").isNotNull()).select(*lifecycle.RECORD)
