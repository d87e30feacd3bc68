"""What is written to the folder that all executors share (spark.checkpoint.dir) and read again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; an error where there is none, as no other folder is known to be shared."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc.getConf().get("spark.checkpoint.dir", "")
        if not where:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: computed once, however often it is used."""
    path = fresh(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state variables and timers need."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


def drained(stream: DataFrame, at: str | None = None) -> DataFrame:
    """The rows that a stream in append mode gives for what its sources hold now, from files under `at` (else a fresh path).

    Output and checkpoint stay there, so that another call with the same `at` goes on where this one, or one that was killed,
    has ended; the file sink commits a batch as a whole, once.
    """
    spark = stream.sparkSession
    at = at or fresh(spark, "stream")
    writer: DataStreamWriter = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint")
    with rocksdb(spark):
        query = writer.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
