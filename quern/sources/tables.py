"""Readers for the driver's parquet tables; every read goes through Spark so any Hadoop path works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a page that are read; a longer one is refused.
MAX_PAGE = 10 * 1024 * 1024


def decoded(body: Column) -> Column:
    """Bytes as UTF-8, with the replacement character for what isn't."""
    return F.make_valid_utf8(body.cast("string"))


def fetched(responses: DataFrame, most: int = MAX_PAGE) -> DataFrame:
    """Stored responses (url, status_code, body binary, ...) as pages: html and status, success or error_content_too_large
    (then without html). Answers other than 200 are successes, as they are for a fetcher."""
    large = F.coalesce(F.length("body"), F.lit(0)) > most
    return responses.withColumn("html", F.when(~large, decoded(F.col("body")))).withColumn("status", F.when(large, "error_content_too_large").otherwise("success")).drop("body")
