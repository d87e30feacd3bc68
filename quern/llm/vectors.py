"""What the vector operators share: valid rows, distinct vectors and Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def valid(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, v) with v array<double>: not null, not zero, only finite components, of the commonest length.

    Vectors of other lengths can't be compared and take no part, like the invalid ones; neither do null ids.
    """
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # one zero
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0)).dropDuplicates(["vec_id", "v"])


def distinct(rows: DataFrame, ids: int) -> DataFrame:
    """The different vectors of (vec_id, v): v, id (least), n (how many) and ids (the least `ids` of them, ascending).

    A vector that many rows share is cut to its first ids before the shuffle.
    """
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("k") <= ids)
    few = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    many = rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    return many.join(few, "v")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    edge = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(values.ravel()))
