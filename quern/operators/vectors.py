"""Exact vector search and drift over an `embeddings` table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quern.functions import text as T


#: Queries in a block, and at most so many blocks of the corpus.
BLOCK, BLOCKS = 512, 256


def top_k(queries: DataFrame, corpus: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """The k nearest rows by cosine of each of a stated set of queries (vec_id, embedding), ties by vec_id.

    Queries and corpus are dealt to blocks and blocks compared with blocks by one matrix product, which keeps k rows of
    each query; nothing is broadcast, and a cell's size doesn't grow with the tables.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    parts = max(1, min(BLOCKS, -(-corpus.count() // 4096)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("i"), each(parts).alias("j"))
    c = corpus.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), each(blocks).alias("m"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("n"))

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = np.array(column.to_pylist(), dtype=np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids, mine = right["id"].to_numpy(), left["vec_id"].to_numpy()
            score = np.round(unit(left["embedding"]) @ unit(right["vector"]).T, 6) + 0.0
            for row, query in zip(score, mine, strict=True):
                ok = ids != query if least is None else (ids != query) & (row >= least)
                at = np.flatnonzero(ok)
                at = at[np.lexsort((ids[at], -row[at]))[:k]]
                out += zip([int(query)] * len(at), ids[at].tolist(), row[at].tolist(), strict=True)
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    pairs = q.groupBy("i", "j").cogroup(c.groupBy("m", "n")).applyInArrow(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def drift(current: DataFrame, baseline: DataFrame, key: str, least: float = 0.85) -> DataFrame:
    """Cosine of each current row with its key's baseline; status ok, drifted, or error where there is none."""
    pairs = current.join(baseline.select(key, F.col("embedding").alias("base")), key, "left")
    score = F.round(T.cosine(F.col("base"), F.col("embedding")), 6)
    return pairs.select("vec_id", key, score.alias("score")).withColumn(
        "status", F.when(F.col("score").isNull(), "error").when(F.col("score") < least, "drifted").otherwise("ok"))


#: Rows that may be compared all with all on the driver's request: labels, types or sites, never documents.
FEW = 2000


def pairs(rows: DataFrame, key: str) -> DataFrame:
    """All pairs (a, b) of the keys of a small table, which is counted first; other columns come as x_ and y_."""
    n = rows.count()
    if n > FEW:
        raise ValueError(f"{n} rows are too many for all pairs; use top_k")
    rest = [c for c in rows.columns if c != key]
    left = rows.select(F.col(key).alias("a"), *[F.col(c).alias(f"x_{c}") for c in rest])
    return left.join(F.broadcast(rows.select(F.col(key).alias("b"), *[F.col(c).alias(f"y_{c}") for c in rest])), F.lit(True))


def matrix(rows: DataFrame, key: str, values: list, prefix: str) -> DataFrame:
    """Cosines of the embeddings of a small table as a matrix: a row for each key `a`, a column for each of `values`."""
    both = pairs(rows.select(key, "embedding"), key)
    score = F.round(T.cosine(F.col("x_embedding"), F.col("y_embedding")), 6)
    wide = both.groupBy("a").pivot("b", values).agg(F.max(score))
    return wide.select("a", *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])
