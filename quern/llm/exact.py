"""Exact duplicates with a split of heavy hitters. DataFrame operations only.

Texts become digests once, in a small table. Misra-Gries counters find the digests that may hold more than a given share
of all rows; exact counts of these verify them, and their winners are broadcast, so that their rows never move. Only
the other digests are shuffled, and none of those has more rows than that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.common import cut, need, read, written

#: Runs of blank, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """A text with each run of white space as one blank; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def heavy_hitters(rows: DataFrame, key: str, support: float) -> DataFrame:
    """Values of the binary column `key` that may make up more than `support` of the rows: at most 1 / support of them.

    Spark's frequent-items aggregate keeps Misra-Gries counters, at most 1 / support per task and in the end.
    """
    found = rows.select(F.hex(key).alias("k")).stat.freqItems(["k"], support)
    return found.select(F.explode("k_freqItems").alias("k")).select(F.unhex("k").alias(key))


def exact_duplicates(docs: DataFrame, *, support: float = 0.001) -> DataFrame:
    """One row per document: doc_id, keep_id (doc_id of the row that stays), group_size, kept, digest (SHA-256 of the text).

    Texts are equal when they are after `normalised`. Of equal texts the row of least doc_id stays; rows without doc_id come
    after all others, and of several rows with one doc_id the first as read stays, so that a group keeps exactly one row.
    A null text is an empty one, and texts of nothing but white space are one group, apart from empty ones. Very long texts
    are hashed whole. Repeated rows are rows of their own. An empty table gives no rows; other columns are ignored.
    """
    docs = need(docs, doc_id="long", text="string")
    rows = written(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    group = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size")
    maybe = F.broadcast(heavy_hitters(rows, "digest", support))
    most = support * rows.count()
    # At most 1 / support rows, as each has more than that share of all.
    heavy = cut(rows.join(maybe, "digest", "left_semi").groupBy("digest").agg(*group).where(F.col("group_size") > most))
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*group), "digest")
    return hot.unionByName(cold).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest",
    )


def op13_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact_duplicates(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
