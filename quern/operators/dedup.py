"""Content fingerprints and the Hamming join.

Of d + s even blocks of the hash, hashes within Hamming distance d agree in s at least (pigeonhole), so an equi-join on
every choice of s blocks finds every pair. More spare blocks make longer keys and more tables; s is set by the number of
hashes, so that buckets stay small as the corpus grows. Equal hashes are one row before the join.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb, isqrt

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import text as T


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, simhash, md5, word_count and char_count of the normalized text."""
    rows = docs.select(key, T.normalize(F.col(text)).alias("t")).select(key, "t", T.words(F.col("t")).alias("w"))
    return rows.select(key, T.simhash(F.col("t")).alias("simhash"), F.md5("t").alias("md5"), F.size("w").alias("word_count"), F.length("t").alias("char_count"))


def block_masks(distance: int, spare: int) -> list[int]:
    """Masks (as signed longs) of all choices of `spare` of the hash's `distance` + `spare` blocks."""
    n = distance + spare
    edge = [64 * i // n for i in range(n + 1)]
    block = [sum(1 << b for b in range(x, y)) for x, y in zip(edge, edge[1:])]
    masks = [sum(c) for c in combinations(block, spare)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def spare_blocks(distance: int, n: int) -> int:
    """The spare blocks, one to three, of least cost: rows that tables hold and pairs that buckets of even size compare."""
    cost = lambda s: comb(distance + s, s) * (20 * n + n * n / 2 ** (64 * s / (distance + s)))
    return min(range(1, 4), key=cost)


def _keyed(hashes: DataFrame, name: str, distance: int, spare: int) -> DataFrame:
    """Rows (`name`, skipped, v) of each hash: its bits v under every choice of blocks, and the blocks that the choice
    skips below its last one (as a set of bits), which name the choice."""
    skipped = [sum(1 << i for i in range(c[-1]) if i not in c) for c in combinations(range(distance + spare), spare)]
    tables = [F.struct(F.lit(t).cast("long").alias("t"), F.lit(m).cast("long").alias("m")) for t, m in zip(skipped, block_masks(distance, spare), strict=True)]
    return hashes.select(F.col("simhash").alias(name), F.explode(F.array(*tables)).alias("k")).select(name, F.col("k.t").alias("skipped"), F.col(name).bitwiseAND(F.col("k.m")).alias("v"))


def _alike(x: Column, n: int) -> Column:
    """The blocks, of n, in which two hashes of difference x agree, as a set of bits."""
    return reduce(Column.bitwiseOR, [F.shiftleft((x.bitwiseAND(F.lit(m)) == 0).cast("long"), i) for i, m in enumerate(block_masks(n - 1, 1))])


#: Rows of a side of the join up to which it is broadcast.
SMALL = 262144


def hamming_pairs(hashes: DataFrame, distance: int, spare: int | None = None, others: DataFrame | None = None) -> DataFrame:
    """Pairs of different hashes (a < b) of `hashes` (simhash) within the distance, with it as `d`; with `others`, pairs of a
    hash a of `hashes` and a hash b of `others`, equal ones included. Exact.

    A pair counts in the first table only in which it meets. Exploded rows are many times what the optimizer takes them for,
    so the join says itself what is shuffled and what is broadcast.
    """
    one = hashes.select("simhash").where("simhash is not null").distinct()
    two = one if others is None else others.select("simhash").where("simhash is not null").distinct()
    n = one.count()
    m = n if others is None else two.count()
    spare = spare or spare_blocks(distance, isqrt(n * m))
    left, right = _keyed(one, "a", distance, spare), _keyed(two, "b", distance, spare)
    right = F.broadcast(right) if others is not None and m * comb(distance + spare, spare) <= SMALL else right.hint("merge")
    x = F.col("a").bitwiseXOR(F.col("b"))
    d = F.bit_count(x)
    pairs = left.join(right, ["v", "skipped"]).where(d <= distance).where(_alike(x, distance + spare).bitwiseAND(F.col("skipped")) == 0)
    return (pairs.where("a < b") if others is None else pairs).select("a", "b", d.alias("d"))


def near_duplicates(prints: DataFrame, key: str = "doc_id", least: float = 0.85) -> DataFrame:
    """Classes of equal hashes and the linked hashes of each: key, simhash, copies and n_near (other hashes near it)."""
    distance = int(64 * (1 - least) + 1e-9)
    copies = prints.groupBy("simhash").agg(F.count(F.lit(1)).alias("copies"))
    pairs = hamming_pairs(copies, distance)
    near = pairs.select(F.explode(F.array("a", "b")).alias("simhash")).groupBy("simhash").agg(F.count(F.lit(1)).alias("n_near"))
    out = prints.select(key, "simhash").join(copies, "simhash").join(near, "simhash", "left")
    return out.select(key, "simhash", "copies", F.coalesce("n_near", F.lit(0)).alias("n_near"))
