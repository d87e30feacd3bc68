"""All pairs of weighted sets by similarity, without comparing all pairs. DataFrame operations only.

A bag (token to count) is a set of copies (token, 1), (token, 2) and so on, and the least over the greatest counts of two bags is
the Jaccard similarity of these sets. Two sets alike at t share one of the rarest copies of each (prefix filter), have sizes
within a factor of t (length filter), and must still have enough in common beyond that copy (position filter). Equal
bags are one bag before the join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions import text as T
from quern.sources import shared

#: Guards the ceilings below against rounding in the threshold.
TINY = 1e-9


def bag_key(bag: Column) -> Column:
    """A bag's identity: the hash of its sorted entries of a count above 0."""
    kept = F.array_sort(F.filter(F.map_entries(bag), lambda e: e["value"] > 0))
    return F.md5(F.to_json(kept))


def bags(rows: DataFrame, key: str, bag: str) -> tuple[DataFrame, DataFrame]:
    """(key, bag_id) of all rows, and the different bags (bag_id, copies, size, bag). A null bag is an empty one."""
    kept = F.map_filter(F.coalesce(F.col(bag), F.create_map().cast("map<string,int>")), lambda k, v: v > 0)
    named = shared.written(rows.select(key, kept.alias("bag")).withColumn("bag_id", bag_key(F.col("bag"))))
    size = F.aggregate(F.map_values("bag"), F.lit(0).cast("long"), lambda a, x: a + x)
    one = named.groupBy("bag_id").agg(F.count(F.lit(1)).alias("copies"), F.first("bag").alias("bag"))
    return named.select(key, "bag_id"), shared.written(one.select("bag_id", "copies", size.alias("size"), "bag"))


def prefixes(one: DataFrame, least: float) -> DataFrame:
    """The copies (bag_id, size, token, at) that a similar bag must share one of: the size - ceil(least * size) + 1 rarest of each
    bag, at being their place from 1."""
    copies = one.select("bag_id", "size", F.explode(F.map_entries("bag")).alias("e"))
    copies = copies.select("bag_id", "size", "e.key", F.explode(F.sequence(F.lit(1), "e.value")).alias("i"))
    # Of the copies of a token the last are the rarest, so how many bags have the i-th copy is a sum over larger counts.
    counts = one.select(F.explode(F.map_entries("bag")).alias("e")).groupBy("e.key", "e.value").agg(F.count(F.lit(1)).alias("n"))
    more = Window.partitionBy("key").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.select("key", "value", F.sum("n").over(more).alias("bags"), F.lag("value", -1, 0).over(Window.partitionBy("key").orderBy(F.desc("value"))).alias("below"))
    rare = steps.select("key", F.explode(F.sequence(F.col("below") + 1, "value")).alias("i"), "bags")
    ranked = copies.join(rare, ["key", "i"]).select("bag_id", "size", F.struct("bags", "key", (-F.col("i")).alias("i")).alias("token"))
    at = F.row_number().over(Window.partitionBy("bag_id").orderBy("token"))
    return ranked.withColumn("at", at).where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * least - TINY) + 1).select("bag_id", "size", F.xxhash64("token.key", "token.i").alias("token"), "at")


def candidates(prefix: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different bags that may be alike, once each. Tokens meet within bands of sizes, a factor of `least` wide."""
    of = lambda size: F.floor(F.log(size) / math.log(1 / least)) if least < 1 else size
    band = of(F.col("size"))
    right = prefix.select(F.col("bag_id").alias("b"), F.col("size").alias("m"), "token", F.col("at").alias("j"), band.alias("band"))
    reach = F.sequence(band, of(F.floor(F.col("size") / least + TINY)))  # up to the largest that a bag of this size is like
    left = prefix.select(F.col("bag_id").alias("a"), F.col("size").alias("n"), "token", F.col("at").alias("i"), F.explode(reach).alias("band"))
    n, m, i, j = (F.col(c) for c in "nmij")
    smaller = (n < m) | ((n == m) & (F.col("a") < F.col("b")))
    enough = F.ceil((n + m) * (least / (1 + least)) - TINY)
    common = F.least(i, j) + F.least(n - i, m - j)
    return left.join(right, ["token", "band"]).where(smaller & (n >= m * least - TINY) & (common >= enough)).select("a", "b").distinct()


def similar_bags(one: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of different, not empty bags with a `similarity` of `least` or more, which must be above 0."""
    if not 0 < least <= 1:
        raise ValueError("a similarity above 0 and up to 1 is needed")
    found = shared.written(candidates(prefixes(one.where("size > 0"), least), least))
    side = lambda x: one.select(F.col("bag_id").alias(x), F.col("bag").alias(f"bag_{x}"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", T.multiset_overlap(F.col("bag_a"), F.col("bag_b")).alias("similarity")).where(F.col("similarity") >= least - TINY)


def similar(rows: DataFrame, key: str, bag: str, least: float) -> DataFrame:
    """One row per row of `rows`: key, bag_id, copies (rows with the same bag), n_similar (other rows whose bag is alike at `least` or
    more, those of the same bag included) and best (greatest similarity to another bag, null without one). Two
    empty bags are equal, and alike to nothing else."""
    named, one = bags(rows, key, bag)
    links = shared.written(similar_bags(one, least))
    both = links.select("a", "b", "similarity").union(links.select("b", "a", "similarity"))
    per = both.join(one.select(F.col("bag_id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("bag_id")).agg(F.sum("copies").alias("near"), F.max("similarity").alias("best"))
    told = one.select("bag_id", "copies").join(per, "bag_id", "left").select("bag_id", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_similar"), "best")
    return named.join(told, "bag_id").select(key, "bag_id", "copies", "n_similar", "best")
