"""Merkle manifest of a dataset: a tree of hashes per group of rows, a tree over the groups' roots, and a proof per row.

Rows are numbered in their group by a range partitioning and sums over partitions, so that no group has to fit one
task. The trees are then built in Pregel-style supersteps over RDDs: children send their hashes to their parents, and a
parent that has all its children hashes them and sends on. Supersteps in reverse send each parent's path, lengthened by
the siblings, down to its children. A superstep climbs a block of `LEVELS` levels, whose vertex waits for at most `SPAN`
messages, so that few of them are shuffled and paths are short where they are; nothing passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.llm.common import need, read, written

#: Children of a node.
FANOUT = 3
#: Levels of a block, which one superstep climbs: a message to a parent in the same block stays in its task. A block has at
#: most SPAN lowest nodes.
LEVELS = 4
SPAN = FANOUT**LEVELS
#: Nodes of one level in a task, at most; and at least, where fewer tasks than cores would do.
MOST, LEAST = 100_000, 5_000


def digest_of(*columns: Column) -> Column:
    """Binary SHA-256 of columns, each `-` if null, else its UTF-8 byte count, a colon and its text."""
    texts = [c.cast("string") for c in columns]
    coded = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*coded), 256))


def numbered(rows: DataFrame, group: list[str], order: list[str], known: DataFrame | None = None) -> DataFrame:
    """`rows` with place (from 0, in `order` within `group`) and width (rows of the group), and the other columns of `known`,
    which has one row per group. No column of `group` holds nulls.

    A range partitioning splits large groups; only the counts of a group's partitions meet in one task. Rows that `order` ranks
    alike are numbered in any order.
    """
    spread = rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    spread = written(spread)  # two evaluations of a range partitioning need not agree
    of_group = Window.partitionBy(*group)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(of_group).alias("width"))
    starts = starts if known is None else starts.join(known, group)  # before the rows, where a large group is many keys
    inside = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    own = spread.withColumn("_i", inside)
    return own.join(starts, ["_part", *group]).withColumn("place", F.col("_start") + F.col("_i") - 1).drop("_part", "_start", "_i")


def combined(children: list[bytes]) -> bytes:
    """The hash of a run of nodes: of their hashes as hexadecimal text, one after the other."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def up(width: int) -> int:
    """Nodes above so many nodes."""
    return -(-width // FANOUT)


def climbed(width: int, hashes: list[bytes]) -> tuple[list[list[bytes]], int]:
    """The levels of a block from its lowest nodes to its top, and how many nodes the tree has at the height of the top.

    `width` is that of the lowest level in the whole tree. Each run of children gives its hash to its parent, LEVELS times or until
    the tree has one node.
    """
    levels = [hashes]
    while width > 1 and len(levels) <= LEVELS:
        levels.append([combined(levels[-1][k : k + FANOUT]) for k in range(0, len(levels[-1]), FANOUT)])
        width = up(width)
    return levels, width


def _tasks(sc, nodes: int) -> int:
    return max(1, -(-nodes // MOST), min(sc.defaultParallelism, -(-nodes // LEAST)))


def _ascend(messages: RDD, nodes: int, widest: int) -> tuple[list[RDD], RDD]:
    """Supersteps up. Messages are ((tree, block), (slot, width, hash, load)); width is that of the sender's level.

    Returns the blocks of each superstep, as ((tree, place), (width, [(hash, load) of its lowest nodes])), and (tree,
    (superstep, hash)) of each tree's root.
    """

    def ordered(got) -> tuple:
        got = sorted(got, key=lambda x: x[0])
        return got[0][1], [(x[2], x[3]) for x in got]

    def hashed(item) -> tuple:
        (tree, place), (width, lowest) = item
        levels, width = climbed(width, [x[0] for x in lowest])
        return tree, place, width, levels[-1][0]

    def sent(x) -> tuple:
        tree, place, width, made = x
        return (tree, place // SPAN), (place % SPAN, width, made, None)

    steps, roots = [], []
    while True:
        nodes, widest = max(1, -(-nodes // SPAN)), -(-widest // SPAN)
        blocks = messages.groupByKey(_tasks(messages.ctx, nodes * SPAN)).mapValues(ordered)
        steps.append(blocks)
        made = blocks.map(hashed)
        roots.append(made.filter(lambda x: x[2] == 1).map(lambda x, k=len(steps): (x[0], (k, x[3]))))
        if widest == 1:
            return steps, messages.ctx.union(roots)
        messages = made.filter(lambda x: x[2] > 1).map(sent)


def _descend(steps: list[RDD], starts: RDD, emit: Callable) -> RDD:
    """Supersteps down. `starts` are (tree, (superstep, path, seal)); a path lists the siblings from the lowest level up.

    Returns what `emit` gives for (tree, place, width, hash, load, path, seal) of each leaf.
    """

    def below(item) -> Iterator[tuple]:
        (tree, place), ((width, lowest), (path, seal)) = item
        levels, _ = climbed(width, [x[0] for x in lowest])
        paths = [path]
        for hashes in reversed(levels[:-1]):
            runs = [hashes[k : k + FANOUT] for k in range(0, len(hashes), FANOUT)]
            paths = [b"".join(run[:k] + run[k + 1 :]) + above for run, above in zip(runs, paths) for k in range(len(run))]
        for slot, ((own, load), path) in enumerate(zip(lowest, paths)):
            yield tree, place * SPAN + slot, width, own, load, path, seal

    arriving = None
    for k in range(len(steps), 0, -1):
        new = starts.filter(lambda x, k=k: x[1][0] == k).map(lambda x: ((x[0], 0), x[1][1:]))
        arriving = new if arriving is None else arriving.union(new)
        told = steps[k - 1].join(arriving, steps[k - 1].getNumPartitions()).flatMap(below)
        arriving = told.map(lambda x: ((x[0], x[1]), x[5:]))
    return told.map(emit)


def manifest(leaves: DataFrame, *, group: str = "source", order: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per leaf of (group string, order, leaf binary, the columns `carry`): those of `carry`, leaf, subroot, root,
    proof binary (siblings from the leaf's level to the root, left to right), place, width, tree, trees.

    In each group, leaves ascend by `order` (nulls first, then by hash); every FANOUT consecutive nodes are hashed into one, the last run
    of a level even if it is one node, until one is left, the subroot. Subroots, ordered by group (null first, then by
    bytes), give the root alike. `place` of `width` is the leaf's place in its group, `tree` of `trees` the group's.
    Repeated rows are leaves of their own; a null leaf isn't allowed. An empty table gives no rows.
    """
    spark = leaves.sparkSession
    # As they are hashed from texts, leaves are written first: a range partitioning reads its input twice.
    rows = written(leaves.select(F.col(group).isNotNull().alias("named"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("of"), F.col(order).alias("by"), "leaf", F.struct(*carry, F.lit(0).alias("_")).alias("load"), F.monotonically_increasing_id().alias("row")))
    groups = rows.groupBy("named", "of").agg(F.count(F.lit(1)).alias("rows"))
    trees = numbered(groups.withColumn("all", F.lit(0)), ["all"], ["named", "of"]).select("named", "of", F.col("place").alias("tree"), F.col("width").alias("trees"), "rows")
    trees = written(trees)
    size = trees.agg(F.sum("rows").alias("n"), F.max("rows").alias("widest"), F.count(F.lit(1)).alias("trees")).first()
    kinds = {f.name: f.dataType for f in leaves.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c].simpleString()}" for c in carry], "leaf binary, subroot binary, root binary, proof binary, place long, width long, tree long, trees long"])
    if not size["n"]:
        return spark.createDataFrame([], schema)
    count = size["trees"]
    places = numbered(rows, ["named", "of"], ["by", "leaf", "row"], trees.select("named", "of", "tree"))
    first = places.select("tree", "place", "width", "leaf", "load").rdd.map(lambda r: ((r[0], r[1] // SPAN), (r[1] % SPAN, r[2], bytes(r[3]), tuple(r[4])[:-1])))
    steps, subroots = _ascend(first, size["n"], size["widest"])
    over, root = _ascend(subroots.map(lambda x: ((0, x[0] // SPAN), (x[0] % SPAN, count, x[1][1], x[1][0]))), count, count)
    starts = _descend(over, root.map(lambda x: (x[0], (x[1][0], b"", x[1][1]))), lambda x: (x[1], (x[4], x[5], (x[3], x[6]))))
    done = _descend(steps, starts, lambda x: (*x[4], x[3], x[6][0], x[6][1], x[5], x[1], x[2], x[0], count))
    return spark.createDataFrame(done, schema, verifySchema=False)


def folded(places: DataFrame, leaf: str, name: str = "folded_root") -> DataFrame:
    """`places` (with place, width, tree, trees and proof as `manifest` gives them) and the root that the hash in the column
    `leaf` leads to by the proof; null where the hash is."""
    keep = places.schema

    def folded_up(own: bytes, place: int, width: int, proof: bytes, at: int) -> tuple[bytes, int]:
        while width > 1:
            start = place - place % FANOUT
            beside = min(FANOUT, width - start) - 1
            run = [proof[k : k + 32] for k in range(at, at + 32 * beside, 32)]
            run.insert(place - start, own)
            own, at, place, width = combined(run), at + 32 * beside, place // FANOUT, up(width)
        return own, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, place, width, tree, trees, proof in zip(*[batch.column(c).to_pylist() for c in (leaf, "place", "width", "tree", "trees", "proof")]):
                if own is not None:
                    own, at = folded_up(own, place, width, proof, 0)
                    own, _ = folded_up(own, tree, trees, proof, at)
                out.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name])

    return places.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], f"`{name}` binary"]))


def op12_merkle_supersteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by source. Where 2 divides the CRC of a document's id, the text is checked without its line feeds."""
    docs = need(read(spark, sf_dir, "documents"), doc_id="long", source="string", lang="string", n_chars="long", text="string")
    head, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    other = F.when(changed, digest_of(*head, F.replace(text, F.lit("\n"), F.lit(""))))
    leaves = docs.select("doc_id", "source", digest_of(*head, text).alias("leaf"), other.alias("other"))
    proved = manifest(leaves, carry=("doc_id", "other"))
    done = folded(proved.withColumn("claimed", F.coalesce("other", "leaf")), "claimed")
    text_of = lambda c: F.lower(F.hex(c))
    return done.select(
        "doc_id", text_of("leaf").alias("leaf"), text_of("subroot").alias("subroot"), text_of("root").alias("root"), F.sha2(text_of("proof"), 256).alias("proof_sha256"),
        text_of("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _coded(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_HEAD = " || ".join(_coded(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
#: The CRC in SQL: after each byte of the decimal id, eight shifts (-1).
_CRC = """list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"""
OP12_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS w,
         sha256({_HEAD} || {_coded("text")}) AS leaf,
         CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN sha256({_HEAD} || {_coded("replace(text, chr(10), '')")}) END AS other
  FROM documents),
nodes AS (
  SELECT source, 0 AS k, i, w, leaf AS d FROM l
  UNION ALL
  SELECT source, k + 1, i // 3, (w + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE w > 1 GROUP BY source, k, i // 3, w),
s AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS t, count(*) OVER () AS n FROM nodes WHERE w = 1),
over_ AS (
  SELECT 0 AS k, t AS i, n AS w, subroot AS d FROM s
  UNION ALL
  SELECT k + 1, i // 3, (w + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM over_ WHERE w > 1 GROUP BY k, i // 3, w),
runs AS (
  SELECT t, k, i // 3 AS j, list(d ORDER BY i) AS ds FROM nodes JOIN s ON s.source IS NOT DISTINCT FROM nodes.source WHERE w > 1 GROUP BY t, k, i // 3
  UNION ALL
  SELECT -1, k, i // 3, list(d ORDER BY i) FROM over_ WHERE w > 1 GROUP BY k, i // 3),
start_ AS (SELECT l.*, t, n, subroot, (SELECT d FROM over_ WHERE w = 1) AS root FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source),
path AS (
  SELECT r, 0 AS z, t AS tree, t, n, 0 AS k, i, w, coalesce(other, leaf) AS d, '' AS proof FROM start_
  UNION ALL
  SELECT p.r, p.z + 1, p.tree, p.t, p.n, p.k + 1, p.i // 3, (p.w + 2) // 3,
         sha256(array_to_string(list_concat(ds[:p.i % 3], list_concat([p.d], ds[p.i % 3 + 2:])), '')),
         p.proof || array_to_string(list_concat(ds[:p.i % 3], ds[p.i % 3 + 2:]), '')
  FROM (SELECT r, z, CASE WHEN w > 1 THEN tree ELSE -1 END AS tree, t, CASE WHEN w > 1 THEN n ELSE -1 END AS n, CASE WHEN w > 1 THEN k ELSE 0 END AS k,
               CASE WHEN w > 1 THEN i ELSE t END AS i, CASE WHEN w > 1 THEN w ELSE n END AS w, d, proof FROM path WHERE w > 1 OR (tree >= 0 AND n > 1)) p
  JOIN runs ON runs.t = p.tree AND runs.k = p.k AND runs.j = p.i // 3),
last_ AS (SELECT r, arg_max(d, z) AS d, arg_max(proof, z) AS proof FROM path GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified FROM start_ JOIN last_ USING (r)
"""
