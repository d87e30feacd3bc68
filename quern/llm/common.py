"""Helpers shared by the training-data operators: checkpoints, size-checked joins and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder. Arrow batches are made small for the session, as texts can be long: a worker then holds
    some MB of texts, not ten thousand rows whatever their size."""
    for key, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share. Only where none is set (tests on one machine), a
    temporary folder is set first."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="quern-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and return the written copy, whose lineage starts there.

    The copy would also take over the constraints that the optimizer has inferred so far, which grow with every round of
    a loop; they are left out.
    """
    spark, key = df.sparkSession, "spark.sql.constraintPropagation.enabled"
    shared_folder(spark)
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, was)


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: like `cut`, and smaller where columns compress well."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def need(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the types given; other columns, however named, are left behind."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in types.items()])


#: Edges that one task finishes: a fixed bound, whatever the input; above it, rounds over all tasks come first.
SMALL = 1 << 18
#: Rows that may be broadcast, of keys and a few numbers each. A table is counted before it is.
BROADCAST_ROWS = 1 << 18


def few(table: DataFrame, most: int | None = None) -> DataFrame:
    """`table`, written down and counted, and marked for broadcast if it has at most `most` rows (BROADCAST_ROWS)."""
    table = cut(table)
    return F.broadcast(table) if table.count() <= (BROADCAST_ROWS if most is None else most) else table


def lookup(rows: DataFrame, table: DataFrame, key: str, share: int = 1000, n: str = "n") -> DataFrame:
    """Left join of `rows` to `table`, unique in `key`; its column named by `n`, the rows of a key (or more), isn't returned.

    Keys of more than a `share`-th of the rows are `share` at most, so these are broadcast and no task gets such
    a key's rows; the others are joined by a shuffle, or broadcast too where the whole table is counted to be small.
    """
    table = cut(table)
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(n)), key, "left")
    most = rows.count() // share
    hot = table.where(F.col(n) > most).drop(n)
    cold = table.where(F.col(n) <= most).drop(n)
    other = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(other)


def _finish(edges: DataFrame) -> DataFrame:
    """(id, component) of at most SMALL edges, in one task."""
    kind = dict(edges.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root[x]
            return top

        types = None
        for batch in batches:
            types = batch.schema.types[0]
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        if root:
            ids = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(ids, types), pa.array([find(x) for x in ids], types)], ["id", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"id {kind}, component {kind}")


def components(edges: DataFrame, rounds: int = 60, small: int | None = None) -> DataFrame:
    """Connected components of an undirected edge list (a, b): returns (id, component), component the least id.

    Every round hooks each vertex to its least neighbour, doubles pointers until they reach roots and contracts
    the edges, so that each round at least halves the vertices left; what is left of at most `small` edges (SMALL) is
    finished in one task. Hub vertices only meet combinable minima and joins whose other side is unique per key, which
    adaptive execution splits. Only vertices with an edge are returned.
    """
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    for _ in range(rounds):
        left = live.count()
        if not left:
            break
        if left <= (SMALL if small is None else small):
            done = _finish(live)
            if label is None:
                return cut(done)
            to = done.select(F.col("id").alias("component"), F.col("component").alias("p"))
            return cut(label.join(to, "component", "left").select("id", F.coalesce("p", "component").alias("component")))
        both = live.union(live.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        jump, more = hook, True  # the first doubling shares the hook's exchange with itself
        while more:
            step = jump.join(jump.select(F.col("v").alias("p"), F.col("p").alias("q")), "p")
            jump = cut(step.select("v", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            more = not jump.where("moved").isEmpty()
            jump = jump.select("v", "p")
        if label is None:
            label = jump.select(F.col("v").alias("id"), F.col("p").alias("component"))
        else:
            to = jump.select(F.col("v").alias("component"), "p")
            label = label.join(to, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        label = cut(label)
        left = jump.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = jump.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = live.join(left, "a").join(right, "b").where("pa <> pb")
        live = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if label is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    return label
