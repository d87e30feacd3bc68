"""Embedding near-duplicates by NN-descent.

Equal vectors are one vertex. A first neighbour graph comes from buckets of equal sign patterns under random
directions, in so many tables that a pair at the threshold shares a bucket with a fixed probability at every size. Where a
bucket is crowded (vectors in a narrow cone), those of its vertices that haven't enough links yet go to longer patterns in
more tables, level by level. Then rounds join each vertex's neighbours and reverse neighbours with one another, and pairs nearer than what a list holds
replace its last entries, until few entries change. Near pairs are checked in double precision.

A list whose every entry is over the threshold is saturated: it may be too short. The components of saturated vertices
are enlarged to whole clusters: each is dealt to blocks, and its blocks, also those of two such components that share a
bucket, are compared with one another. Centres and radii settle most block pairs (angles obey the triangle inequality),
first for groups of blocks, then for blocks; the rest is counted by matrix products. Counts, not pairs, are returned,
and a link between two components merges them. An audit compares a bounded set of vertices with all others, vertex by
vertex; most of them are known to have links by tables of their own, so that it measures something where links are rare.
While it finds too little, the work is repeated with more tables and longer lists, and at last refused.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.llm.common import components, cut, few, lookup, read
from quern.llm.vectors import distinct, lists, matrix, valid

log = logging.getLogger("quern")
#: Vertices in a bucket block of the first graph, in a block of a cluster, and blocks in a group.
BLOCK, CLUSTER, GROUP = 256, 1024, 64
#: Signs of the longest patterns, and by how many those of a level are longer than those of the one before.
LONGEST, LONGER = 24, 5


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tables(bits: int, least: float, collide: float) -> int:
    """In how many tables a pair of cosine `least` shares a bucket of so many signs with probability `collide`."""
    return int(np.ceil(np.log(1 - collide) / np.log(1 - (1 - np.arccos(least) / np.pi) ** bits)))


def _codes(points: DataFrame, dims: int, bits: int, tables: int, level: int = 0) -> DataFrame:
    """(u, code) for each table: the signs of `bits` random projections; each level has directions of its own."""
    planes = np.random.default_rng(17 + level).normal(size=(tables, dims, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            if len(x):
                code = np.stack([((x @ p > 0) @ (1 << np.arange(bits, dtype=np.int64))) | (t | level << 16) << 40 for t, p in enumerate(planes)], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code.tolist(), pa.list_(pa.int64()))], ["u", "codes"])

    return points.select("u", "w").mapInArrow(run, "u long, codes array<long>").select("u", F.explode("codes").alias("code"))


def _dealt(codes: DataFrame) -> DataFrame:
    """(g, u, n): the vertices of each bucket of several, n, in groups of about BLOCK."""
    size = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    block = lookup(codes, size.withColumn("many", F.col("n")), "code", n="many").where("n is not null")
    return block.select(F.xxhash64("code", F.pmod(F.xxhash64("u", "code"), F.ceil(F.col("n") / BLOCK))).alias("g"), "u", "n")


def _groups(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole runs of equal first-column values, of about `most` rows; groups are small by construction."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(key):
            last = held[-1].column(0)[-1].as_py() if held else None
            if size >= most:  # the run that is open ends where its key does
                stop = at + int(np.searchsorted(key[at:] != last, True)) if key[at] == last else at
                if stop > at:
                    held.append(b.slice(at, stop - at))
                at = stop
                if at < len(key):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                continue
            stop = min(len(key), at + most - size)
            held.append(b.slice(at, stop - at))
            size += stop - at
            at = stop
    if held:
        yield pa.Table.from_batches(held)


def _best(rows: DataFrame, near: int) -> DataFrame:
    """Pairs proposed by the groups of (g, u, w, least): each member's `near` nearest others over its `least`, as (u, v, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            g, u = t["g"].to_numpy(), t["u"].to_numpy()
            x, least = matrix(t["w"]).astype(np.float32), t["least"].to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
            us, vs, ss = [], [], []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a < 2:
                    continue
                s = np.round(x[a:b] @ x[a:b].T, 4)
                np.fill_diagonal(s, -2)
                k = min(near, b - a - 1)
                j = np.argpartition(-s, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(s, j, axis=1)
                keep = value > least[a:b, None]
                us.append(np.repeat(u[a:b], k)[keep.ravel()])
                vs.append(u[a:b][j][keep])
                ss.append(value[keep])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ss).astype(np.float32))], ["u", "v", "s"])

    return rows.select("g", "u", "w", "least").sortWithinPartitions("g").mapInArrow(run, "u long, v long, s float")


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u among (u, v, s) as `near` array<struct<s, v>>, nearest first. A vertex is in a bounded number of
    groups, each of which proposes k at most, so it has few proposals."""
    top = F.slice(F.sort_array(F.collect_set(F.struct("s", "v")), asc=False), 1, k)
    return pairs.groupBy("u").agg(top.alias("near"))


def first_lists(points: DataFrame, dims: int, *, bits: int, least: float, collide: float, k: int, more: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first graph over (u, w) as (u, near), and the codes (u, code) of its buckets, in 2^`more` times the tables.

    A vertex of a crowded bucket (over BLOCK vertices, which are dealt to blocks) whose list holds less than k links goes to
    the next level, of patterns LONGER signs longer, up to LONGEST. Vertices with k links have whole clusters compared later."""
    near = codes = None
    some, level = points, 0
    while True:
        new = cut(_codes(some, dims, bits, _tables(bits, least, collide) << more, level))
        block = cut(_dealt(new))
        first = block.select("g", "u").join(points, "u").select("g", "u", "w", F.lit(-1.0).alias("least")).repartition("g")
        found = _best(first, k)
        if near is not None:
            found = found.union(near.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.s").alias("s")))
        near = cut(_lists(found, k))
        codes = new if codes is None else codes.union(new)
        if bits >= LONGEST:
            return near, codes
        full = near.where((F.size("near") >= k) & (F.element_at("near", -1)["s"] >= least)).select("u")
        crowd = cut(block.where(F.col("n") > BLOCK).select("u").distinct().join(full, "u", "left_anti"))
        if crowd.isEmpty():
            return near, codes
        some, bits, level = cut(points.join(crowd, "u", "left_semi")), min(bits + LONGER, LONGEST), level + 1


def neighbour_lists(points: DataFrame, near: DataFrame, *, k: int, rounds: int, settled: float = 0.01) -> DataFrame:
    """NN-descent over (u, w), w unit vectors, from a first graph: (u, near). Of a vertex that more than 4 k lists hold, 4 k by
    hash count."""
    total = points.count()
    for r in range(rounds):
        edges = near.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"))
        order = Window.partitionBy("v").orderBy(F.xxhash64("u", "v", F.lit(r)))
        both = edges.withColumn("i", F.row_number().over(order)).where(F.col("i") <= 4 * k)
        join = F.explode(F.when(F.col("i") <= k, F.array(F.struct(F.col("u").alias("g"), F.col("v").alias("u")), F.struct(F.col("v").alias("g"), F.col("u").alias("u"))))
                         .otherwise(F.array(F.struct(F.col("u").alias("g"), F.col("v").alias("u")))))
        member = both.select(join.alias("m")).select("m.g", "m.u").union(near.select(F.col("u").alias("g"), "u")).distinct()
        least = F.when(F.size("near") >= k, F.element_at("near", -1)["s"]).otherwise(F.lit(-1.0)).cast("double")
        known = points.join(near.select("u", least.alias("least")), "u", "left").select("u", "w", F.coalesce("least", F.lit(-1.0)).alias("least"))
        found = _best(member.join(known, "u").select("g", "u", "w", "least").repartition("g"), k)
        old = near.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.s").alias("s"))
        was = near.select("u", F.col("near").alias("was"))
        after = cut(_lists(found.union(old), k).join(was, "u", "left"))
        changed = after.select(F.sum(F.size(F.array_except("near", F.coalesce("was", F.array().cast("array<struct<s:float,v:bigint>>"))))).alias("n")).first()["n"] or 0
        near = after.select("u", "near")
        if changed < settled * k * total:
            break
    return near


def _check(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision is `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = pa.array((_unit(matrix(b.column(2))) * _unit(matrix(b.column(3)))).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["a", "b"])

    left, right = rows.select(F.col("u").alias("a"), F.col("v").alias("va")), rows.select(F.col("u").alias("b"), F.col("v").alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _ball(x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, float]:
    """A centre of unit vectors and the angle from it within which all lie, each reaching `far` further."""
    middle = x.mean(axis=0, keepdims=True)
    middle = _unit(middle) if np.linalg.norm(middle) > 1e-9 else x[:1]
    return middle, float((np.arccos(np.clip(x @ middle[0], -1, 1)) + far).max())


HEAD = "c long, block long, m array<double>, far double, n long"


def _settled(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs of balls (m, far and m2, far2) with `all` (every pair of their vectors links) and `none`."""
    theta, slack = float(np.arccos(least)), 1e-7
    dot = F.aggregate(F.zip_with("m", "m2", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    angle = F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))
    return pairs.withColumn("angle", angle).select(
        "c", "block", "c2", "block2", "n", "n2", (F.col("angle") + F.col("far") + F.col("far2") < theta - slack).alias("all"),
        (F.col("angle") - F.col("far") - F.col("far2") > theta + slack).alias("none"))


def _second(heads: DataFrame) -> DataFrame:
    return heads.select(F.col("c").alias("c2"), F.col("block").alias("block2"), F.col("m").alias("m2"), F.col("far").alias("far2"), F.col("n").alias("n2"))


def enlarge(members: DataFrame, between: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(u, links) over whole clusters, and the pairs (a, b) of clusters that a link joins.

    `members` has (c, u, n, v), n the rows of a vertex; `between` has pairs (c, c2), c < c2, of clusters to compare besides
    each with itself. links counts the rows linked with u, without u's own one.
    """
    size = cut(members.groupBy("c").agg(F.count(F.lit(1)).alias("k")).withColumn("blocks", F.ceil(F.col("k") / CLUSTER)))
    dealt = cut(lookup(members, size, "c", n="k").withColumn("block", F.pmod(F.xxhash64("u"), "blocks")).drop("blocks"))

    def summary(t: pa.Table) -> pa.Table:
        x = _unit(matrix(t["v"]))
        middle, far = _ball(x, np.zeros(len(x)))
        return pa.table([t["c"][:1], t["block"][:1], lists(middle), pa.array([far]), pa.array([int(np.sum(t["n"].to_numpy()))])], ["c", "block", "m", "far", "n"])

    def group(t: pa.Table) -> pa.Table:
        middle, far = _ball(matrix(t["m"]), t["far"].to_numpy())
        return pa.table([t["c"][:1], t["g"][:1], lists(middle), pa.array([far]), pa.array([int(np.sum(t["n"].to_numpy()))])], ["c", "block", "m", "far", "n"])

    heads = cut(dealt.groupBy("c", "block").applyInArrow(summary, HEAD))
    wide = cut(heads.withColumn("g", F.floor(F.col("block") / GROUP)).groupBy("c", "g").applyInArrow(group, HEAD))
    groups = size.select(F.col("c").alias("c2"), F.ceil(F.col("blocks") / GROUP).alias("groups"))
    whole = cut(between.select("c", "c2").union(size.select("c", F.col("c").alias("c2"))))
    # The group of the other side is part of the key, so that no cluster is one key of a join.
    first = wide.join(whole, "c").join(groups, "c2").withColumn("block2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    first = cut(_settled(first.join(_second(wide), ["c2", "block2"]).where("c < c2 or block <= block2"), least).where("not none"))
    parted = heads.withColumn("g", F.floor(F.col("block") / GROUP))
    open_ = first.where("not all").select("c", F.col("block").alias("g"), "c2", F.col("block2").alias("g2"))
    second = open_.join(parted, ["c", "g"]).join(_second(heads).withColumn("g2", F.floor(F.col("block2") / GROUP)), ["c2", "g2"])
    second = cut(_settled(second.where("c < c2 or block <= block2"), least).where("not none"))

    def sums(pairs: DataFrame) -> DataFrame:
        """Rows linked with all of a block, from pairs of blocks where all link; a pair counts for both of its sides."""
        other = pairs.where("c < c2 or block < block2").select(F.col("c2").alias("c"), F.col("block2").alias("block"), F.col("n").alias("n2"))
        return pairs.select("c", "block", "n2").union(other).groupBy("c", "block").agg(F.sum("n2").alias("links"))

    by_group = dealt.withColumn("g", F.floor(F.col("block") / GROUP)).join(sums(first.where("all")).withColumnRenamed("block", "g"), ["c", "g"]).select("u", "links")
    by_block = dealt.join(sums(second.where("all")), ["c", "block"]).select("u", "links")
    cells = second.where("not all").select("c", "block", "c2", "block2")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, ["u", "links", "a", "b"])
        one = left["ca"][0].as_py(), left["ba"][0].as_py()
        two = left["c2"][0].as_py(), left["o2"][0].as_py()
        hit = _unit(matrix(left["va"])) @ _unit(matrix(right["vb"])).T >= least
        u, links = left["ua"].to_numpy(), hit @ right["nb"].to_numpy()
        if one != two:
            u, links = np.concatenate([u, right["ub"].to_numpy()]), np.concatenate([links, hit.T @ left["na"].to_numpy()])
        a = np.full(len(u), one[0])
        return pa.table([pa.array(u), pa.array(links.astype(np.int64)), pa.array(a), pa.array(np.full(len(u), two[0] if hit.any() else one[0]))], ["u", "links", "a", "b"])

    # Fresh names: the two sides come from the same table.
    a = dealt.join(cells, ["c", "block"]).select(F.col("c").alias("ca"), F.col("block").alias("ba"), "c2", F.col("block2").alias("o2"), F.col("u").alias("ua"), F.col("n").alias("na"), F.col("v").alias("va"))
    b = _renamed(dealt).join(cells.select(F.col("c").alias("cb"), F.col("block").alias("bb"), F.col("c2").alias("c"), F.col("block2").alias("block")), ["c", "block"])
    b = b.select("cb", "bb", F.col("c").alias("c3"), F.col("block").alias("o3"), "ub", "nb", "vb")
    rest = cut(a.groupBy("ca", "ba", "c2", "o2").cogroup(b.groupBy("cb", "bb", "c3", "o3")).applyInArrow(count, "u long, links long, a long, b long"))
    links = by_group.union(by_block).union(rest.select("u", "links")).groupBy("u").agg(F.sum("links").alias("links"))
    merged = rest.select("a", "b").union(first.where("all").select("c", "c2")).union(second.where("all").select("c", "c2")).where("a <> b").distinct()
    return links.select("u", (F.col("links") - 1).alias("links")), merged


def _renamed(dealt: DataFrame) -> DataFrame:
    return dealt.select("c", "block", F.col("u").alias("ub"), F.col("n").alias("nb"), F.col("v").alias("vb"))


def witnesses(points: DataFrame, dims: int, least: float, bits: int, tables: int) -> DataFrame:
    """(u, n): vertices that have links, by buckets of directions that the graph doesn't use, and the most in one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            g, u, x = t["g"].to_numpy(), t["u"].to_numpy(), matrix(t["w"])
            edge = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
            hits = np.concatenate([(x[a:b] @ x[a:b].T >= least + 1e-6).sum(axis=1) - 1 for a, b in zip(edge[:-1], edge[1:], strict=True)] or [np.zeros(0, int)])
            yield pa.RecordBatch.from_arrays([pa.array(u[hits > 0]), pa.array(hits[hits > 0].astype(np.int64))], ["u", "n"])

    block = _dealt(cut(_codes(points, dims, bits, tables, 7))).select("g", "u")
    rows = block.join(points, "u").select("g", "u", "w").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, "u long, n long").groupBy("u").agg(F.max("n").alias("n"))


def asked(rows: DataFrame, seen: DataFrame, some: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and unit vectors of at most `some` vertices for the audit, by least hash: half of them among `seen` (u, n) with less
    than `short` links, a quarter among the others seen, the rest among all."""
    least = lambda df, n: df.select("u").orderBy(F.xxhash64("u", F.lit(1)), "u").limit(n)
    names = least(seen.where(F.col("n") < short), some // 2).union(least(seen.where(F.col("n") >= short), some // 4)).union(least(rows, some - some // 2 - some // 4)).distinct()
    got = rows.join(few(names), "u").select("u", "v").collect()
    return np.array([r["u"] for r in got], dtype=np.int64), _unit(np.array([r["v"] for r in got]))


def audit(rows: DataFrame, links: DataFrame, least: float, names: np.ndarray, q: np.ndarray, short: int) -> tuple[float, int]:
    """The recall of `links` (u, far) over the vertices `names` of vectors `q`, each compared with all rows, and how many of them
    have links: the mean over these of the share found, or that mean over those of at most `short` links, if it is less. Without
    any, nothing is measured, and the recall is given as 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(len(names), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                hits += (_unit(matrix(b.column(0))) @ q.T >= least).T @ b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(hits)], ["u", "truth"])

    truth = rows.select("v", "n").mapInArrow(run, "u long, truth long").groupBy("u").agg(F.sum("truth").alias("truth"))
    both = truth.join(rows.select("u", "n"), "u").join(links.select("u", "far"), "u", "left").select((F.col("truth") - F.col("n")).alias("truth"), F.coalesce("far", F.lit(0)).alias("far"))
    share = F.when(F.col("truth") > 0, F.least(F.col("far") / F.col("truth"), F.lit(1.0)))
    got = both.select(F.avg(share).alias("every"), F.avg(F.when(F.col("truth") <= short, share)).alias("low"), F.count(share).alias("n")).first()
    return min(x for x in (got["every"], got["low"], 1.0) if x is not None), got["n"]


def near_vectors(
    vectors: DataFrame, *, least: float = 0.95, k: int = 8, collide: float = 0.95, rounds: int = 3, audited: int = 1000, recall: float = 0.98, attempts: int = 4,
) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links (other rows of cosine `least` or more), component_id (least vec_id
    reachable over links) and kept (vec_id is it).

    `collide` is the probability that a pair at the threshold shares a bucket of the first graph. The audit compares
    `audited` vertices with all; where less than `recall` of their links was found, the next attempt has twice the tables
    and lists. After `attempts` the result is refused with an error. The log says what was measured, over how many linked
    vertices, or that no link was seen by which to measure. A pair is linked if its cosine in double precision
    is `least` or more, `least` itself included.

    Null or zero vectors, null or non-finite components and vectors of another length than most link with nothing and
    are components of their own. Rows equal in id and vector are one vector, each returned; an id with several vectors is
    given the links of all of them. A null id is returned with no links and a null component. An empty table gives no
    rows; other columns are ignored.
    """
    base = valid(vectors)
    both = F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), "v").alias("y"))  # 128 bits stand for a vector
    base = cut(base.select("vec_id", "v", both.alias("h")))
    # An id with several vectors leads at most one vertex by its id, so vertices are numbered by id and vector.
    rows = cut(distinct(base.select("vec_id", "v"), 1).select(F.xxhash64("id", "v").alias("u"), both.alias("h"), "id", "n", "v"))
    top = rows.select(F.size("v").alias("d")).first()
    total = rows.count()
    if top is None or total < 2:
        links = rows.select("u", F.lit(0).cast("long").alias("far"))
        label = rows.select(F.col("u").alias("id"), F.col("u").alias("component")).limit(0)
    else:
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        big = F.array_max(F.transform("v", F.abs))
        scaled = rows.select("u", F.transform("v", lambda x: x / big).alias("v"))
        points = cut(scaled.select("u", F.transform("v", lambda x: (x / norm).cast("float")).alias("w")))
        bits = int(np.clip(np.ceil(np.log2(max(2, total) / 24)), 2, 30))
        seen = cut(witnesses(points, top["d"], least, bits, _tables(bits, least, collide)))
        names, q = asked(rows, seen, audited, k)
        for attempt in range(attempts):
            near, codes = first_lists(points, top["d"], bits=bits, least=least, collide=collide, k=k << attempt, more=attempt)
            near = neighbour_lists(points, near, k=k << attempt, rounds=rounds + attempt)
            links, label = _linked(rows, codes, near, least, k << attempt)
            found, n = audit(rows, links, least, names, q, k << attempt)
            log.info("recall %s over %d linked vertices of %d", f"{found:.4f}" if n else "unmeasured", n, len(names))
            if found >= recall:
                break
        else:
            raise RuntimeError(f"the audit found {found:.3f} of the links, under {recall}; raise k, collide or rounds")
    named = rows.select("u", "h", "n").join(label.select(F.col("id").alias("u"), "component"), "u", "left").join(links, "u", "left")
    table = named.select("h", "n", F.col("n").alias("copies"), F.coalesce("component", "u").alias("c"), F.coalesce("far", F.lit(0)).alias("far"))
    ids = lookup(base.select("vec_id", "h"), table, "h")
    ids = cut(ids.select("vec_id", "c", (F.col("far") + F.col("copies") - 1).alias("n_links")))
    # Vertices that share an id are one row's links, hence one component.
    multi = cut(ids.groupBy("vec_id").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").select("a", "b"))
    if not multi.isEmpty():
        joined = components(multi).withColumnRenamed("id", "c").withColumnRenamed("component", "c2")
        ids = ids.join(few(joined), "c", "left").select("vec_id", F.coalesce("c2", "c").alias("c"), "n_links")
    head = ids.groupBy("c").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    per = lookup(ids, head, "c").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min(F.coalesce("component_id", "vec_id")).alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(per, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _between(codes: DataFrame, within: DataFrame) -> DataFrame:
    """Pairs (c, c2) of different clusters of `within` (c, u) that share a bucket; buckets of over BLOCK clusters are dealt to
    groups of about that many."""
    spot = cut(codes.join(within, "u").select("code", "c").distinct())
    many = spot.groupBy("code").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("n", F.col("m"))
    spot = lookup(spot, many, "code").where("m is not null").withColumn("g", F.pmod(F.xxhash64("c", "code"), F.ceil(F.col("m") / BLOCK)))
    sets = spot.groupBy("code", "g").agg(F.collect_set("c").alias("cs"))
    pairs = F.flatten(F.transform("cs", lambda x: F.transform(F.filter("cs", lambda y: y > x), lambda y: F.struct(x.alias("c"), y.alias("c2")))))
    return sets.select(F.explode(pairs).alias("p")).select("p.c", "p.c2").distinct()


def _linked(rows: DataFrame, codes: DataFrame, near: DataFrame, least: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(u, far): rows linked to u besides its own; and (id, component) of vertices with links."""
    edges = near.select("u", F.explode("near").alias("e")).where(F.col("e.s") >= least - 0.001)
    pairs = edges.select(F.least("u", F.col("e.v")).alias("a"), F.greatest("u", F.col("e.v")).alias("b")).distinct()
    pairs = cut(_check(pairs, rows, least))
    both = pairs.union(pairs.select("b", "a"))
    full = both.groupBy(F.col("a").alias("u")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= k).select("u")
    label = components(pairs)
    wide = few(label.join(full.withColumnRenamed("u", "id"), "id", "left_semi").select("component").distinct())
    within = cut(label.join(wide, "component").select(F.col("component").alias("c"), F.col("id").alias("u")))
    far = both.join(rows.select(F.col("u").alias("b"), "n"), "b").groupBy(F.col("a").alias("u")).agg(F.sum("n").alias("far"))
    if within.isEmpty():
        return cut(far), label
    counted, merged = enlarge(within.join(rows.select("u", "n", "v"), "u"), _between(codes, within), least)
    merged = cut(merged)
    if not merged.isEmpty():
        joined = components(merged).select(F.col("id").alias("component"), F.col("component").alias("c2"))
        label = cut(label.join(few(joined), "component", "left").select("id", F.coalesce("c2", "component").alias("component")))
    counted = counted.join(rows.select("u", "n"), "u").select("u", (F.col("links") - F.col("n") + 1).alias("far"))
    rest = far.join(within.select("u"), "u", "left_anti")
    return cut(counted.union(rest)), label


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
