"""Nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts by size-bounded label moves; a small
network learns to predict in which parts a vector's neighbours lie. The network assigns every vector of the index to
its most probable part and routes a query to its most probable parts, until their probabilities sum to what a held-out
share of the sample needs for the wanted recall; the vectors of those parts are ranked exactly, in double precision.
Large indexes have two levels: parts that grow beyond LEAF rows are cut again, each by a network of its own. A bounded
set of queries is then compared with all rows; where the recall measured is under what is asked, queries go to more
parts.

Skew: a vector that many rows share is kept once with its least ids; parts are dealt to cells of bounded size, so a
large part is many tasks; the rows of a cell stay where they are while its queries stream by in batches; a cell gives a
query's best rows only, and best rows are limited before every shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.llm.common import cut, read
from quern.llm.vectors import distinct, matrix, valid

#: Rows of the index in one cell, queries that one task streams through a cell, rows of a part above which it is cut again,
#: parts of one network, and vectors that a network is fitted on.
CELL, DEAL, LEAF, PARTS, SAMPLE = 8192, 1 << 16, 200_000, 64, 6000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row, itself excluded."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.05, passes: int = 8) -> np.ndarray:
    """A part for each vertex, none larger than `slack` times the mean, few graph edges between parts.

    Starts from directions (the largest projections fill a part first) and moves vertices to the part of most of
    their neighbours while there is room.
    """
    n, rng = len(x), np.random.default_rng(5)
    most = int(np.ceil(slack * n / parts))
    part, size = np.full(n, -1), np.zeros(parts, dtype=int)
    score = x @ x[rng.permutation(n)[:parts]].T
    for i in np.argsort(-score.max(axis=1)):
        p = next(p for p in np.argsort(-score[i]) if size[p] < most)
        part[i], size[p] = p, size[p] + 1
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    both = both[:, np.argsort(both[0], kind="stable")]
    edge = np.searchsorted(both[0], np.arange(n + 1))
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(n):
            near = np.bincount(part[both[1, edge[i] : edge[i + 1]]], minlength=parts).astype(float)
            near[size >= most] = -1
            p = int(np.argmax(near))
            if near[p] > np.count_nonzero(part[both[1, edge[i] : edge[i + 1]]] == part[i]):
                size[part[i]] -= 1
                size[p] += 1
                part[i], moved = p, moved + 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer from a vector's direction to a distribution over parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0  # a query goes to its most probable parts until they hold more than this
    recall: float = 1.0  # as measured on the held-out sample

    def odds(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.odds(x).argmax(axis=1)


@dataclass
class Tree:
    """A router over parts and, for the parts that were cut again, routers over their leaves; a leaf is part * PARTS + leaf."""

    root: Router
    leaves: dict[int, Router] = field(default_factory=dict)

    def assign(self, x: np.ndarray) -> np.ndarray:
        part = self.root.part(x)
        out = part * PARTS
        for p, router in self.leaves.items():
            mine = part == p
            if mine.any():
                out[mine] += router.part(x[mine])
        return out

    def route(self, x: np.ndarray, mass: float) -> list[list[int]]:
        """The most probable leaves of each row, until they hold more than `mass`."""
        odds = self.root.odds(x)
        columns, names = [], []
        for p in range(odds.shape[1]):
            below = self.leaves[p].odds(x) if p in self.leaves else np.ones((len(x), 1))
            columns.append(odds[:, p : p + 1] * below)
            names += [p * PARTS + j for j in range(below.shape[1])]
        odds, names = np.concatenate(columns, axis=1), np.array(names)
        order = np.argsort(-odds, axis=1, kind="stable")
        ranked = np.take_along_axis(odds, order, axis=1)
        before = np.cumsum(ranked, axis=1) - ranked
        return [names[o[: max(1, int((b <= mass).sum()))]].tolist() for o, b in zip(order, before, strict=True)]


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40) -> Router:
    """Fits the router to soft labels (rows sum to one) with Adam."""
    rng = np.random.default_rng(3)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, parts = x.shape[1], target.shape[1]
    w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)) * np.sqrt(d) / 4, np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            b = order[at : at + 256]
            h = np.maximum(x[b] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            e = (p / p.sum(axis=1, keepdims=True) - target[b]) / len(b)
            back = (e @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[b].T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*w)


def fit(x: np.ndarray, parts: int, *, neighbours: int = 10, k: int = 20, recall: float = 0.93) -> Router:
    """A router from sample vectors; its mass gives `recall` of the k nearest on a held-out eighth of the sample."""
    parts = max(1, min(parts, len(x) // 24))
    if parts == 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    held = max(24, len(x) // 8)
    graph = neighbour_graph(x[held:], neighbours)
    part = balanced_parts(x[held:], graph, parts)
    target = np.zeros((len(graph), parts))
    np.add.at(target, (np.repeat(np.arange(len(graph)), graph.shape[1]), part[graph.ravel()]), 1.0)
    target[np.arange(len(graph)), part] += 1
    router = train_router(x[held:], target / target.sum(axis=1, keepdims=True))
    where, odds = router.part(x), router.odds(x[:held])
    score = x[:held] @ x.T
    score[np.arange(held), np.arange(held)] = -np.inf
    best = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(-odds, axis=1, kind="stable")
    ranked = np.take_along_axis(odds, order, axis=1)
    before = np.empty_like(odds)
    np.put_along_axis(before, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
    need = before[np.arange(held)[:, None], where[best]]  # what more probable parts hold, for each true neighbour
    router.mass = float(np.quantile(need, recall, method="higher"))
    router.recall = float((need <= router.mass).mean())
    return router


def _tree(index: DataFrame, total: int, parts: int | None, sample: int, k: int, recall: float) -> Tree | None:
    """Fits the routers: one on the `sample` vectors of least hash, and one for each part of more than LEAF rows on as many of
    its own, in a task. Weights of at most PARTS routers come to the driver."""
    picked = index.select("v", "id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample).collect()
    if not picked:
        return None
    tree = Tree(fit(np.array([r["v"] for r in picked]), parts or int(np.clip(round(total**0.5 / 4), 16, PARTS)), k=k, recall=recall))
    if total <= LEAF:
        return tree
    placed = cut(index.select("v", "id").mapInArrow(_placed(tree, ["v", "id"]), "v array<double>, id long, leaf int"))
    large = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().where(F.col("count") > LEAF).collect()}  # of PARTS at most
    order = Window.partitionBy("leaf").orderBy(F.xxhash64("id"), "id")
    some = placed.where(F.col("leaf").isin(list(large))).withColumn("i", F.row_number().over(order)).where(F.col("i") <= sample)

    def learn(t: pa.Table) -> pa.Table:
        leaf = t["leaf"][0].as_py()
        router = fit(matrix(t["v"]), int(np.clip(large[leaf] // (LEAF // 4), 2, PARTS)), k=k, recall=recall)
        return pa.table([pa.array([leaf], pa.int32()), pa.array([pickle.dumps(router)])], ["leaf", "router"])

    found = some.select("leaf", "v").groupBy("leaf").applyInArrow(learn, "leaf int, router binary").collect()
    return Tree(tree.root, {r["leaf"] // PARTS: pickle.loads(r["router"]) for r in found})


def _placed(tree: Tree, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.assign(matrix(b.column(0))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], [*names, "leaf"])

    return run


def _ranked(q: np.ndarray, names: list[int], c: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, float]]:
    """(query, vec_id, score) of the k best of each query among rows `c`, which have several ids each."""
    out: list[tuple[int, int, float]] = []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ c.T
        best = np.argpartition(-s, k, axis=1)[:, : k + 1] if s.shape[1] > k + 1 else np.tile(np.arange(s.shape[1]), (len(s), 1))
        for i in range(len(s)):
            pick = best[i] if s.shape[1] <= k + 1 else np.flatnonzero(s[i] >= s[i, best[i]].min())  # with all ties
            mine = sorted((-s[i, j], v) for j in pick for v in ids[j] if v != names[at + i])[:k]
            out += [(names[at + i], v, -y) for y, v in mine]
    return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


RANKED = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(placed: DataFrame, routed: DataFrame, cells: dict[int, int], deals: dict[int, int], k: int) -> DataFrame:
    """The best rows of each routed query (query_id, v, leaf) in every cell of its leaves: rows of the index come first, and
    the queries of the cell pass by them."""
    number = lambda d: F.element_at(F.create_map(*[F.lit(y) for p, c in d.items() for y in (p, c)]), F.col("leaf"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    long_ids = F.lit(None).cast("array<long>")
    rows = placed.where(number(deals).isNotNull()).select("leaf", F.pmod(F.xxhash64("v"), number(cells)).cast("int").alias("cell"), each(number(deals)).alias("deal"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), "v", "ids")
    asked = routed.where(number(cells).isNotNull()).select("leaf", each(number(cells)).alias("cell"), F.pmod(F.xxhash64("query_id"), number(deals)).cast("int").alias("deal"), F.lit(1).alias("kind"), "query_id", "v", long_ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, ids, held = None, [], [], None
        for b in batches:
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            if not len(key):
                continue
            edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))).tolist()
            out: list[tuple] = []
            for x, y in zip(edge, [*edge[1:], len(key)], strict=True):
                if tuple(key[x, :3]) != at:
                    at, rows, ids, held = tuple(key[x, :3]), [], [], None
                v = matrix(b.column(5).slice(x, y - x))
                if key[x, 3] == 0:
                    rows.append(v)
                    ids += b.column(6).slice(x, y - x).to_pylist()
                elif rows:
                    held = np.concatenate(rows) if held is None else held
                    out += _ranked(v, b.column(4).slice(x, y - x).to_pylist(), held, ids, k)
            yield _table(out)

    both = rows.union(asked).repartition("leaf", "cell", "deal").sortWithinPartitions("leaf", "cell", "deal", "kind")
    return _best(both.mapInArrow(run, RANKED), k)


def exact(queries: DataFrame, index: DataFrame, k: int, some: int) -> tuple[list[int], DataFrame]:
    """The `some` queries of least hash and their k best rows of all, by brute force."""
    asked = queries.orderBy(F.xxhash64("query_id", F.lit(7)), "query_id").limit(some).collect()
    names, q = [r["query_id"] for r in asked], np.array([r["v"] for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _table(_ranked(q, names, matrix(b.column(0)), b.column(1).to_pylist(), k))

    return names, _best(index.select("v", "ids").mapInArrow(run, RANKED), k)


def search(
    vectors: DataFrame, *, every: int = 20, k: int = 20, sample: int = SAMPLE, parts: int | None = None, recall: float = 0.93, least: float = 0.9, audited: int = 100,
) -> DataFrame:
    """The k nearest rows found for every row whose vec_id is divisible by `every`: query_id, rank (from 1), vec_id, score,
    and parts (of the index), probes (parts the query went to) and recall (against brute force, over `audited` queries).

    Nearness is the inner product in double precision, ties go to the smaller vec_id, and only the query's own row is
    left out. With fewer candidates all of them are returned. Routers are fitted on samples of `sample` vectors; all rows
    are indexed. If the measured recall is under `least`, queries go to more parts, at last to all. Null or zero vectors,
    null or non-finite components and null ids take no part, nor vectors of another length than most. Repeated rows (same
    id and vector) count once. An empty table gives no rows; other columns are ignored.
    """
    rows = cut(valid(vectors))
    index = cut(distinct(rows, k + 1))
    tree = _tree(index, index.count(), parts, sample, k, recall)
    if tree is None:
        none = rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        return none.select("*", F.lit(0).alias("parts"), F.lit(0).alias("probes"), F.lit(0.0).alias("recall"))
    placed = cut(index.select("v", "ids").mapInArrow(_placed(tree, ["v", "ids"]), "v array<double>, ids array<long>, leaf int"))
    cells = {r["leaf"]: -(-r["count"] // CELL) for r in placed.groupBy("leaf").count().collect()}  # a row per part
    queries = cut(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v"))
    names, truth = exact(queries, index, k, audited)
    truth = cut(truth)
    want, mass = truth.count(), tree.root.mass
    while True:

        def route(batches: Iterator[pa.RecordBatch], mass: float = mass) -> Iterator[pa.RecordBatch]:
            for b in batches:
                to = tree.route(matrix(b.column(1)), mass) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.list_(pa.int32()))], ["query_id", "v", "leaves"])

        routed = cut(queries.mapInArrow(route, "query_id long, v array<double>, leaves array<int>"))
        legs = routed.select("query_id", "v", F.explode("leaves").alias("leaf"))
        deals = {r["leaf"]: -(-r["count"] // DEAL) for r in legs.groupBy("leaf").count().collect()}  # a row per part
        found = cut(_scan(placed, legs, cells, deals, k)) if deals else _best(truth, k)
        hit = found.where(F.col("query_id").isin(names)).join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
        if hit >= least * want or mass >= 1:
            break
        mass = 1.0 if mass > 1 - 1e-6 else 1 - (1 - mass) / 4
    probes = routed.select("query_id", F.size("leaves").alias("probes"))
    out = found.join(probes, "query_id").select("query_id", "rank", "vec_id", "score", F.lit(len(cells)).alias("parts"), "probes")
    return out.withColumn("recall", F.lit(hit / want if want else 1.0))


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
