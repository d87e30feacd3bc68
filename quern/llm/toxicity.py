"""Classifier chains for toxicity.

Categories are predicted in a fixed order by logistic models over the presence of hashed character n-grams; every
later model also reads the log odds of the categories before it. For training those log odds come from models that
did not see the row (k folds, feature choice included), as they will at prediction. The threshold of the last
category is the one with the best F1 among such out-of-fold predictions, each counted as often as the sample stands
for labelled rows of its class.

The models are fitted on the driver from a bounded sample of labelled rows (`positives` and `negatives` of the last
category, least hash of doc_id first); scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import need, read
from quern.llm.text import _BYTES, mix, normal, parts, powers

SIZES = (5, 6)
BITS = 21


def _places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start of each text in the joint buffer, and the buffer: texts between two spaces each."""
    buf = np.frombuffer(b"  ".join([b"", *texts, b""]), dtype=np.uint8)
    return np.cumsum([0, *[len(t) + 2 for t in texts]]) + 1, buf


def _buckets(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n-gram size, the bucket of the n-gram at every byte."""
    up, down = powers(len(buf))
    prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[buf] * up, out=prefix[1:])
    for size in SIZES:
        if len(buf) >= size:
            value = (prefix[size:] - prefix[:-size]) * down[: len(buf) - size + 1]
            yield size, (mix(value + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; with `wanted` (column of each bucket or -1) the column takes the bucket's place."""
    first, buf = _places(texts)
    keys = [np.zeros(0, dtype=np.int64)]
    for size, bucket in _buckets(buf):
        at = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket] >= 0)
        owner = np.searchsorted(first, at, side="right") - 1
        inside = (owner >= 0) & (owner < len(texts))
        owner = np.clip(owner, 0, len(texts) - 1)
        inside &= at + size <= first[owner + 1]
        b = bucket[at[inside]]
        keys.append(owner[inside] << BITS | (b if wanted is None else wanted[b]))
    key = np.sort(np.concatenate(keys))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key >> BITS, key & ((1 << BITS) - 1)


def _logistic(owner: np.ndarray, column: np.ndarray, m: int, rest: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient descent: m binary columns given by their ones, then dense ones."""
    n, k = len(y), m + rest.shape[1]
    w = np.zeros(k + 1)
    w[k] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    scale = 0.25 * (1 + len(owner) / n + np.mean((rest**2).sum(axis=1))) + penalty
    v, momentum = w.copy(), 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(np.bincount(owner, v[column], n) + rest @ v[m:k] + v[k], -30, 30))) - y
        slope = np.concatenate([np.bincount(column, e[owner], m), rest.T @ e, [e.sum()]]) / n
        slope[:k] += penalty * v[:k]
        after, step = v - slope / scale, (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, w, momentum = after + (momentum - 1) / step * (after - w), after, step
    return w[:m], w[m:k], float(w[k])


@dataclass
class Linear:
    buckets: np.ndarray
    weights: np.ndarray
    chain: np.ndarray  # weights of the earlier categories' log odds
    bias: float

    def odds(self, owner: np.ndarray, bucket: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        weight = np.zeros(1 << BITS, dtype=np.float64)
        weight[self.buckets] = self.weights
        return np.bincount(owner, weight[bucket], n)[:n] + before @ self.chain + self.bias


def _fit(owner: np.ndarray, bucket: np.ndarray, rows: np.ndarray, y: np.ndarray, before: np.ndarray, most: int, penalty: float) -> Linear:
    """A linear model from the texts `rows`: the `most` most associated n-grams and the earlier categories."""
    place = np.full(len(y), -1, dtype=np.int32)
    place[rows] = np.arange(len(rows))
    label = y[rows]
    n1, n0 = max(1, label.sum()), max(1, len(label) - label.sum())
    c1, c = np.zeros(1 << BITS), np.zeros(1 << BITS)
    chunks = range(0, len(owner), 1 << 20)
    for at in chunks:
        o, b = place[owner[at : at + (1 << 20)]], bucket[at : at + (1 << 20)]
        c += np.bincount(b[o >= 0], minlength=1 << BITS)
        c1 += np.bincount(b[o >= 0], label[o[o >= 0]], 1 << BITS)
    score = (c1 / n1 - (c - c1) / n0) ** 2 / (c + 3.0)
    score[c < 3] = 0
    chosen = np.sort(np.argsort(-score, kind="stable")[:most])
    chosen = chosen[score[chosen] > 0]
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    ones = [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32))]
    for at in chunks:
        o, k = place[owner[at : at + (1 << 20)]], column[bucket[at : at + (1 << 20)]]
        hit = (o >= 0) & (k >= 0)
        ones.append((o[hit], k[hit]))
    o, k = (np.concatenate(x) for x in zip(*ones, strict=True))
    w, chain, bias = _logistic(o, k, len(chosen), before[rows] / 4, label, penalty)
    return Linear(chosen, w, chain / 4, bias)


@dataclass
class Chain:
    """A fitted chain; `threshold` is for the last category's probability."""

    categories: tuple[str, ...]
    models: list[Linear | float] = field(default_factory=list)  # a number: the constant log odds where a class is missing
    threshold: float = 1.0
    f1: float = 0.0

    def table(self) -> np.ndarray:
        used = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[m.buckets for m in self.models if isinstance(m, Linear)]]))
        wanted = np.full(1 << BITS, -1, dtype=np.int64)
        wanted[used] = used
        return wanted

    def probabilities(self, texts: list[bytes], wanted: np.ndarray) -> np.ndarray:
        owner, bucket = features(texts, wanted)
        odds = np.zeros((len(texts), 0))
        for m in self.models:
            now = m.odds(owner, bucket, len(texts), odds) if isinstance(m, Linear) else np.full(len(texts), m)
            odds = np.column_stack([odds, np.clip(now, -8, 8)])
        return 1 / (1 + np.exp(-odds))


def fit(texts: list[bytes], labels: np.ndarray, categories: tuple[str, ...], *, folds: int = 4, most: int = 1500, penalty: float = 2e-4, share: tuple[float, float] = (1.0, 1.0)) -> Chain:
    """A chain over the columns of `labels` (rows by categories, 0 or 1), in their order. `share` is how many labelled rows
    a row without and a row with the last category stands for; the threshold counts rows so."""
    chain = Chain(categories)
    n = len(texts)
    count = np.zeros(1 << BITS, dtype=np.int64)
    for at in range(0, n, 100):
        count += np.bincount(features(texts[at : at + 100])[1], minlength=1 << BITS)
    kept = (count >= 3) & (count <= max(10, n * 9 // 20))  # what nearly every text has tells nothing
    total = int(count[kept].sum())
    owner, bucket, end = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int32), 0
    for at in range(0, n, 100):
        o, b = features(texts[at : at + 100])
        mine = kept[b]
        size = int(mine.sum())
        owner[end : end + size], bucket[end : end + size] = o[mine] + at, b[mine]
        end += size
    fold = np.random.default_rng(11).permutation(n) % folds
    before = np.zeros((n, 0))
    out = np.zeros(n)
    for k in range(len(categories)):
        y = labels[:, k].astype(np.int64)
        if n < 4 * folds or min(y.sum(), n - y.sum()) < folds:
            chain.models.append(float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else -8.0)
            before = np.column_stack([before, np.full(n, chain.models[-1])])
            out[:] = 0
            continue
        out = np.zeros(n)
        for f in range(folds):
            model = _fit(owner, bucket, np.flatnonzero(fold != f), y, before, most, penalty)
            mine = fold[owner] == f
            out[fold == f] = model.odds(owner[mine], bucket[mine], n, before)[fold == f]
        chain.models.append(_fit(owner, bucket, np.arange(n), y, before, most, penalty))
        before = np.column_stack([before, np.clip(out, -8, 8)])
    if chain.models and isinstance(chain.models[-1], Linear):
        order = np.argsort(-out)
        weight = np.where(labels[order, -1] == 1, share[1], share[0])
        hits = np.cumsum(weight * labels[order, -1])
        f1 = 2 * hits / (np.cumsum(weight) + hits[-1])
        best = int(np.argmax(f1))
        cut = out[order[best]] if best + 1 == n else (out[order[best]] + out[order[best + 1]]) / 2
        chain.threshold, chain.f1 = float(1 / (1 + np.exp(-cut))), float(f1[best])
    return chain


def train(docs: DataFrame, labels: DataFrame, *, positives: int = 1000, negatives: int = 2000) -> Chain:
    """The chain low quality -> toxic from documents and labels (doc_id, quality, toxic); rows with nulls don't count.

    Of several labels of a document the worst counts in each category, of several texts of an id the least. The `positives`
    toxic and `negatives` other labelled documents of least hash are the sample that is fitted. Without labels, or with too few
    of a kind, a model is the kind's base rate; an empty table gives a chain that rejects nothing.
    """
    known = need(labels, doc_id="long", quality="int", toxic="int").dropna().where("quality in (0, 1) and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("low"), F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = (max(1.0, size.get(0, 0) / negatives), max(1.0, size.get(1, 0) / positives))
    rank = known.withColumn("k", F.xxhash64("doc_id"))
    picked = rank.where("toxic = 1").orderBy("k", "doc_id").limit(positives).union(rank.where("toxic = 0").orderBy("k", "doc_id").limit(negatives))
    texts = need(docs, doc_id="long", text="string").dropna(subset=["doc_id"])
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("low").alias("low"), F.max("toxic").alias("toxic"))
    rows = sorted(rows.select("doc_id", normal("text").alias("words"), "low", "toxic").collect(), key=lambda r: r["doc_id"])
    label = np.array([[r["low"], r["toxic"]] for r in rows]).reshape(len(rows), 2)
    texts = [r["words"].encode() for r in rows]
    del rows
    chain = fit(texts, label, ("low_quality", "toxic"), share=share)
    del texts
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)  # the driver lives on; what training has used goes back
    return chain


def score(docs: DataFrame, chain: Chain, *, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carry` columns of each row with p_<category> of every category and `rejected` (the last is over its threshold).

    A null or empty text has no n-grams and gets the models' base probability; a text of any length is read whole. Rows are scored one by one: repeated
    rows get equal scores, no row is lost, an empty table gives no rows, and columns not carried are ignored.
    """
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = chain.table()
        for batch in batches:
            for first, texts in parts(batch.column(len(carry))):
                p = chain.probabilities(texts, wanted)
                rest = [c.slice(first, len(texts)) for c in batch.columns[: len(carry)]]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x) for x in p.T), pa.array(p[:, -1] >= chain.threshold)], [*carry, *names, "rejected"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{c} double" for c in names), "rejected boolean"])
    return docs.select(*carry, normal("text").alias("words")).mapInArrow(run, schema)


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(read(spark, sf_dir, "documents"), doc_id="long", text="string")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
