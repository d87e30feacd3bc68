"""MinHash near-duplicates by DartMinHash.

Every weighted element owns a plane of weight by rank, cut into cells of area one that hold Poisson(1) darts
placed by hashing. A document keeps the darts under its elements' weights and under a rank bound that leaves
about k (ln k + 3) of them, whatever its size; a hash deals darts to k coordinates and the earliest rank of each
is the signature. Bands of the signature join candidates, exact Jaccard on five-word shingles decides, and links
are closed into classes.

Skew: equal texts collapse to one representative before anything is banded; a bucket of few texts is compared pair by
pair in one task; a larger one is first compared as a star around its least text (n comparisons), and what that leaves
in several components is compared block by block over many tasks; classes come from contraction rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import components, cut, few, lookup, need, read
from quern.llm.text import mix, normal, parts, shingles, weighted_shingles

#: Texts in a block of a bucket, and their bytes (a longer text is a block of its own).
BLOCK, BYTES = 256, 1 << 23

#: Cumulative Poisson(1) probabilities: a cell has as many darts as bounds lie below its uniform number.
POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880], dtype=float))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(item: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of each element with weight under `weight` and rank under `bound`: (element index, dart id, rank)."""
    out = []
    for nu in range(int(np.log2(1 + weight.max())) + 1):
        for rho in range(int(np.log2(1 + bound.max())) + 1):
            low_w, low_r, step_w, step_r = 2.0**nu - 1, 2.0**rho - 1, 2.0 ** (nu - rho), 2.0 ** (rho - nu)
            at = np.flatnonzero((weight > low_w) & (bound > low_r))
            if not len(at):
                continue
            wide = np.minimum(np.ceil((weight[at] - low_w) / step_w), 2.0**rho).astype(np.int64)
            high = np.minimum(np.ceil((bound[at] - low_r) / step_r), 2.0**nu).astype(np.int64)
            cells = wide * high
            of = np.repeat(np.arange(len(at)), cells)
            c = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
            w, r = c // high[of], c % high[of]
            e = at[of]
            place = (np.uint64(nu << 58 | rho << 52) + (w.astype(np.uint64) << np.uint64(26)) + r.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            seed = mix(item[e] ^ place)
            many = np.searchsorted(POISSON, _uniform(seed + np.uint64(1)))
            for j in range(int(many.max(initial=0))):
                k = np.flatnonzero(many > j)
                dart = mix(seed[k] + np.uint64(0x51ED270B * (j + 2)))
                rank = low_r + step_r * (r[k] + _uniform(dart + np.uint64(3)))
                good = (low_w + step_w * (w[k] + _uniform(dart + np.uint64(5))) < weight[e[k]]) & (rank < bound[e[k]])
                out.append((e[k][good], dart[good], rank[good]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """k dart ids for each of n documents given as (document, element, weight); zeros for documents without elements."""
    out = np.zeros((n, k), dtype=np.uint64)
    total = np.bincount(doc, weight, n)
    todo, t = np.flatnonzero(total > 0), k * (np.log(k) + 3)
    while len(todo):
        mine = np.isin(doc, todo) if len(todo) < n else np.ones(len(doc), dtype=bool)
        d, x, w = doc[mine], item[mine], weight[mine]
        e, dart, rank = _throw(x, w, t / total[d])
        slot = d[e] * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, slot))
        slot, first = np.unique(slot[order], return_index=True)
        got = np.zeros((n, k), dtype=np.uint64)
        got.ravel()[slot] = dart[order][first] | np.uint64(1)
        out[todo] = got[todo]
        todo, t = todo[(got[todo] == 0).any(axis=1)], t * 2  # a coordinate without a dart: throw twice as many
    return out


def elements(texts: list[bytes], width: int, counts: bool) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of texts as (text, element). With `counts` the i-th occurrence of a shingle is an element of its own, so
    that set similarity of elements is weighted similarity of shingles."""
    if not counts:
        return shingles(texts, width)
    doc, item, n = weighted_shingles(texts, width)
    of = np.repeat(np.arange(len(doc)), n)
    i = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    return doc[of], item[of] ^ mix(i) * (i > 0)


def sketch(docs: DataFrame, bands: int, rows: int, width: int, *carry: str, counts: bool = False) -> DataFrame:
    """Band keys of each document's words: `docs` has the `carry` columns, then `words` as `normal` gives them. A shingle weighs
    one, or with `counts` as much as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for batch in batches:
            for first, texts in parts(batch.column(len(carry))):
                doc, item, n = weighted_shingles(texts, width)
                sig = signatures(doc, item, n.astype(float) if counts else np.ones(len(item)), len(texts), bands * rows).reshape(len(texts), bands, rows)
                key = np.zeros((len(texts), bands), dtype=np.uint64) + salt
                for r in range(rows):
                    key = mix(key ^ sig[:, :, r])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
                some = np.zeros(len(texts), dtype=bool)
                some[doc] = True
                rest = [c.slice(first, len(texts)) for c in batch.columns[: len(carry)]]
                yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(some)], [*carry, "keys", "some"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "keys array<long>", "some boolean"])
    return docs.select(*carry, "words").mapInArrow(run, schema)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, width: int, counts: bool = False) -> DataFrame:
    """The pairs (a, b) whose texts have a Jaccard similarity of `threshold` or more; `texts` has (h, words), h unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, np.ndarray] = (None, np.zeros(0))
        for batch in batches:
            a, b, wa, wb = (batch.column(i) for i in range(4))
            keep = []
            for first, texts_b in parts(wb):
                doc, item = elements(texts_b, width, counts)
                edge = np.searchsorted(doc, np.arange(len(texts_b) + 1))
                for i in range(len(texts_b)):
                    name = a[first + i].as_py()
                    if held[0] != name:
                        held = (name, elements([wa[first + i].as_py().encode()], width, counts)[1])
                    y = item[edge[i] : edge[i + 1]]
                    both = len(np.intersect1d(held[1], y, assume_unique=True))
                    keep.append(both >= threshold * (len(held[1]) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    joined = pairs.join(texts.select(F.col("h").alias("b"), F.col("words").alias("wb")), "b")
    joined = joined.join(texts.select(F.col("h").alias("a"), F.col("words").alias("wa")), "a")  # leaves each a's rows together
    kind = dict(pairs.dtypes)["a"]
    return joined.select("a", "b", "wa", "wb").mapInArrow(run, f"a {kind}, b {kind}")


def _bridges(sets: list[np.ndarray], labels: list, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between texts of different labels that join all that any such links would join, as places in `sets`.

    Texts are compared with one another, or where `right` marks some of them, the others with those.
    """
    n = np.array([len(x) for x in sets])
    owner, item = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    _, column, count = np.unique(item, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # an element of one text alone is in no intersection
    place = np.cumsum(count > 1) - 1
    owner, column = owner[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    two = bool(right.any())
    i, j = (np.flatnonzero(~right), np.flatnonzero(right)) if two else (np.arange(len(sets)),) * 2
    both = np.zeros((len(i), len(j)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        ones = np.zeros((len(sets), int(column[b - 1]) + 1 - at), dtype=np.float32)
        ones[owner[a:b], column[a:b] - at] = 1
        both += ones[i] @ ones[j].T
    code = {c: k for k, c in enumerate(dict.fromkeys(labels))}
    label = np.array([code[c] for c in labels])
    hit = (both > 0) & (both >= threshold * (n[i][:, None] + n[j][None, :] - both.astype(np.float64))) & (label[i][:, None] != label[j][None, :])
    x, y = np.nonzero(hit)
    _, first = np.unique(label[i[x]] * len(code) + label[j[y]], return_index=True)
    root, out = list(range(len(code))), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for u, v in zip(i[x[first]].tolist(), j[y[first]].tolist(), strict=True):
        a, b = find(int(label[u])), find(int(label[v]))
        if a != b:
            root[a] = b
            out.append((u, v))
    return out


def _compare(rows: DataFrame, threshold: float, width: int, counts: bool = False) -> DataFrame:
    """Links (a, b) within the groups g of (g, h, c, side, words) that join what any links between texts of different c would
    join. Texts of a group are compared with one another, or where `side` marks some, the others with those. Groups are
    of bounded size, by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, sets, kind = None, [], [], None

        def links() -> list[tuple]:
            if len(held) == 2 and held[0][1] != held[1][1]:
                both = len(np.intersect1d(*sets, assume_unique=True))
                good = both > 0 and both >= threshold * (len(sets[0]) + len(sets[1]) - both)
                return [(held[0][0], held[1][0])] if good else []
            if len({x[1] for x in held}) < 2:
                return []
            return [(held[u][0], held[v][0]) for u, v in _bridges(sets, [x[1] for x in held], np.array([x[2] for x in held]), threshold)]

        for batch in batches:
            kind, found = batch.schema.types[1], []
            rest = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            for first, words in parts(batch.column(4)):
                doc, item = elements(words, width, counts)
                edge = np.searchsorted(doc, np.arange(len(words) + 1))
                for k in range(len(words)):
                    if rest[first + k][0] != g:
                        found += links()
                        g, held, sets = rest[first + k][0], [], []
                    held.append(rest[first + k][1:])
                    sets.append(item[edge[k] : edge[k + 1]])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in range(2)], ["a", "b"])
        if held and (found := links()):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in range(2)], ["a", "b"])

    kind = dict(rows.dtypes)["h"]
    rows = rows.select("g", "h", "c", "side", "words").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def across(named: DataFrame, texts: DataFrame, threshold: float, width: int, counts: bool = False) -> DataFrame:
    """Links (a, b) that join whatever pairs of (bucket, h, size, c) with a bucket in common and different c join.

    The texts of a bucket are dealt to blocks and blocks compared with blocks, each pair of blocks in a task of its own
    choice; components that fill blocks get blocks of their own, so that they aren't compared with themselves.
    """
    open_ = named.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
    rows = cut(named.join(open_, "bucket"))
    part = rows.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("bytes"))
    part = part.withColumn("own", F.when((F.col("m") >= BLOCK) | (F.col("bytes") >= BYTES), F.col("c")))
    rows = rows.join(part.select("bucket", "c", "own"), ["bucket", "c"])
    pool = part.groupBy("bucket", "own").agg(F.ceil(F.greatest(F.sum("m") / BLOCK, F.sum("bytes") / BYTES)).alias("blocks"))
    same = rows.select("bucket", "h", "c", "own").alias("r").join(pool.alias("p"), F.expr("r.bucket = p.bucket and r.own <=> p.own"))
    block = F.xxhash64("r.bucket", "r.own", F.pmod(F.xxhash64("h"), "blocks"))
    dealt = cut(same.select("r.bucket", "h", "c", "r.own", block.alias("block")))
    heads = cut(dealt.select("bucket", "own", "block").distinct())
    other = heads.select("bucket", F.col("own").alias("own2"), F.col("block").alias("block2"))
    cells = heads.join(other, "bucket").where("block <= block2 and (own is null or own2 is null or own <> own2)")
    cells = cut(cells.select("bucket", "block", "block2", F.xxhash64("bucket", "block", "block2").alias("g")))
    sides = cells.select("bucket", "block", "g", F.lit(False).alias("side"))
    sides = sides.union(cells.where("block <> block2").select("bucket", "block2", "g", F.lit(True)))
    return _compare(dealt.join(sides, ["bucket", "block"]).select("g", "h", "c", "side").join(texts.select("h", "words"), "h"), threshold, width, counts)


def open_buckets(keys: DataFrame) -> DataFrame:
    """Of the buckets (bucket, h, size) those of several h, and of buckets with the same h one: bucket, h, size, n, bytes."""
    info = keys.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("h").alias("a"), F.max("h").alias("z"), F.bit_xor(F.xxhash64("h")).alias("all"),
    ).where("n > 1")
    one = info.groupBy("n", "a", "z", "all").agg(F.min(F.struct("bucket", "bytes")).alias("b")).select("b.bucket", "n", "b.bytes")
    return cut(keys.join(one, "bucket"))


def link_buckets(members: DataFrame, texts: DataFrame, threshold: float, width: int, counts: bool = False) -> DataFrame:
    """Verified links (a, b) that join all texts of each bucket that links between its texts would join.

    `members` are as `open_buckets` gives them; `texts` has (h, words) of all their h. A bucket of at most BLOCK texts and
    BYTES bytes is compared pair by pair in one task. A larger one is compared with its least text first; where that leaves
    several components, blocks of its texts are compared with one another, save texts of one component.
    """
    small = (F.col("n") <= BLOCK) & (F.col("bytes") <= BYTES)
    groups = members.where(small).select(F.xxhash64("bucket").alias("g"), "h", F.col("h").alias("c"), F.lit(False).alias("side"))
    links = cut(_compare(groups.join(texts.select("h", "words"), "h"), threshold, width, counts))
    large = cut(members.where(~small).select("bucket", "h", "size"))
    if large.isEmpty():
        return links
    least = large.groupBy("bucket").agg(F.min("h").alias("a"))
    pairs = large.join(least, "bucket").where("a <> h").select("a", F.col("h").alias("b")).distinct()
    links = cut(links.union(verify(pairs, texts, threshold, width, counts)))
    named = large.join(components(links).withColumnRenamed("id", "h"), "h", "left")
    named = named.select("bucket", "h", "size", F.coalesce("component", "h").alias("c"))
    return cut(links.union(across(named, texts, threshold, width, counts)))


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, width: int = 5, bands: int = 25, rows: int = 5, counts: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size, kept (it is that document), words_md5.

    Two texts link at a Jaccard similarity of `threshold` or more (0.8 itself included) on `width`-word shingles of their
    lower-case words; with `counts` at such a weighted similarity, a shingle's weight being how often it occurs. Texts equal in words always share a class, save texts without words: each of those is a class of its
    own. A null text has no words. A null doc_id is kept as a row, never leads a class that has another id, and shares its
    text's class. Repeated rows stay rows. One id may have several texts: each is in the class of its words, and where the least id
    of a class has several texts in it, that of least words_md5 (MD5 of `normal` text) is kept. Shorter texts are one shingle; very long ones are hashed whole, in parts of
    2 MB at a time. An empty table gives no rows. Other columns are ignored.
    """
    docs = need(docs, doc_id="long", text="string").select("doc_id", normal("text").alias("words"))
    keyed = docs.select("doc_id", F.unhex(F.md5("words")).alias("h"), F.length("words").alias("size"), "words")
    names = cut(sketch(keyed, bands, rows, width, "doc_id", "h", "size", counts=counts))
    some = names.where("some")
    one = some.groupBy("h").agg(F.first("keys").alias("keys"), F.first("size").alias("size"))
    keys = one.select("h", "size", F.posexplode("keys").alias("band", "key")).select(F.struct("band", "key").alias("bucket"), "h", "size")
    members = open_buckets(keys)
    texts = cut(keyed.join(few(members.select("h").distinct()), "h").dropDuplicates(["h"]).select("h", "words"))
    label = components(link_buckets(members, texts, threshold, width, counts))
    # Per text first, so that no class and no text's copies have to meet in one task.
    per = some.groupBy("h").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    linked = per.join(label.withColumnRenamed("id", "h"), "h", "left").select("h", "least", "n", F.coalesce("component", "h").alias("c"))
    linked = cut(linked)
    lead = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "h")).alias("lead")
    classes = linked.groupBy("c").agg(lead, F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n")).where("class_size > 1")
    sizes = linked.withColumnRenamed("n", "copies")
    table = lookup(sizes, classes, "c").where("class_size is not null").select("h", F.col("copies").alias("n"), F.col("lead.least").alias("class_id"), F.col("lead.h").alias("leader"), "class_size")
    rows_ = some.select("doc_id", "h")
    out = lookup(rows_, table, "h").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("leader", "h").alias("leader"), "h")
    alone = names.where("not some").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.col("h").alias("leader"), "h")
    kept = F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("h") == F.col("leader")), F.lit(False))
    return out.unionByName(alone).select("doc_id", "class_id", "class_size", kept.alias("kept"), F.col("h").alias("words_md5"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("words_md5")
