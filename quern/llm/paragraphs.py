"""Near-duplicate paragraphs by MinHash banding.

A paragraph is a content-defined run of words: it starts where the hash of two words is the least of its surroundings,
whatever line breaks there are, so that a passage that many documents hold is cut alike in all of them, also where it
begins and ends inside a line. Runs cover the whole text and have more than `reach` words (shorter texts are one run).
Different paragraphs get MinHash signatures over five-word shingles; bands are tuned so that a pair at the threshold
collides with the wanted recall; colliding paragraphs are compared, exact Jaccard decides, and components of the links
are classes. The first paragraph of a class stays, the others are removals.

Skew: equal paragraphs count once however often they occur, buckets are compared as in near.py, and only hashes, never
texts, are shuffled before candidates are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import components, cut, few, lookup, need, read, written
from quern.llm.near import link_buckets, open_buckets
from quern.llm.text import Words, mix, passages

# Characters of scripts written without spaces (kana, Han, Thai, Lao, Khmer, Burmese); each is a word.
UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1780-\u17ff\u1000-\u109f"
_ONE, WORD = re.compile(f"[{UNSPACED}]"), re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
#: Rows of single numbers, and of single hashes, that may be broadcast: some 100 MB.
NUMBERS, HASHES = 1 << 22, 1 << 20
#: Bytes of texts that are hashed at once; a longer text is hashed alone.
PART = 1 << 21


def words(text: str) -> list[str]:
    """The words of a text in lower case: what blanks part, and single characters of scripts without blanks."""
    text = text.lower()
    return text.split() if text.isascii() or not _ONE.search(text) else WORD.findall(text)


def tune(threshold: float, recall: float) -> tuple[int, int]:
    """(bands, rows): the fewest bands, of three rows or more, that let a pair at the threshold collide with `recall`."""
    best = None
    for rows in range(3, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        best = min(best or (bands, -rows), (bands, -rows))
    return best[0], -best[1]


def _parted(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    run, size, first = [], 0, 0
    for i, x in enumerate(texts):
        text = " ".join(words(x)).encode()
        if run and size + len(text) > PART:
            yield first, run
            run, size, first = [], 0, i
        run.append(text)
        size += len(text) + 1
    if run:
        yield first, run


def _sketch(docs: DataFrame, bands: int, rows: int, width: int, reach: int) -> DataFrame:
    """The paragraphs of (d, x, text): d, x, pos (first word, from 0), len (words), h (128-bit hash of its words), size (bytes)
    and keys (its `bands`, none of them if `bands` is 0)."""
    salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _parted([x or "" for x in batch.column(2).to_pylist()]):
                w = Words(texts)
                start, stop = passages(w, reach)
                if not len(start):
                    continue
                key = np.zeros((len(start), bands), dtype=np.uint64)
                if bands:
                    size = np.maximum(stop - start - width + 1, 1)  # a paragraph shorter than a shingle is one shingle
                    low = np.cumsum(size) - size
                    i = np.repeat(start - low, size) + np.arange(int(size.sum()))
                    item = w.hashes(i, np.minimum(i + width, np.repeat(stop, size)) - 1)
                    for j, s in enumerate(salt):
                        key[:, j // rows] = mix(key[:, j // rows] * np.uint64(31) + np.minimum.reduceat(mix(item * s), low) + s)
                    key = mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
                raw, b, e = w.buf.tobytes(), w.begin[start].tolist(), w.end[stop - 1].tolist()
                h = [xxhash.xxh3_128_digest(raw[y:z]) for y, z in zip(b, e, strict=True)]
                edge = pa.array(np.arange(len(start) + 1, dtype=np.int32) * bands)
                keys = pa.ListArray.from_arrays(edge, pa.array(key.view(np.int64).ravel(), pa.int64()))
                of = w.owner[start]
                rest = [c.slice(at, len(texts)).take(pa.array(of)) for c in batch.columns[:2]]
                first = w.last[of] - w.count[of]
                numbers = [pa.array(x.astype(np.int32)) for x in (start - first, stop - start)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, *numbers, pa.array(h, pa.binary()), pa.array((np.array(e) - np.array(b)).astype(np.int32)), keys],
                    ["d", "x", "pos", "len", "h", "size", "keys"],
                )

    return docs.select("d", "x", "text").mapInArrow(run, "d long, x long, pos int, len int, h binary, size int, keys array<long>")


def _texts(docs: DataFrame, names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, words) of the `wanted` paragraphs, each taken from one document."""
    one = names.join(wanted, "h").groupBy("h").agg(F.min(F.struct("d", "x", "pos", "len")).alias("r"))
    per = cut(one.groupBy("r.d", "r.x").agg(F.collect_list(F.struct("h", "r.pos", "r.len")).alias("want")))  # bounded by a document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, want in zip(batch.column(0), batch.column(1), strict=True):
                w = words(text.as_py() or "")
                h, body = zip(*((v["h"], " ".join(w[v["pos"] : v["pos"] + v["len"]])) for v in want.as_py()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(body, pa.string())], ["h", "words"])

    docs = docs.join(few(per.select("d", "x")), ["d", "x"], "left_semi").dropDuplicates(["d", "x"])
    return docs.join(per, ["d", "x"]).select("text", "want").mapInArrow(run, "h binary, words string")


def paragraph_classes(docs: DataFrame, *, threshold: float = 0.8, width: int = 5, reach: int = 7, recall: float = 0.995) -> DataFrame:
    """The paragraphs of (d, x, text) whose class has others: d, x, pos, len, class_d, class_pos, kept."""
    bands, rows = tune(threshold, recall)
    names = written(_sketch(docs, 0, rows, width, reach).drop("keys"))
    # Bands are made twice rather than written: they are most of what a paragraph's row would hold.
    keys = _sketch(docs, bands, rows, width, reach).select(F.explode("keys").alias("bucket"), "h", "size")
    # A bucket of one paragraph, however often it occurs, is settled by one combinable number: each of 16 bits of the hash sets
    # one of two bits, so that different hashes set more than 16 together.
    x = F.hash("h").bitwiseAND(F.lit(0xFFFF)).cast("long")  # an int with its sign bit set would count as 32 bits more
    code = F.shiftleft(x, 16).bitwiseOR(x.bitwiseXOR(F.lit(0xFFFF).cast("long")))
    seen = keys.groupBy("bucket").agg(F.bit_or(code).alias("bits")).where(F.bit_count("bits") > 16).select("bucket")
    members = open_buckets(keys.join(few(seen, NUMBERS), "bucket").dropDuplicates(["bucket", "h"]))
    texts = cut(_texts(docs, names, few(members.select("h").distinct(), HASHES)))
    label = components(link_buckets(members, texts, threshold, width))
    label = few(label.withColumnRenamed("id", "h"))
    copied = names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    some = cut(names.select("d", "x", "pos", "len", "h").join(few(copied.union(label.select("h")).distinct(), HASHES), "h"))
    per = some.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("d", "x", "pos")).alias("first"))
    linked = cut(per.join(label, "h", "left").select("h", "copies", "first", F.coalesce("component", "h").alias("c")))
    classes = linked.groupBy("c").agg(F.min("first").alias("class"), F.count(F.lit(1)).alias("n"))
    table = lookup(linked.select("h", "copies", "c"), classes, "c").select("h", F.col("copies").alias("n"), "class")
    out = lookup(some, table, "h").where("class is not null")
    same = (F.col("d") == F.col("class.d")) & (F.col("x") == F.col("class.x")) & (F.col("pos") == F.col("class.pos"))
    return out.select("d", "x", "pos", "len", F.col("class.d").alias("class_d"), F.col("class.pos").alias("class_pos"), same.alias("kept"))


def _keyed(docs: DataFrame) -> DataFrame:
    docs = need(docs, doc_id="long", text="string")
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("x"), "text")


def near_paragraphs(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_repeated (paragraphs whose class has others, the one that stays included), n_removed,
    removed (first word from 0, and number of words) and classes (of the repeated ones, as doc_id:word of the class's
    first paragraph).

    Null and empty texts have no paragraphs. A text of at most `reach` words is one paragraph, and one of fewer than `width`
    words one shingle, so that equal short texts are a class. Very long texts are cut like others, each hashed in one go.
    Rows equal in doc_id and text count as one document's copies: the first stays in all of them. A null doc_id comes
    before all others. An empty table gives no rows; other columns are ignored.
    """
    keyed = _keyed(docs)
    hits = paragraph_classes(keyed.select("d", "x", "text"), **options)
    name = F.concat_ws(":", F.col("class_d").cast("string"), F.col("class_pos").cast("string"))
    per = hits.groupBy("d", "x").agg(  # bounded by a document
        F.sort_array(F.collect_set(F.when(~F.col("kept"), F.struct("pos", "len")))).alias("removed"),
        F.sort_array(F.collect_set(name)).alias("classes"), F.countDistinct("pos").alias("n_repeated"),
    )
    out = keyed.select("doc_id", "d", "x").join(per, ["d", "x"], "left")
    removed = F.coalesce("removed", F.array().cast("array<struct<pos:int,len:int>>"))
    return out.select(
        "doc_id", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.size(removed).cast("long").alias("n_removed"),
        removed.alias("removed"), F.coalesce("classes", F.array().cast("array<string>")).alias("classes"),
    )


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) with the words of the removed paragraphs left out, and the blanks after them; the rest is as it was.

    Null texts stay null; repeated rows, null ids, empty tables and other columns are as in `near_paragraphs`.
    """
    keyed = _keyed(docs)
    gone = paragraph_classes(keyed.select("d", "x", "text"), **options).where("not kept")
    gone = gone.groupBy("d", "x").agg(F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if spans:
                    at, kept = [m.start() for m in WORD.finditer(text)] if _ONE.search(text) else [m.start() for m in re.finditer(r"\S+", text)], []
                    last = 0
                    for s in spans:
                        kept.append(text[last : at[s["pos"]]])
                        last = at[s["pos"] + s["len"]] if s["pos"] + s["len"] < len(at) else len(text)
                    text = "".join([*kept, text[last:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return keyed.join(gone, ["d", "x"], "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, text string")


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_paragraphs(read(spark, sf_dir, "documents"))
