"""Exact substring removal over the whole corpus by suffix arrays.

Two equal windows of `least` bytes choose the same anchor inside them, the hashed `SEED`-gram of least value, so
windows that share an anchor's hash are the only ones that can be equal. A run of windows with one anchor is a
context. Anchors that occur once are settled by counting, and so are anchors with one and the same context. What
remains goes, one text for each different context, to tasks that hold whole anchor groups. There, ranges of windows whose
common bytes occur once, or with the same bytes around them throughout, are settled by counting, too; over the others a
Burrows-Wheeler transform is built and the repeated windows are found by bounded interval expansion (see bwt.py).

Skew: equal contexts are counted and represented once. An anchor with more than `most` different contexts is split
into narrower window ranges keyed by the bytes that all windows of the range share, and at last into single windows,
which counting settles; so no task gets an unbounded group and no window is left out.

Two lengths at once: equal windows of `least` bytes begin with equal windows of any shorter `floor` bytes, so contexts
by the anchors of the short windows, each with the bytes that its long windows add, serve both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.bwt import repeated
from quern.llm.common import cut, lookup, need, read, written
from quern.llm.text import _BYTES, mix, powers

#: Bytes of an anchor, at most; a third of the windows' length where that is less.
SEED = 128
#: Windows whose anchors are found at once.
STEP = 1 << 18
#: Bytes of contexts in one transform.
BATCH = 1 << 20


def _anchors(text: bytes, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, number of windows, anchor position, anchor hash) for all windows of `least` bytes, in order."""
    seed = min(SEED, least // 3)
    total, wide = len(text) - least + 1, least - seed + 1
    raw = np.frombuffer(text, dtype=np.uint8)
    for base in range(0, total, STEP):
        n = min(STEP, total - base)
        buf = raw[base : base + n + least - 1]
        up, down = powers(len(buf))
        prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[buf] * up, out=prefix[1:])
        value = mix((prefix[seed:] - prefix[:-seed]) * down[: len(buf) - seed + 1])
        low = (value & ~np.uint64(0xFFFFF)) | np.arange(len(value), dtype=np.uint64)  # ties go to the left
        span = 1
        while span * 2 <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        place = (low & np.uint64(0xFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        count = np.diff(np.append(start, n))
        where = place[start]
        yield from zip((start + base).tolist(), count.tolist(), (where + base).tolist(), value[where].view(np.int64).tolist(), strict=True)


def _digest(data: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(data, seed & 0xFFFFFFFF) - (1 << 63)


def contexts(docs: DataFrame, least: int, floor: int | None = None) -> DataFrame:
    """All contexts of (d, x, text): d, x, s (first window), n (windows), p (anchor's place in it), a (anchor), c (hash).

    The windows are of `floor` bytes, if given; the hash covers the bytes of those of `least` bytes at the same starts,
    as far as the text goes.
    """
    short = least if floor is None else floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for d, x, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = text.as_py().encode()
                if len(body) >= short:
                    for s, n, at, a in _anchors(body, short):
                        rows.append((d, x, s, n, at - s, a, _digest(body[s : s + n + least - 1], (at - s) << 16 ^ n)))
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list("dxsnpac"))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list("dxsnpac"))

    return docs.select("d", "x", "text").mapInArrow(run, "d long, x long, s int, n int, p int, a long, c long")


def _cells(n: int, p: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(cell, first window, number of windows) of n windows cut by their distance from the anchor at p, `width` to a cell."""
    j = 0
    while j < n:
        cell = (p - j) // width
        m = min(n - j, (p - j) - cell * width + 1)
        yield cell, j, m
        j += m


def _counted(group: list[tuple], length: int) -> tuple[list[tuple], list[tuple]]:
    """One anchor's contexts (g, c, cnt, n, p, body), as far as counting settles their windows of `length` bytes.

    Equal windows lie equally far from the anchor, so they share a cell and the bytes that all windows of the cell share.
    Cells whose bytes occur once are left out, those with the same windows throughout are repeated: (g, c, j, m, length), m
    windows from the j-th. The others are left open: (g, c, j, cnt, m, body).
    """
    width = max(1, length // 6)
    seen: dict[tuple[int, bytes], list] = {}
    rows = []
    for r in group:
        _, _, cnt, n, p, body = r
        own = []
        for cell, j, m in _cells(min(n, len(body) - length + 1), p, width):
            at = p - cell * width
            full = body[j : j + m + length - 1]
            entry = seen.setdefault((cell, body[at : at + length - width + 1]), [0, p - j, full, False])
            entry[0] += cnt
            entry[3] = entry[3] or entry[1] != p - j or entry[2] != full
            own.append((entry, j, m))
        rows.append((r, own))
    known, open_ = [], []
    for (g, c, cnt, _, _, body), own in rows:
        ranges: list[list] = []
        for entry, j, m in own:
            if entry[0] < 2:
                continue
            if ranges and ranges[-1][0] == entry[3] and ranges[-1][2] == j:
                ranges[-1][2] = j + m
            else:
                ranges.append([entry[3], j, j + m])
        for mixed, lo, hi in ranges:
            if mixed:
                open_.append((g, c, lo, cnt, hi - lo, body[lo : hi + length - 1]))
            else:
                known.append((g, c, lo, hi - lo, length))
    return known, open_


def _transform(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Repeated windows of (g, c, cnt, n, p, body) within each g, as (g, c, j, m, w): m windows of w bytes from the j-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        known: list[tuple] = []
        held: dict[int, list[tuple]] = {length: [] for length in lengths}
        size = dict.fromkeys(lengths, 0)

        def settle(length: int) -> list[tuple]:
            part, out, at = held[length], [], 0
            held[length], size[length] = [], 0
            hit = repeated([r[5] for r in part], np.array([r[4] for r in part]), np.array([r[3] for r in part]), length) if part else []
            for g, c, lo, _, m, _ in part:
                own = np.diff(np.concatenate([[0], hit[at : at + m].astype(np.int8), [0]]))
                out += [(g, c, lo + int(j), int(e - j), length) for j, e in zip(np.flatnonzero(own > 0), np.flatnonzero(own < 0), strict=True)]
                at += m
            return out

        def done(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list("gcjmw"))

        def close() -> None:
            for length in lengths:
                sure, part = _counted(group, length)
                known.extend(sure)
                held[length] += part
                size[length] += sum(len(r[5]) for r in part)
            group.clear()

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][0] == r[0] and group[-1][1] == r[1]:
                    continue  # the text of a repeated row
                if group and group[-1][0] != r[0]:
                    close()
                    for length in lengths:
                        if size[length] > BATCH:
                            yield done(settle(length))
                    if len(known) > 50_000:
                        yield done(known)
                        known.clear()
                group.append(r)
        close()
        yield done(known)
        for length in lengths:
            yield done(settle(length))

    return rows.select("g", "c", "cnt", "n", "p", "body").repartition("g").sortWithinPartitions("g", "c").mapInArrow(run, "g long, c long, j int, m int, w int")


def _split(rows: DataFrame, least: int, width: int) -> DataFrame:
    """The contexts (g, c, n, p, body) cut into ranges of at most `width` windows, keyed by the bytes common to a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3
        for batch in batches:
            out = []
            for g, c, n, p, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for cell, j, m in _cells(n, p, width):
                    core = body[p - cell * width : p - cell * width + least - width + 1]
                    key = _digest(core, (g ^ cell * 0x9E3779B1) & 0xFFFFFFFF)
                    out.append((key, _digest(body[j : j + m + least - 1], p - j), g, c, j, m, p - j))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["g", "c", "og", "oc", "oj", "n", "p"])

    return rows.select("g", "c", "n", "p", "body").mapInArrow(run, "g long, c long, og long, oc long, oj int, n int, p int")


def _settle(rows: DataFrame, lengths: tuple[int, ...], most: int, widths: tuple[int, ...]) -> DataFrame:
    """Repeated windows (g, c, j, m, w) of the different contexts (g, c, cnt, n, p, body), cnt their number of occurrences."""
    many = rows.groupBy("g").agg(F.count(F.lit(1)).alias("k")).withColumn("n_rows", F.col("k"))
    rows = cut(lookup(rows, many, "g", n="n_rows"))
    found = _transform(rows.where(F.col("k") <= most), lengths)
    hot = cut(rows.where(F.col("k") > most).drop("k"))
    if hot.isEmpty():
        return found
    for least in lengths:
        whole = hot.withColumn("n", F.least("n", F.length("body") - (least - 1))).where("n > 0")
        found = found.union(_narrow(whole.withColumn("body", F.expr(f"substring(body, 1, n + {least - 1})")), least, most, widths))
    return found


def _narrow(hot: DataFrame, least: int, most: int, widths: tuple[int, ...]) -> DataFrame:
    """`_settle` for windows of `least` bytes of anchors with too many contexts: by the bytes common to ranges of windows."""
    pieces = cut(_split(hot, least, widths[0]).join(hot.select(F.col("g").alias("og"), F.col("c").alias("oc"), "cnt"), ["og", "oc"]))
    total = pieces.groupBy("g").agg(F.sum("cnt").alias("all"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("all > 1")
    pieces = lookup(pieces, total.withColumn("n_rows", F.col("all")), "g", n="n_rows").where("all is not null")
    whole = pieces.where("lo = hi").select("og", "oc", "oj", F.col("n").alias("m"))
    if len(widths) > 1:
        open_ = cut(pieces.where("lo <> hi").drop("all", "lo", "hi"))
        one = open_.groupBy("g", "c").agg(F.sum("cnt").alias("cnt"), F.min(F.struct("og", "oc", "oj", "n", "p")).alias("r"))
        one = one.select("g", "c", "cnt", "r.*").join(hot.select(F.col("g").alias("og"), F.col("c").alias("oc"), "body"), ["og", "oc"])
        one = one.select("g", "c", "cnt", "n", "p", F.expr(f"substring(body, oj + 1, n + {least - 1})").alias("body"))
        found = _settle(one, (least,), most, widths[1:])
        part = open_.join(found, ["g", "c"]).select("og", "oc", (F.col("oj") + F.col("j")).alias("oj"), F.col("m"))
        whole = whole.union(part)
    return whole.select(F.col("og").alias("g"), F.col("oc").alias("c"), F.col("oj").alias("j"), "m", F.lit(least).alias("w"))


def repeated_windows(docs: DataFrame, *, least: int = 400, floor: int | None = None, most: int = 1024) -> DataFrame:
    """Windows of (d, x, text) that occur elsewhere too: (d, x, s, m, w), m windows from byte s.

    The windows are of w bytes, `least` or `floor`; where w is 0, of both, those of `least` as far as the text goes.
    """
    lengths = (least,) if floor is None else (least, floor)
    every = written(contexts(docs, least, floor))
    seen = every.groupBy("a").agg(F.count(F.lit(1)).alias("all"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("all > 1")
    shared = lookup(every, seen.withColumn("n_rows", F.col("all")), "a", n="n_rows").where("all is not null")
    shared = cut(shared.select("d", "x", "s", "n", "p", "a", "c", (F.col("lo") == F.col("hi")).alias("same")))
    whole = shared.where("same").select("d", "x", "s", F.col("n").alias("m"), F.lit(0).alias("w"))
    mixed = shared.where("not same")
    one = mixed.groupBy("a", "c").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("d", "x", "s", "n", "p")).alias("r"))
    wanted = one.select("r.d", "r.x", F.struct(F.col("a").alias("g"), "c", "cnt", "r.n", "r.p", "r.s").alias("w"))
    wanted = wanted.groupBy("d", "x").agg(F.collect_list("w").alias("w"))  # bounded by the document's length

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for text, want in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode()
                rows = [(w["g"], w["c"], w["cnt"], w["n"], w["p"], raw[w["s"] : w["s"] + w["n"] + least - 1]) for w in want.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["g", "c", "cnt", "n", "p", "body"])

    texts = docs.join(wanted, ["d", "x"]).select("text", "w").mapInArrow(bodies, "g long, c long, cnt long, n int, p int, body binary")
    found = _settle(cut(texts.dropDuplicates(["g", "c"])), lengths, most, (24, 1))
    part = mixed.join(found.select(F.col("g").alias("a"), "c", "j", "m", "w"), ["a", "c"])
    return whole.union(part.select("d", "x", (F.col("s") + F.col("j")).alias("s"), "m", "w"))


def _runs(spans: list[dict], width: int, size: int) -> list[list[int]]:
    """Maximal runs [from, to] of a text of `size` bytes that its repeated windows of `width` bytes cover."""
    runs: list[list[int]] = []
    for s, e in sorted((w["s"], min(w["s"] + w["m"] + width - 1, size)) for w in spans if w["w"] in (0, width)):
        if e - s < width:
            continue
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def remove_repeats(docs: DataFrame, *, least: int = 400, floor: int | None = None, most: int = 1024, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte covered by a `least`-byte string that also starts elsewhere in the corpus.

    One row per row of `docs`: doc_id, the `carry` columns, n_bytes, n_removed, n_spans (maximal removed runs), kept (the
    remaining bytes) and text (the remaining characters: a run is narrowed to whole characters). Texts are UTF-8 bytes, a
    null text is empty, and matches never cross rows. Repeated rows count as occurrences of each other, also with null
    doc_id. A text of any length is read whole, in steps. Overlapping occurrences count; repetition is judged on the input. An empty table gives no rows.

    A `floor` under `least` adds n_repeated, the bytes covered by a `floor`-byte string that also starts elsewhere: passages
    too short to be removed are only counted.
    """
    if floor is not None and not 0 < floor < least:
        raise ValueError("floor lies between 0 and least")
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("x"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *carry,
    )
    spans = repeated_windows(keyed.select("d", "x", "text"), least=least, floor=floor, most=most)
    spans = spans.groupBy("d", "x").agg(F.collect_set(F.struct("s", "m", "w")).alias("spans"))
    joined = keyed.join(spans, ["d", "x"], "left").select("doc_id", *carry, "text", "spans")
    kinds = dict(joined.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts = [], []
            for text, spans in zip(batch.column(len(carry) + 1), batch.column(len(carry) + 2), strict=True):
                whole = text.as_py()
                raw = whole.encode()
                found = spans.as_py() or []
                runs = _runs(found, least, len(raw))
                seen = 0 if floor is None else sum(b - a for a, b in _runs(found, floor, len(raw)))
                edge = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                if runs and not whole.isascii():
                    tail = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
                    for r in runs:
                        while tail(r[0]):
                            r[0] += 1
                        while tail(r[1]):
                            r[1] -= 1
                    edge = [0, *(x for r in runs for x in r), len(raw)]
                    texts.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)).decode())
                else:
                    texts.append(kept.decode())
                out.append((len(raw), len(raw) - len(kept), len(runs), kept, seen))
            n, gone, many, kept, seen = zip(*out, strict=True) if out else [[]] * 5
            arrays = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
            arrays += [pa.array(seen, pa.int64())][: len(more)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry) + 1], *arrays], ["doc_id", *carry, "n_bytes", "n_removed", "n_spans", "kept", "text", *more])

    more = [] if floor is None else ["n_repeated"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)), "n_bytes long", "n_removed long", "n_spans long", "kept binary", "text string", *(f"{c} long" for c in more)])
    return joined.mapInArrow(run, schema)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 400-byte strings that start elsewhere too, removed from all documents.

    `n_repeated` counts those covered by repeated strings of 240 bytes, which also finds passages of over 50 words.
    """
    done = remove_repeats(need(read(spark, sf_dir, "documents"), doc_id="long", text="string"), floor=240)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
