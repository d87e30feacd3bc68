"""Hierarchical multi-length packing.

Documents are tokenized, cut into whole long windows plus a remainder, and each remainder is routed to the
shortest context tier that holds it. Every tier is packed from its own documents; what a window lacks is filled
from shorter tiers, first with whole pieces (best fit) and then by cutting one. Windows of one tier form step
groups of equal token counts. All of it happens inside a partition and in bounded memory, so there is no shuffle:
a partition's last windows are cut along powers of two and nothing is ever padded.

Ids come from the byte-level vocabulary `byte_bpe_50k`; its rank file run by tiktoken gives the ids that the
tokenizers library gives for the JSON file (tests hold the two together) at several times the speed. The JSON file's
added tokens are one id each, as that library has it by default.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import need, read

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)
#: A text longer than this is tokenized in parts, cut only where the vocabulary's split pattern cuts anyway.
PART_CHARS = 1 << 17


def encoder(vocabulary: str | None = None, special: bool = True):
    """A function text -> list of ids. `vocabulary` is the path of a rank file; by default the public byte-level one, whose
    added tokens get their own ids unless `special` is off; then they are text like any other."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART_CHARS:
            end = at + PART_CHARS
            while end < len(text) - 1 and not (text[end] == " " and text[end + 1].isalpha() and not text[end - 1].isspace()):
                end += 1
            if end >= len(text) - 1:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(text: str) -> list[int]:
        if len(text) <= PART_CHARS:
            return core.encode_ordinary(text)
        return [i for part in parts(text) for i in core.encode_ordinary(part)]

    if not special:
        return encode
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    if not added:
        return encode
    find = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")

    def encode_special(text: str) -> list[int]:
        pieces = find.split(text)
        if len(pieces) == 1:
            return encode(text)
        return [i for k, piece in enumerate(pieces) if piece for i in ([added[piece]] if k % 2 else encode(piece))]

    return encode_special


class Packer:
    """Packs the documents of one partition. `emit` gets (doc, start, ids, doc_tokens, sequence, offset, tier, group)."""

    def __init__(self, first_id: int, emit, window: int, tiers: tuple[int, ...], pool: int, step_tokens: int):
        self.next_id, self.first_id, self.emit, self.window, self.tiers = first_id, first_id, emit, window, tiers
        self.pool_size, self.step_tokens = pool, step_tokens
        self.pool: list[tuple[int, int]] = []  # (length, key), ascending
        self.pieces: dict[int, tuple] = {}  # key -> (doc, start, ids, doc_tokens)
        self.keys = 0
        self.made: dict[int, int] = {}  # windows so far by tier

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self.write([(doc, at, ids[at : at + self.window], total)], self.window)
        if whole < total:
            self.push((doc, whole, ids[whole:], total))
        if len(self.pool) >= self.pool_size:
            self.pack(self.pool_size // 2)

    def push(self, piece: tuple) -> None:
        self.keys += 1
        self.pieces[self.keys] = piece
        insort(self.pool, (len(piece[2]), self.keys))

    def pop(self, at: int) -> tuple:
        return self.pieces.pop(self.pool.pop(at)[1])

    def write(self, parts: list[tuple], tier: int) -> None:
        n = self.made[tier] = self.made.get(tier, 0) + 1
        group = self.first_id + (tier << 20) + (n - 1) * tier // self.step_tokens
        offset = 0
        for doc, start, ids, total in parts:
            self.emit((doc, start, ids, total, self.next_id, offset, tier, group))
            offset += len(ids)
        self.next_id += 1

    def pack(self, keep: int) -> None:
        """Make windows, longest pieces first, until `keep` pieces are left; a window it can't fill goes back."""
        while len(self.pool) > keep:
            parts = [self.pop(-1)]
            size = len(parts[0][2])
            tier = next(t for t in self.tiers if t >= size)
            gap = tier - size
            while gap and self.pool:
                at = bisect_right(self.pool, (gap, self.keys + 1)) - 1
                if at < 0:  # every piece is longer than the gap: cut the shortest
                    doc, start, ids, total = self.pop(0)
                    parts.append((doc, start, ids[:gap], total))
                    self.push((doc, start + gap, ids[gap:], total))
                    gap = 0
                else:
                    parts.append(self.pop(at))
                    gap -= len(parts[-1][2])
            if gap:
                return self.halve(parts)
            self.write(parts, tier)

    def halve(self, parts: list[tuple]) -> None:
        """The last pieces of the partition, cut along powers of two."""
        left = sum(len(p[2]) for p in parts)
        while left:
            tier = 1 << (left.bit_length() - 1)
            room, row = tier, []
            while room:
                doc, start, ids, total = parts.pop(0)
                row.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    parts.insert(0, (doc, start + room, ids[room:], total))
                room -= len(row[-1][2])
            self.write(row, tier)
            left -= tier

    def close(self) -> None:
        self.pack(0)


def pack(
    docs: DataFrame, *, window: int = 2048, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1,
    pool: int = 1024, step_tokens: int = 32768, vocabulary: str | None = None, special: bool = True,
) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most `window` tokens; one row per piece of a document.

    Columns: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id,
    offset in the sequence, tier (the sequence's length) and step_group (sequences of one tier, `step_tokens` ids).
    A null text counts as empty and yields the end id alone; a null doc_id is kept; repeated rows are packed as
    often as they occur; a text of any length is encoded whole, in parts that its own split pattern separates; an empty
    table gives no rows; other columns are ignored. `special` is as in `encoder`.
    """
    tiers = tuple(sorted(t for t in tiers if t < window)) + (window,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary, special)
        rows: list[tuple] = []
        packer = Packer(TaskContext.get().partitionId() << 40, rows.append, window, tiers, pool, step_tokens)

        def flush() -> pa.RecordBatch:
            doc, start, ids, total, seq, offset, tier, group = zip(*rows, strict=True)
            rows.clear()
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
            columns = [doc, start, [len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids], total, seq, offset, tier, group]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.array([*encode(text.as_py() or ""), end_id], dtype=np.uint32))
                if len(rows) >= 2000:
                    yield flush()
        packer.close()
        if rows:
            yield flush()

    return need(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed at 2048 tokens; the ids of each piece are given as their CRC-32."""
    return pack(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )
