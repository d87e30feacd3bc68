"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

A text is cut into marked words, each a run of word marks and what follows it; where no piece goes on from a letter to
a mark, words can be segmented alone. The distinct words of a batch are sorted, which is a depth-first walk of their
trie: the best scores up to the prefix shared with the word before are kept, and only what follows is scored. The best
path maximizes the sum of piece scores; of equal paths the one whose last piece is longest wins; characters without a
piece score below all pieces and are written as byte pieces where the model has them.

The public model is of the merging kind; its pieces and scores are used here as a unigram model's, and tests
compare the ids with brute-force Viterbi.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import need, read

MARK = "▁"
#: Words whose ids a task keeps at most; then it starts anew.
KEPT = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[str]
    score: dict[str, float]  # of the pieces that match text
    id_of: dict[str, int]
    byte_id: list[int]  # of the 256 byte pieces, or empty
    unknown: int
    unknown_score: float
    prefix: bool  # a mark goes before the text
    squeeze: bool  # white space is trimmed and runs are one

    @classmethod
    def load(cls, path: str | None = None) -> Model:
        import public_tokenizers

        with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            data = f.read()
        pieces, kinds, scores, prefix, squeeze = [], [], [], True, True
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                kinds.append(x.get(3, 1))
            elif number == 3:
                x = dict(_fields(value))
                if x.get(2):
                    raise ValueError("models with a character map aren't supported")
                prefix, squeeze = bool(x.get(3, 1)), bool(x.get(4, 1))
        score = {p: s for p, s, k in zip(pieces, scores, kinds, strict=True) if k in (1, 4)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in score):
            raise ValueError("a piece of this model crosses words")
        ids = {p: i for i, p in enumerate(pieces)}
        some = [ids[f"<0x{b:02X}>"] for b in range(256)] if kinds.count(6) == 256 else []
        normal = [s for s, k in zip(scores, kinds, strict=True) if k == 1]
        return cls(pieces, score, ids, some, kinds.index(2), min(normal) - 10.0, prefix, squeeze)

    def words(self, text: str) -> list[str]:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", (MARK if self.prefix else "") + text.replace(" ", MARK))

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of each of the sorted distinct words; forward scores are shared along common prefixes."""
        ends: dict[str, float | None] = {p[i:]: None for p in self.score for i in range(len(p))}
        ends.update(self.score)  # pieces with their scores, and what pieces end with
        lowest, none = self.unknown_score, object()
        best, back, last = [0.0], [0], ""
        for word in words:
            same, end = 0, min(len(word), len(last))
            while same < end and word[same] == last[same]:
                same += 1
            del best[same + 1 :], back[same + 1 :]
            for e in range(same + 1, len(word) + 1):
                start, top = e - 1, (best[e - 1] + lowest if ends.get(word[e - 1]) is None else None)
                for s in range(e - 1, -1, -1):
                    now = ends.get(word[s:e], none)
                    if now is none:
                        break
                    if now is not None and (top is None or best[s] + now >= top):
                        top, start = best[s] + now, s
                best.append(top)
                back.append(start)
            last = word
            yield word, self._path(word, back)

    def _path(self, word: str, back: list[int]) -> list[int]:
        out: list[int] = []
        e = len(word)
        while e:
            s = back[e]
            piece = word[s:e]
            if piece in self.score:
                out.append(self.id_of[piece])
            elif self.byte_id:
                out += [self.byte_id[b] for b in reversed(piece.encode())]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            e = s
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; unknown and control pieces have none, and null or an id that the model lacks is one
        replacement character."""
        if not hasattr(self, "_raw"):
            special = {self.unknown, *(i for i, p in enumerate(self.pieces) if p not in self.score)} - set(self.byte_id)
            self._raw = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
            for b, i in enumerate(self.byte_id):
                self._raw[i] = bytes([b])
        n = len(self._raw)
        text = b"".join([self._raw[i] if i is not None and 0 <= i < n else b"\xef\xbf\xbd" for i in ids]).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, *, model: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carry` columns with `ids` (array<int>) of the text and `same`: whether decoding gives the text back.

    A null text has null ids and null `same`; an empty one has no ids. The mark itself, written in a text, decodes as
    a space. Rows are encoded one by one: repeated rows alike, a text of any length whole; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(model)
        known: dict[str, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(len(carry)).to_pylist()
                split = [None if t is None else m.words(t) for t in texts]
                if len(known) > KEPT:  # the words known longest go
                    for w in list(islice(known, len(known) // 2)):
                        del known[w]
                known.update(m.encode_words(sorted({w for ws in split if ws for w in ws} - known.keys())))
                ids = [None if ws is None else [i for w in ws for i in known[w]] for ws in split]
                same = [None if t is None else m.decode(i) == t for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], [*carry, "ids", "same"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "ids array<int>", "same boolean"])
    return docs.select(*carry, F.col("text").cast("string")).mapInArrow(run, schema)


def decode(rows: DataFrame, *, model: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carry` columns with the `text` of `ids`; a null list gives a null text. Repeated rows are decoded alike, an empty
    table gives no rows, and other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(model)
        for batch in batches:
            texts = [None if i is None else m.decode(i) for i in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(texts, pa.string())], [*carry, "text"])

    kinds = dict(rows.dtypes)
    return rows.select(*carry, "ids").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "text string"]))


def op9_shared_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded: number of ids, a hash of them, and whether decoding gives the text back."""
    done = encode(need(read(spark, sf_dir, "documents"), doc_id="long", text="string"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "same")
