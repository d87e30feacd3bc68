"""Vectorized hashing of word shingles over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_power: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_power.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _power[name] = np.multiply.accumulate(step)
    return _power["up"][:n], _power["down"][:n]


def normal(text: str | Column) -> Column:
    """Lower case with single spaces: the form whose words make shingles. Null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"\s+", " "))


class Words:
    """The words of texts in the form that `normal` gives, all in one buffer: `begin` and `end` of each word, its text
    (`owner`) and one past the last word of each text (`last`)."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        up, self.down = powers(len(self.buf))
        self.prefix = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[self.buf] * up, out=self.prefix[1:])
        gap = self.buf == 32
        self.begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        first = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1] + 1
        self.owner = np.searchsorted(first, self.begin, side="right") - 1
        self.count = np.bincount(self.owner, minlength=len(texts))
        self.last = np.cumsum(self.count)

    def hashes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the strings from word i to word j, both included."""
        b, e = self.begin[i], self.end[j]
        return mix(((self.prefix[e] - self.prefix[b]) * self.down[b]) ^ ((e - b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `width`-word shingles, as (index of the text, hash), ascending by both.

    Texts are in the form that `normal` gives. A text of fewer words has one shingle of all its words;
    a text without words has none.
    """
    doc, value, _ = weighted_shingles(texts, width)
    return doc, value


def weighted_shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`shingles`, and how often each occurs in its text."""
    w = Words(texts)
    if not len(w.begin):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    i = np.arange(len(w.begin))
    full = i + width <= w.last[w.owner]
    short = (w.count[w.owner] < width) & (i == w.last[w.owner] - w.count[w.owner])
    pick = np.flatnonzero(full | short)
    value = w.hashes(pick, np.where(full[pick], pick + width - 1, w.last[w.owner[pick]] - 1))
    order = np.lexsort((value, w.owner[pick]))
    doc, value = w.owner[pick][order], value[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(keep)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def passages(w: Words, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (one past) of content-defined runs of words that cover all texts.

    A run starts at each word whose hash with its next word is the least of the `reach` words before and after it, so
    that a passage is cut alike wherever it stands; runs have more than `reach` words, and those at the ends of a text twice
    as many, save where the text has fewer.
    """
    n = len(w.begin)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i = np.arange(n)
    value = w.hashes(i, np.minimum(i + 1, w.last[w.owner] - 1)) >> np.uint64(1)
    place = i + reach * (w.owner + 1)  # gaps between texts
    wide = np.full(place[-1] + reach + 1, np.uint64(1 << 63))
    wide[place] = value
    view = np.lib.stride_tricks.sliding_window_view(wide, reach)
    before, after = view[place - reach].min(axis=1), view[place + 1].min(axis=1)
    first = i == w.last[w.owner] - w.count[w.owner]
    start = np.flatnonzero(first | ((value < before) & (value <= after)))
    size = np.diff(np.append(start, n))
    # At an end of its text a run may be no more than a stock phrase: a short first run joins the next, a short last one
    # the one before.
    short, head = size < 2 * (reach + 1), first[start]
    tail = np.append(head[1:], True)
    drop = ~head & ((tail & short) | np.append(False, (head & short)[:-1]))
    start = start[~drop]
    return start, np.append(start[1:], n)


def parts(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of an Arrow string column as bytes, in runs of about `most` bytes, each with its first row."""
    run: list[bytes] = []
    size = first = 0
    for i, x in enumerate(column):
        text = (x.as_py() or "").encode()
        if run and size + len(text) > most:
            yield first, run
            run, size, first = [], 0, i
        run.append(text)
        size += len(text) + 1
    if run:
        yield first, run
