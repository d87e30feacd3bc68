"""Threshold-bounded longest common prefixes from a Burrows-Wheeler transform.

Intervals of the suffix array are extended backward, breadth first: the intervals of all strings of length l give
those of length l + 1, and an interval whose right end has no value yet ends a match of exactly l characters there.
Values thus appear in increasing order, and the search stops at the threshold: ends without a value lie inside
matches of at least that length.
"""

from __future__ import annotations

import numpy as np


def rotations(text: np.ndarray, length: int) -> np.ndarray:
    """Start positions of the rotations of `text`, in the order of their first `length` characters or more."""
    n = len(text)
    word = np.zeros(n, dtype=np.uint64)
    wide = np.concatenate([text, np.resize(text, 8)])
    for j in range(8):
        word = (word << np.uint64(8)) | wide[j : j + n]
    order = np.argsort(word, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = word[order][1:] != word[order][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # the first place of the equal ones
    h = 8
    while h < length:
        alone = fresh & np.append(fresh[1:], True)
        at = np.flatnonzero(~alone)  # places whose rotation isn't told from its neighbours yet
        if not len(at):
            break
        pos = order[at]
        key = (rank[pos].astype(np.uint64) << np.uint64(32)) | rank[(pos + h) % n].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        pos, key = pos[by], key[by]
        order[at] = pos
        new = np.ones(len(at), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        fresh[at] = new
        rank[pos] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        h *= 2
    return order


def short_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """The common prefix of each rotation with the one before, where under `least`; -1 where it is `least` or more."""
    n = len(text)
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = np.arange(n)
    before = (order - 1) % n
    bwt, last_first = text[before], inverse[before]
    lcp = np.full(n + 1, -1, dtype=np.int32)
    lcp[[0, n]] = 0
    lo, hi = np.zeros(1, dtype=np.int64), np.full(1, n - 1, dtype=np.int64)
    for length in range(least):
        size = hi - lo + 1
        total = int(size.sum())
        owner = np.repeat(np.arange(1, len(lo) + 1), size)
        place = np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)
        to, char = last_first[place], bwt[place]
        # The targets of one interval and one character are one run of places: either mark all places, or sort the few.
        if total * 8 > n:
            mark = np.zeros(n, dtype=np.int64)
            mark[to] = owner << 8 | char
            at = np.flatnonzero(mark)
            key = mark[at]
        else:
            by = np.argsort(to)
            at, key = to[by], (owner << 8 | char)[by]
        cut = np.ones(len(at), dtype=bool)
        cut[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
        start = np.flatnonzero(cut)
        left, right = at[start], at[np.append(start[1:], len(at)) - 1]
        new = lcp[right + 1] < 0
        lo, hi = left[new], right[new]
        lcp[hi + 1] = length
        if not len(lo):
            break
    return lcp[:n]


def repeated(bodies: list[bytes], windows: np.ndarray, weight: np.ndarray, least: int) -> np.ndarray:
    """Which windows of `least` bytes occur at a weight of two or more among all bodies' windows.

    Body i counts with its first windows[i] starts, each at weight[i]; the answer lists those starts body by body.
    """
    text = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    size = np.array([len(b) for b in bodies])
    first = np.cumsum(size) - size
    begin = np.repeat(first, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    value = np.zeros(len(text))
    value[begin] = np.repeat(weight, windows)
    order = rotations(text, least)
    group = np.cumsum(short_prefixes(text, order, least) >= 0) - 1
    heavy = np.bincount(group, value[order]) >= 2
    out = np.empty(len(text), dtype=bool)
    out[order] = heavy[group]
    return out[begin]
