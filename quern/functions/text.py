"""Text fingerprints and similarities: native column expressions, but for the 64-bit vote, which is Arrow-batched."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def normalize(text: Column) -> Column:
    """Tags to spaces, lower case, white space collapsed, then punctuation dropped; so 'a - b' keeps two spaces."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    t = F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))
    return F.regexp_replace(t, r"(?U)[^\w\s]", "")


def words(normal: Column) -> Column:
    return F.filter(F.split(normal, r"(?U)\s+"), lambda w: w != "")


def shingles(ws: Column, width: int = 3) -> Column:
    """Runs of `width` words; the words themselves if there are fewer."""
    n = F.size(ws)
    return F.when(n < width, ws).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, width), " ")))


#: Shingles whose digests and bits are held at once.
AT_ONCE = 16384


def _vote(text: str, width: int) -> int:
    """The hash of a text; its shingles vote in pieces, so that memory doesn't grow with them."""
    ws = text.split()
    if not ws:
        return 0
    width = width if len(ws) >= width else 1
    n, votes = len(ws) - width + 1, np.zeros(64, dtype=np.int64)
    for low in range(0, n, AT_ONCE):
        digests = b"".join(hashlib.md5(" ".join(ws[i : i + width]).encode()).digest()[8:] for i in range(low, min(n, low + AT_ONCE)))
        votes += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n).view(">i8")[0])


def _votes(texts: pd.Series, width: int) -> pd.Series:
    return pd.Series([_vote(t, width) for t in texts], dtype="int64")


def simhash(normal: Column, width: int = 3) -> Column:
    """64-bit vote over the low halves of the MD5 of a normalized text's shingles; a bit is set by a positive vote, and
    no words give 0. Hashes are Arrow-batched: native arrays of 64 votes per shingle take ten times as long."""
    return F.pandas_udf(lambda texts: _votes(texts, width), "long")(normal)


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def jaccard(a: Column, b: Column, empty: float | None = 1.0) -> Column:
    """Of two arrays as sets; `empty` is the value for two empty ones."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum of least over sum of greatest counts of two maps; 1 for two empty ones."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    low = F.aggregate(both, F.lit(0).cast("long"), lambda s, e: s + F.least(e["x"], e["y"]))
    high = F.aggregate(both, F.lit(0).cast("long"), lambda s, e: s + F.greatest(e["x"], e["y"]))
    return F.when(high == 0, F.lit(1.0)).otherwise(low / high)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a norm is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))
