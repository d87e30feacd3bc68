"""Ordered per-key logic: alert throttling, adaptive rate limits and token buckets, as folds over each key's rows in time.

Each is sequential by definition: a key's rows are one group. Groups arrive as Arrow batches sorted by time, so a key
of any length is folded in constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """`step(state, row) -> (state, result)` over each key's rows in order. Rows of a key are adjacent after the sort; only
    the state of the key at hand is held."""
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                r = dict(zip(columns, row, strict=True))
                if state is None or r[key] != at:
                    at, state = r[key], start()
                state, result = step(state, r)
                out.append(result)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def throttle(alerts: DataFrame, minutes: int) -> DataFrame:
    """(event_id, key, ts) with `sent`: an alert goes out unless one of its key went out less than `minutes` before."""

    def step(last, r):
        send = last[0] is None or (r["ts"] - last[0]).total_seconds() >= minutes * 60
        return ([r["ts"]] if send else last), (r["event_id"], r["key"], send)

    return fold(alerts, "key", ["ts", "event_id"], lambda: [None], step, "event_id long, key string, sent boolean")


def replay(requests: DataFrame, default: float = 1.0, least: float = 0.5, most: float = 60.0, factor: float = 2.0) -> DataFrame:
    """(event_id, domain, ts, failed, limited, ms) with the seconds waited and the delay in force after each request. A column
    crawl_delay, if there is one, overrides the delay where it isn't null, down to `least`; backoff applies on top.

    A request waits until the delay since the last one has passed; the delay doubles per consecutive error (at most five
    times) and for good when limited; at most once a minute it shrinks by a tenth under fast answers (mean of the last
    twenty under 100 ms, no errors) and grows by a fifth under slow ones (over 2000 ms).
    """

    def step(s, r):
        now, own = max(r["ts"].timestamp(), s["last"] or 0), r.get("crawl_delay")
        base = s["delay"] if own is None or own != own else max(own, least)
        delay = min(base * factor ** min(s["errors"], 5), most) if s["errors"] else base
        wait = max(0.0, delay - (now - s["last"])) if s["last"] is not None else 0.0
        s["last"] = now + wait
        if r["failed"] or r["limited"]:
            s["errors"] += 1
            if r["limited"]:
                s["delay"] = min(s["delay"] * 2, most)
        else:
            s["errors"] = 0
            s["times"] = (s["times"] + [r["ms"]])[-20:]
            if s["adjusted"] is None or s["last"] - s["adjusted"] >= 60:
                s["adjusted"] = s["last"]
                mean = sum(s["times"]) / len(s["times"])
                if mean < 100:
                    s["delay"] = max(s["delay"] * 0.9, least)
                elif mean > 2000:
                    s["delay"] = min(s["delay"] * 1.2, most)
        return s, (r["event_id"], round(wait, 6), round(s["delay"], 6))

    start = lambda: {"last": None, "delay": default, "errors": 0, "times": [], "adjusted": None}
    return fold(requests, "domain", ["ts", "event_id"], start, step, "event_id long, wait double, delay double")


def bucket(requests: DataFrame, rate: float, capacity: int) -> DataFrame:
    """(event_id, domain, ts) with the seconds waited for a token: `rate` tokens a second, at most `capacity`."""

    def step(s, r):
        now = max(r["ts"].timestamp(), s[1] if s[1] is not None else 0)
        tokens = capacity if s[1] is None else min(capacity, s[0] + (now - s[1]) * rate)
        if tokens < 1:
            wait = (1 - tokens) / rate
            return (0.0, now + wait), (r["event_id"], round(wait, 6))
        return (tokens - 1, now), (r["event_id"], 0.0)

    return fold(requests, "domain", ["ts", "event_id"], lambda: (float(capacity), None), step, "event_id long, wait double")


def interval(runs: DataFrame, start: float = 1440.0, least: float = 5.0, most: float = 10080.0) -> DataFrame:
    """(user_id, minutes): how long to wait after the whole history (user_id, seq, changed) of each key. A change halves the
    interval, three visits without one lengthen it by half, within `least` and `most`. One state per key, whatever its history."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, minutes, quiet, out = None, start, 0, []
        for b in batches:
            for key, changed in zip(b["user_id"], b["changed"], strict=True):
                if key != at:
                    if at is not None:
                        out.append((at, minutes))
                    at, minutes, quiet = key, start, 0
                if changed:
                    minutes, quiet = max(minutes * 0.5, least), 0
                elif quiet >= 2:
                    minutes, quiet = min(minutes * 1.5, most), 0
                else:
                    quiet += 1
            yield pd.DataFrame(out, columns=["user_id", "minutes"])
            out = []
        if at is not None:
            yield pd.DataFrame([(at, minutes)], columns=["user_id", "minutes"])

    rows = runs.repartition("user_id").sortWithinPartitions("user_id", "seq").select("user_id", "changed")
    return rows.mapInPandas(run, "user_id long, minutes double")
