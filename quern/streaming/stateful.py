"""Streaming twins of the ordered operators: alert throttling, domain health and leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.streaming import timers


def throttle(alerts: DataFrame, minutes: int) -> DataFrame:
    """A stream of (event_id, key, ts) with `sent`. State is the times of the last alerts of a bucket of keys; each leaves with
    event time."""
    width = minutes * 60_000_000

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get)) if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["key", "ts", "event_id"])
            keys, sent = rows["key"].tolist(), []
            for key, at in zip(keys, rows["ts"].astype("datetime64[us]").astype("int64").tolist()):
                go = key not in last or at - last[key] >= width
                if go:
                    last[key] = at
                sent.append(go)
            yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "key": keys, "sent": sent})
        now = state.getCurrentWatermarkMs()
        last = {k: at for k, at in last.items() if (at + width) // 1000 >= now}
        if last:
            state.update((list(last), list(last.values())))
            state.setTimeoutTimestamp(max((min(last.values()) + width) // 1000, now + 1))
        elif state.exists:
            state.remove()

    return alerts.withColumn("bucket", timers.bucket("key")).withWatermark("ts", f"{minutes} minutes").groupBy("bucket").applyInPandasWithState(
        step, "event_id long, key string, sent boolean", "keys array<string>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def health(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests, errors and mean time of each domain and window, final once the watermark has passed."""
    w = F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(w, "domain").agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors"), F.avg("ms").alias("mean_ms"))
    return out.select("domain", F.col("window.start").alias("start"), "requests", "errors", "mean_ms")


def streaks(events: DataFrame) -> DataFrame:
    """A stream of (domain, ts, failed) with each domain's consecutive errors so far, as updates."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for failed in pd.concat(list(batches)).sort_values("ts")["failed"]:
            n = n + 1 if failed else 0
        state.update((n,))
        yield pd.DataFrame({"domain": [key[0]], "streak": [n]})

    return events.groupBy("domain").applyInPandasWithState(step, "domain string, streak long", "n long", "update", GroupStateTimeout.NoTimeout)


def leases(beats: DataFrame, seconds: int) -> DataFrame:
    """A stream of (worker, ts): a row for each worker that fell silent for `seconds` of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"worker": [key[0]], "last_beat": [last]})
            return
        last = max([state.get[0] if state.exists else 0, *(int(t.timestamp() * 1000) for b in batches for t in b["ts"])])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return beats.withWatermark("ts", "1 minute").groupBy("worker").applyInPandasWithState(step, "worker string, last_beat long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
