"""Claims, alerts and leases as state with timers.

Each is a processor over the rows of a bucket of keys (`BUCKETS` of them, by hash), with a state variable that outlives
micro-batches and holds all keys of the bucket, and one event-time timer for the earliest that falls due: calls and
timers are as many as buckets, not as keys. What time alone decides is decided alike by a timer and by the key's next row,
so that results don't depend on where micro-batches end. A silent key leaves the state when it falls due. Rows of a
key that arrive together are taken in order of (ts, event_id); times are microseconds, timers milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Buckets that keys are dealt to. A stream keeps its number: another one finds none of the state.
BUCKETS = 4096


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def _ordered(batches: Iterator[pd.DataFrame], keys: list[str], rest: list[str]) -> Iterator[tuple]:
    """Rows (keys..., us, rest...) of all keys, in order within each."""
    rows = pd.concat(list(batches)).sort_values([*keys, "ts", "event_id"])
    us = rows["ts"].astype("datetime64[us]").astype("int64")
    yield from zip(*[rows[k].tolist() for k in keys], us.tolist(), *[rows[c].tolist() for c in rest])


class _Timed(StatefulProcessor):
    """What the processors share: the state of a bucket's keys as parallel arrays, and one timer, set to the earliest time
    at which one of them falls due. `held` maps a key (a tuple) to its values, the first of them when it began."""

    seconds: int
    columns: list[str]
    keys: list[str]
    values: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", ", ".join([*(f"{k} array<string>" for k in self.keys), *(f"{v.replace(' ', ' array<')}>" for v in self.values)]))

    def held(self) -> dict[tuple, tuple]:
        got = self.state.get()
        n = len(self.keys)
        return {r[:n]: r[n:] for r in zip(*got)} if got else {}

    def hold(self, held: dict[tuple, tuple]) -> None:
        if held:
            self.state.update(tuple(map(list, zip(*(k + v for k, v in held.items())))))
        else:
            self.state.clear()
        first = min((v[0] for v in held.values()), default=None)
        for old in list(self.handle.listTimers()):
            if first is None or old != self.due(first):
                self.handle.deleteTimer(old)
        if first is not None:
            self.handle.registerTimer(self.due(first))

    def due(self, us: int) -> int:
        """Milliseconds of the timer for what began at `us`: it fires once the watermark is past."""
        return us // 1000 + self.seconds * 1000

    def past(self, since: int, us: int) -> bool:
        return us - since > self.seconds * 1_000_000

    def step(self, held: dict[tuple, tuple], rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Takes the rows into `held`; yields what they decide."""
        raise NotImplementedError

    def ended(self, key: tuple, value: tuple) -> list[tuple]:
        """What time decides of a key that has fallen due."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        out = list(self.step(held, rows))
        self.hold(held)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held, out = timerValues.getCurrentWatermarkInMs(), self.held(), []
        for k in [k for k, v in held.items() if self.due(v[0]) < now]:
            out += self.ended(k, held.pop(k))
        self.hold(held)
        yield self.frame(out)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def close(self) -> None:
        pass


def _time(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class Claims(_Timed):
    """Open claims of addresses. A claim without an answer for `seconds` is given back, once."""

    columns = ["url", "worker", "claimed_at"]
    keys, values = ["url"], ["us long", "worker string"]

    def __init__(self, seconds: int):
        self.seconds = seconds

    def step(self, held, rows) -> Iterator[tuple]:
        for url, us, kind, worker in _ordered(rows, self.keys, ["kind", "worker"]):
            if kind == "add":
                continue
            was = held.pop((url,), None)
            if was is not None and self.past(was[0], us):
                yield url, was[1], _time(was[0])
            if kind == "claim":
                held[url,] = us, worker

    def ended(self, key, value) -> list[tuple]:
        return [(key[0], value[1], _time(value[0]))]


class Alerts(_Timed):
    """Alerts of a key, sent at most once in `seconds`; those suppressed are counted until that time is over, and then one
    summary stands for them, if they are several."""

    columns = ["key", "kind", "event_id", "n"]
    keys, values = ["key"], ["us long", "n long", "event_id long"]

    def __init__(self, seconds: int):
        self.seconds = seconds

    def step(self, held, rows) -> Iterator[tuple]:
        for key, us, event_id in _ordered(rows, self.keys, ["event_id"]):
            was = held.get((key,))
            if was is not None and us - was[0] < self.seconds * 1_000_000:
                held[key,] = was[0], was[1] + 1, event_id
                continue
            if was is not None:
                yield from self.ended((key,), was)
            held[key,] = us, 0, event_id
            yield key, "sent", event_id, 1

    def ended(self, key, value) -> list[tuple]:
        return [(key[0], "summary", value[2], value[1])] if value[1] > 1 else []


class Leases(_Timed):
    """The leases that workers hold, by job; each is renewed by a beat and lost after `seconds` without one."""

    columns = ["worker", "job_id", "last_beat"]
    keys, values = ["worker", "job_id"], ["us long"]

    def __init__(self, seconds: int):
        self.seconds = seconds

    def step(self, held, rows) -> Iterator[tuple]:
        for worker, job, us in _ordered(rows, self.keys, []):
            was = held.get((worker, job))
            if was is not None and self.past(was[0], us):
                yield worker, job, _time(was[0])
            held[worker, job] = (us if was is None else max(was[0], us),)

    def ended(self, key, value) -> list[tuple]:
        return [(*key, _time(value[0]))]


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    """A stream's rows by bucket of `key` through a processor."""
    return rows.withColumn("bucket", bucket(key)).withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "EventTime")


def stale_claims(log: DataFrame, seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """A stream of (url, kind, worker, ts, event_id), kind 'add', 'claim', 'complete' or 'fail': (url, worker, claimed_at) of each
    claim that had no answer for `seconds`. A later claim of the same address takes the place of an open one."""
    return _run(log, "url", Claims(seconds), "url string, worker string, claimed_at timestamp", late)


def alerts(stream: DataFrame, minutes: int, late: str = "1 minute") -> DataFrame:
    """A stream of (key, ts, event_id): (key, kind, event_id, n). kind 'sent' is an alert that goes out; 'summary' stands for the n
    alerts (two at least) that were suppressed since, the last of them being event_id, as soon as the time is over."""
    return _run(stream, "key", Alerts(minutes * 60), "key string, kind string, event_id long, n long", late)


def lost_leases(beats: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """A stream of (worker, job_id, ts, event_id): (worker, job_id, last_beat) of each lease that had no beat for `seconds`; a
    later beat takes it again."""
    return _run(beats, "worker", Leases(seconds), "worker string, job_id string, last_beat timestamp", late)
