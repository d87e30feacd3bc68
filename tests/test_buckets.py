"""Streams keep the state of many keys together: a call takes the rows of a whole bucket."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quern.streaming import timers

START = pd.Timestamp("2024-01-01")


class Handle:
    """State and timers in memory."""

    def __init__(self):
        self.value, self.timers = None, set()
        self.deleteTimer, self.registerTimer = self.timers.discard, self.timers.add

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def getCurrentWatermarkInMs(self):
        return self.now


def run(processor, calls):
    """The rows that a processor gives for `calls`, frames of one bucket, and for the watermark (a minute) after each."""
    handle, out = Handle(), []
    processor.init(handle)
    for rows in calls:
        out += [tuple(r) for f in processor.handleInputRows((0,), iter([rows[:7], rows[7:]]), handle) for r in f.itertuples(index=False)]
        assert len(handle.timers) <= 1
        handle.now = int(rows["ts"].max().timestamp() * 1000) - 60_000
        while handle.timers and min(handle.timers) < handle.now:
            handle.timers.clear()
            out += [tuple(r) for f in processor.handleExpiredTimer((0,), handle, None) for r in f.itertuples(index=False)]
    return sorted(map(str, out)), handle


def log(seed):
    r, at, out = random.Random(seed), START, []
    for i in range(400):
        at += pd.Timedelta(seconds=r.choice([0, 1, 60, 1000, 9000]))
        out.append((f"k{r.randrange(9)}", r.choice("ab"), r.choice(["claim", "add", "fail"]), at, i))
    return pd.DataFrame(out, columns=["key", "job_id", "kind", "ts", "event_id"]).assign(url=lambda d: d["key"], worker=lambda d: d["key"])


def test_a_call_for_many_keys_is_as_one_for_each():
    """Also when rows come in other micro-batches, out of order within each."""
    for make in (lambda: timers.Claims(20_000), lambda: timers.Alerts(20_000), lambda: timers.Leases(20_000)):
        rows = log(3)
        parts = lambda d, n: [d[d["event_id"] // n == k].sample(frac=1, random_state=k) for k in range(-(-400 // n)) if (d["event_id"] // n == k).any()]
        last = rows.assign(**{k: "last" for k in ("key", "url", "worker", "job_id")}, kind="add")[-1:]  # all see the same end
        mine = lambda k: pd.concat([rows[rows["key"] == k], last])
        each = [x for k in sorted(rows["key"].unique()) for x in run(make(), parts(mine(k), 400))[0]]
        each = sorted(x for x in each if "last" not in x)
        for n in (400, 100):
            got, handle = run(make(), parts(pd.concat([rows, last]), n))
            assert [x for x in got if "last" not in x] == each and len(each) > 20
            assert handle.value is None or len({len(a) for a in handle.value}) == 1


def test_streams_group_by_bucket(spark, tmp_path):
    """Plans of the streams group by bucket, of which there are no more than BUCKETS however many keys there are."""
    from quern.streaming import stateful

    rows = spark.readStream.schema("key string, ts timestamp, event_id long, kind string").parquet(str(tmp_path))
    log_ = rows.select(F.col("key").alias("url"), F.col("key").alias("worker"), F.col("key").alias("job_id"), "ts", "event_id", "kind")
    for df in (timers.alerts(rows, 360), timers.stale_claims(log_), timers.lost_leases(log_, 60), stateful.throttle(rows, 360)):
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "pmod(xxhash64(" in plan and "[bucket#" in plan
    assert spark.range(100_000).select(timers.bucket("id")).distinct().count() == timers.BUCKETS
