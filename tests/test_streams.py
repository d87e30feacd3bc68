"""Streams whose state has timers, and the monitor: restarts, kills, and plain loops over the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.functions import url as U
from quern.operators import lifecycle, structure
from quern.plans import lifecycle as L, streams
from quern.sources import shared
from quern.streaming import monitor, timers

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = datetime(2024, 1, 1)


def events(n=600, seed=1):
    """Rows in order of time, with silences and repeated times."""
    r, at, out = random.Random(seed), START, []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 1, 60, 1000, 20_000]))
        out.append((i, at, r.randrange(12), r.choice(["view", "click", "signup", "purchase", "error"]), 1.0, None))
    return out


def seconds(a, b):
    return (b - a).total_seconds()


def stale_by_hand(rows, limit=21_600):
    mark, open_, out = rows[-1][1] - timedelta(minutes=1), {}, []
    for i, ts, user, kind, *_ in rows:
        kind = streams.KINDS[kind]
        if kind == "add":
            continue
        if user in open_ and seconds(open_[user][1], ts) > limit:
            out.append((str(user), *open_[user]))
        open_.pop(user, None)
        if kind == "claim":
            open_[user] = (f"w{i % 4}", ts)
    return sorted(out + [(str(u), *x) for u, x in open_.items() if seconds(x[1], mark) > limit])


def alerts_by_hand(rows, limit=21_600):
    mark, last, held, out = rows[-1][1] - timedelta(minutes=1), {}, {}, []
    for i, ts, user, kind, *_ in rows:
        key = f"{kind}:{user}"
        if key not in last or seconds(last[key], ts) >= limit:
            if len(held.get(key, [])) > 1:
                out.append((key, "summary", held[key][-1], len(held[key])))
            last[key], held[key] = ts, []
            out.append((key, "sent", i, 1))
        else:
            held[key].append(i)
    return sorted(out + [(k, "summary", h[-1], len(h)) for k, h in held.items() if len(h) > 1 and seconds(last[k], mark) > limit])


def leases_by_hand(rows, limit=172_800):
    mark, last, out = rows[-1][1] - timedelta(minutes=1), {}, []
    for _, ts, user, kind, *_ in rows:
        key = (str(user), kind)
        if key in last and seconds(last[key], ts) > limit:
            out.append((*key, last[key]))
        last[key] = ts
    return sorted(out + [(*k, t) for k, t in last.items() if seconds(t, mark) > limit])


CASES = {
    "claims": (lambda s: timers.stale_claims(streams.claim_log(s), 21_600), stale_by_hand),
    "alerts": (lambda s: timers.alerts(s.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), "ts", "event_id"), 360), alerts_by_hand),
    "leases": (lambda s: timers.lost_leases(s.select(F.col("user_id").cast("string").alias("worker"), F.col("event_type").alias("job_id"), "ts", "event_id"), 172_800), leases_by_hand),
}


@pytest.mark.parametrize("case", CASES)
def test_restarts_change_nothing(spark, tmp_path, case):
    """Events arrive in four parts, and the stream starts anew from its checkpoint for each."""
    make, by_hand = CASES[case]
    rows = events()
    for k in range(0, 600, 150):
        spark.createDataFrame(rows[k : k + 150], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = shared.drained(make(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), f"{tmp_path}/at")
    got = sorted(map(tuple, out.collect()))
    assert got == by_hand(rows) and len(got) > 20


def test_a_kill_loses_no_claim(spark, tmp_path):
    """A run that dies in its second micro-batch leaves nothing of it; the next run from the same checkpoint does it again."""
    flag, rows = tmp_path / "poison", events(300, 4)

    class Dying(timers.Claims):
        def handleInputRows(self, key, batches, timerValues):
            import os

            if os.path.exists(flag) and timerValues.getCurrentWatermarkInMs() > 0:
                raise RuntimeError("killed")
            yield from super().handleInputRows(key, batches, timerValues)

    for k in range(0, 300, 100):
        spark.createDataFrame(rows[k : k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = streams.claim_log(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    run = lambda: shared.drained(timers._run(log, "url", Dying(21_600), "url string, worker string, claimed_at timestamp", "1 minute"), f"{tmp_path}/at")
    flag.write_text("")
    with pytest.raises(Exception, match="killed"):
        run()
    flag.unlink()
    assert sorted(map(tuple, run().collect())) == stale_by_hand(rows)


def test_the_provider_is_put_back(spark):
    was = spark.conf.get(shared.PROVIDER)
    with pytest.raises(ZeroDivisionError), shared.rocksdb(spark):
        assert spark.conf.get(shared.PROVIDER) == shared.ROCKSDB
        raise ZeroDivisionError
    assert spark.conf.get(shared.PROVIDER) == was


# --- the monitor


def site(n, seed):
    """Pages of three sites whose structure changes now and then."""
    r, out = random.Random(seed), []
    for i in range(n):
        body = r.choice(["<main><p>a</main>", "<main><p>a<p>b</main>", "<table><tr><td>1</table><form></form>", "<article class='x'><h1>t</h1></article>", "<main><p>a</main><footer>f</footer>"])
        out.append((i, f"http://s{r.randrange(3)}.org/p{i}", f"<html><body>{body}</body></html>"))
    return out


def whole(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    shapes = structure.structures(pages).withColumn("hash", structure.monitor_fingerprint()).withColumn("seq", F.col("page_id"))
    done = lifecycle.monitor(shapes.join(pages.select("page_id", U.domain("url").alias("key")), "page_id"))
    return sorted(map(str, map(tuple, done.select(*lifecycle.RECORD).collect())))


def found(spark, path):
    return sorted(map(str, map(tuple, monitor.records(spark, path).collect())))


def test_monitor_in_batches(spark, tmp_path, monkeypatch):
    """Six batches, with full copies of what is known in between, give the records of one pass; ids may come again."""
    monkeypatch.setattr(monitor, "COPY", 2)
    rows = site(60, 2)
    for k in range(0, 60, 10):
        monitor.step(spark.createDataFrame(rows[k : k + 10], "page_id long, url string, html string"), k // 10, str(tmp_path), U.domain)
    assert found(spark, tmp_path) == whole(spark, rows) and len(whole(spark, rows)) > 20
    assert monitor.known(spark, str(tmp_path), 6).count() == 3
    again = [(i, u, h.replace("<p>a", "<p>a<p>z")) for i, u, h in rows[:10]]  # the same ids, later
    monitor.step(spark.createDataFrame(again, "page_id long, url string, html string"), 6, str(tmp_path), U.domain)
    assert monitor.known(spark, str(tmp_path), 7).groupBy("key").count().where("count > 1").isEmpty()


def test_monitor_after_a_kill(spark, tmp_path, monkeypatch):
    """A batch that dies after writing its records is run again by the next start, and its records stand once."""
    rows = site(40, 3)
    for k in range(0, 40, 10):
        spark.createDataFrame(rows[k : k + 10], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
    source = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/pages")
    real, died = lifecycle.visits, []

    def dying(*args, **more):
        done = real(*args, **more)
        if len(died) < 1 and (tmp_path / "known" / "0").exists():
            died.append(1)
            done.where("n > 0").write.mode("overwrite").parquet(f"{tmp_path}/visits/1")  # written, and then
            raise RuntimeError("killed")
        return done

    monkeypatch.setattr(lifecycle, "visits", dying)
    with pytest.raises(Exception, match="killed"):
        monitor.watch(source, str(tmp_path), U.domain, every=None).awaitTermination()
    monitor.watch(source, str(tmp_path), U.domain, every=None).awaitTermination()
    assert died and found(spark, tmp_path) == whole(spark, rows)


def test_monitor_by_time(spark, tmp_path):
    """With a processing-time trigger the stream goes on until it is stopped, and takes pages that come meanwhile."""
    rows = site(20, 5)
    part = lambda k: spark.createDataFrame(rows[k : k + 10], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
    part(0)
    query = monitor.watch(spark.readStream.schema("page_id long, url string, html string").parquet(f"{tmp_path}/pages"), str(tmp_path), U.domain, every="1 second")
    try:
        query.processAllAvailable()
        part(10)
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert found(spark, tmp_path) == whole(spark, rows)


def test_monitor_query_is_the_batch_query(spark):
    sf = "/root/testdata/sf0.001"
    batch = L.monitor_changes(spark, sf).select(*lifecycle.RECORD)
    assert sorted(map(str, map(tuple, streams.stream_monitor(spark, sf).collect()))) == sorted(map(str, map(tuple, batch.collect())))
