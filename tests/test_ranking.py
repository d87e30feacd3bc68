"""Ranks, running sums and first rows against sorted lists, and the plan of a large claim."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import claims, ranking


def table(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(f"u{i}", r.choice([None, 0.0, 1.0, r.random(), r.random() * 1e6])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "url string, score double").repartition(5)


def key(row):
    return row[1] is not None, row[1] or 0.0, row[0]


@pytest.mark.parametrize("n", [0, 1, 7, 150, 399, 400, 5000])
def test_leading(spark, n):
    rows, df = table(spark, 400)
    got = sorted(((x["rank"], x["url"]) for x in ranking.leading(df, n, ["score", "url"]).collect()))
    assert got == [(k, r[0]) for k, r in enumerate(sorted(rows, key=key)[:n], 1)]


def test_running_sums(spark):
    rows, df = table(spark, 300, 2)
    got = {x["url"]: x["sum"] for x in ranking.numbered(df, ["score", "url"], "sum", F.length("url")).collect()}
    total = 0
    for u, _ in sorted(rows, key=key):
        total += len(u)
        assert got[u] == total
    assert ranking.numbered(df.where("false"), ["score"]).count() == 0


def test_large_claims(spark):
    """Twenty thousand slots: no sort of all tasks in one partition, no broadcast of claims; rows as a plain loop gives them."""
    r = random.Random(3)
    rows = [(f"u{i}", r.choice(["queued", "queued", "completed"]), i % 3, r.random()) for i in range(60_000)]
    tasks = spark.createDataFrame(rows, "url string, state string, attempts int, score double").repartition(8)
    given = [("b", 8000), ("a", 4000), ("c", 8000), ("idle", 0)]
    done = claims.claim(tasks, spark.createDataFrame(given, "worker string, slots int"), F.current_timestamp())
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan and "NestedLoop" not in plan
    got = {x["url"]: (x["state"], x["attempts"], x["worker"]) for x in done.collect()}
    slots = [w for w, n in sorted(given) for _ in range(n)]
    queue = sorted((s, u) for u, state, _, s in rows if state == "queued")
    mine = {u: w for (_, u), w in zip(queue, slots)}
    assert got == {u: ("processing", a + 1, mine[u]) if u in mine else (state, a, None) for u, state, a, _ in rows}
