"""Schedules and jobs against a plain loop over their commands; alerts by hand-computed texts."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.operators import alerts, control, recrawl

LOG = "target string, job_id string, command string, cron string, n_urls long, ts long, seq long"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def by_loop(rows):
    """Schedules and jobs after the commands one by one."""
    plans, jobs = {}, {}
    for target, job, command, cron, n, _, _ in sorted(rows, key=lambda r: (r[5], r[6], r[2] or "")):
        if command == "add":
            plans[target] = [cron, True]
        elif command == "remove":
            plans.pop(target, None)
        elif command in ("pause", "resume") and target in plans:
            plans[target][1] = command == "resume"
        if command == "create":
            jobs[job] = ["pending", n or 0, False]
        elif job in jobs and command == "add":
            jobs[job][1] += n or 0
        elif job in jobs and command in control.JOB_STATES:
            jobs[job][0] = control.JOB_STATES[command]
            jobs[job][2] |= command in ("start", "resume")
    ended = ("cancelled", "completed", "failed")
    return {(t, c, e) for t, (c, e) in plans.items()}, {(j, s, n, b, s in ended) for j, (s, n, b) in jobs.items()}


def test_commands(spark):
    draw = random.Random(5)
    names = [*control.JOB_STATES, "add", "remove", "unknown", None]
    rows = [(t := f"t{draw.randrange(60)}", t, draw.choice(names), draw.choice(["0 * * * *", None]), draw.choice([None, 1, 5]), draw.randrange(40), i) for i in range(1500)]
    rows += [("never", "never", c, "x", 1, i, i) for i, c in enumerate(("pause", "start", "add", "remove"))]
    df = log(spark, rows)
    plans, jobs = by_loop(rows)
    assert len(plans) > 5 and len({j[1] for j in jobs}) > 3 and "never" not in {j[0] for j in jobs}
    assert {tuple(r) for r in control.schedules(df, ["ts", "seq"]).collect()} == plans
    assert {tuple(r) for r in control.jobs(df, ["ts", "seq"]).collect()} == jobs


def test_odd_commands(spark):
    """Ties go by name, rows without a target are left out, repeated rows change nothing but a job's addresses, clashing columns don't matter."""
    rows = [("a", "a", "pause", None, None, 1, 1), ("a", "a", "add", "c", None, 1, 1), ("b", "b", "remove", None, None, 1, 1), ("b", "b", "add", "c", None, 1, 1), (None, None, "add", "c", 1, 1, 1), (None, None, "create", "c", 1, 1, 1),
            ("d", "d", "create", None, 2, 1, 1), ("d", "d", "add", "c", 3, 2, 1), ("d", "d", "add", "c", 3, 2, 1)]
    df = log(spark, rows).withColumn("life", F.lit(1)).withColumn("at", F.lit(2)).withColumn("state", F.lit(3)).withColumn("born", F.lit(4))
    assert {tuple(r) for r in control.schedules(df, ["ts", "seq"]).collect()} == {("a", "c", False), ("d", "c", True)}
    assert [tuple(r) for r in control.jobs(df, ["ts", "seq"]).collect()] == [("d", "pending", 8, False, False)]
    assert control.schedules(df.where("false"), ["ts"]).count() == control.jobs(df.where("false"), ["ts"]).count() == 0


def test_alerts(spark):
    c = spark.createDataFrame([("h", "t", 0.6543, True), ("h", None, 0.9, False), (None, "t", None, None)], "domain string, page_type string, similarity double, breaking boolean")
    got = alerts.structure_changed(c).collect()
    assert [r["severity"] for r in got] == ["error", "warning", "warning"] and got[0]["title"] == "Structure change detected: h" and got[2]["title"].endswith("unknown")
    assert got[0]["message"] == "Page type 't' structure changed. Similarity: 65.4%. Requires re-learning extraction strategy."
    assert got[1]["message"] == "Page type 'unknown' structure changed. Similarity: 90.0%. Minor change detected." and "Similarity: unknown. Minor" in got[2]["message"]
    assert json.loads(got[0]["details"]) == {"page_type": "t", "similarity": 0.6543, "breaking": True} and tuple(got[0].asDict()) == alerts.COLUMNS
    m = spark.createDataFrame([("u", "ssn"), ("u", "email"), ("u", "email"), ("v", "ssn")], "url string, pii_type string")
    assert {(r["url"], r["message"]) for r in alerts.personal(m, "redact").collect()} == {("u", "Found PII types: email, ssn. Action taken: redact"), ("v", "Found PII types: ssn. Action taken: redact")}
    t = alerts.complete(spark.createDataFrame([(3, None, 1, 2)], "pages_crawled long, pages_failed long, pages_blocked long, domains long"))
    assert (r := t.first())["message"] == "Crawled 3 pages, 0 failed, 1 blocked." and json.loads(r["details"])["domains"] == 2
    b = alerts.blocked(spark.createDataFrame([("u", "robots", "rules")], "url string, block_type string, reason string"))
    assert b.first()["title"] == "URL blocked: robots" and b.first()["severity"] == "info"
    every = alerts.structure_changed(c).union(t).union(b)
    assert alerts.passing(every).count() == 3 and alerts.passing(every, "error").count() == 1 and alerts.passing(every, "info").count() == 5
    with pytest.raises(ValueError):
        alerts.passing(every, "loud")


def test_recrawl(spark):
    """Three rounds with a function that changes, fails or finds nothing; plans are removed, added and given another cron between them."""
    def call(target, plan):
        if target == "bad":
            raise ValueError("gone")
        assert plan["cron"]
        return target == "news"

    at = lambda h, m=0: F.lit(f"2024-03-01 {h:02}:{m:02}:00").cast("timestamp")
    plans = lambda *rows: spark.createDataFrame(rows, "target string, cron string, enabled boolean")
    hourly = "0 * * * *"
    first = plans(("news", hourly, True), ("same", hourly, True), ("bad", hourly, True), ("off", hourly, False), ("daily", "0 0 * * *", True), ("none", None, True))
    known = recrawl.merged(None, first, at(0, 30))
    known, runs = recrawl.run(known, at(3), recrawl.by_target(call), cut=lambda df: df.cache())
    got = {r["target"]: r for r in known.collect()}
    assert {(r["target"], r["success"], r["changed"], r["error"]) for r in runs.collect()} == {("news", True, True, None), ("same", True, False, None), ("bad", False, False, "ValueError: gone")}
    three, four = datetime(2024, 3, 1, 3), datetime(2024, 3, 1, 4)
    assert [(got[t]["runs"], got[t]["failures"], got[t]["last_run"], got[t]["last_change"], got[t]["next_run"]) for t in ("news", "same", "bad")] == [(1, 0, three, three, four), (1, 0, three, None, four), (1, 1, three, None, four)]
    assert got["off"]["runs"] == got["daily"]["runs"] == got["none"]["runs"] == 0 and got["off"]["next_run"] == datetime(2024, 3, 1, 1) and got["daily"]["next_run"] == datetime(2024, 3, 2) and got["none"]["next_run"] is None
    assert recrawl.run(known, at(3, 30), recrawl.by_target(call), cut=lambda df: df.cache())[1].count() == 0
    known = recrawl.merged(known, plans(("news", "30 * * * *", True), ("same", hourly, True), ("off", hourly, True), ("new", hourly, True)), at(3, 40))
    got = {r["target"]: r for r in known.collect()}
    assert {t: (r["runs"], r["next_run"].hour, r["next_run"].minute) for t, r in got.items()} == {"news": (1, 4, 30), "same": (1, 4, 0), "off": (0, 1, 0), "new": (0, 4, 0)}
    known, runs = recrawl.run(known, at(4), lambda due: due.where("target <> 'new'").selectExpr("target", "false AS changed", "CAST(NULL AS STRING) AS error"), cut=lambda df: df.cache())
    assert {(r["target"], r["error"]) for r in runs.collect()} == {("same", None), ("off", None), ("new", "no answer")}
    assert recrawl.run(known.where("false"), at(9), recrawl.by_target(call), cut=lambda df: df.cache())[1].count() == 0
