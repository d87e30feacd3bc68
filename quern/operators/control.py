"""Schedules and jobs as what a log of commands leaves of them.

A log is an append-only table, so that adding, pausing or removing is a row written, and the state is one aggregation with
partial maxima, whatever a target's number of commands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What sets a job's state, and the state; `add` brings addresses and leaves the state.
JOB_STATES = {"create": "pending", "start": "running", "pause": "paused", "resume": "running", "cancel": "cancelled", "finish": "completed", "fail": "failed"}
ENDED = ("cancelled", "completed", "failed")


def _last(order: list[str], what: list[Column], when: Column) -> Column:
    """The last row's `what` with its place in the order, of the rows for which `when` holds."""
    return F.max(F.when(when, F.struct(F.struct(*order).alias("at"), *what)))


def _kept(commands: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The commands that have a key, with the columns that count; `_rank` settles ties in the order."""
    return commands.where(F.col(key).isNotNull()).select(key, "command", value, *order, F.col("command").alias("_rank"))


def schedules(commands: DataFrame, order: list[str]) -> DataFrame:
    """(target, cron, enabled) of the schedules that `commands` (target, command, cron and the columns of `order`) leave.

    `add` puts an enabled schedule in the place of any before it, `remove` deletes it, `pause` and `resume` act on the schedule that is
    there. Pausing, resuming or removing what isn't there does nothing, nor do unknown and null commands; rows without a target are left out.
    Rows that `order` doesn't tell apart count in the order add, pause, remove, resume.
    """
    c = _kept(commands, "target", "cron", order)
    by = [*order, "_rank"]
    life = _last(by, [F.col("command"), F.col("cron")], F.col("command").isin("add", "remove"))
    switch = _last(by, [F.col("command")], F.col("command").isin("pause", "resume"))
    state = c.groupBy("target").agg(life.alias("life"), switch.alias("switch")).where("life.command = 'add'")
    paused = F.coalesce((F.col("switch.at") > F.col("life.at")) & (F.col("switch.command") == "pause"), F.lit(False))
    return state.select("target", "life.cron", (~paused).alias("enabled"))


def jobs(commands: DataFrame, order: list[str]) -> DataFrame:
    """(job_id, state, n_urls, started, ended) of the jobs that `commands` (job_id, command, n_urls and the columns of `order`) leave.

    The last command that sets a state counts; a job is what its last `create` began: earlier commands count no more, and a job never
    created isn't there. `n_urls` are the addresses that came with its creation and with each `add` since; `started` says whether it
    ever ran, `ended` whether its state is a final one. Ties in `order` go by the command's name.
    """
    c = _kept(commands, "job_id", "n_urls", order)
    by = [*order, "_rank"]
    born = c.groupBy("job_id").agg(F.max(F.when(F.col("command") == "create", F.struct(*by))).alias("born")).where("born is not null")
    since = c.join(born, "job_id").where(F.struct(*by) >= F.col("born"))
    moves = F.create_map(*[F.lit(x) for pair in JOB_STATES.items() for x in pair])
    got = since.groupBy("job_id").agg(
        _last(by, [F.col("command")], F.col("command").isin(*JOB_STATES)).alias("last"), F.sum(F.when(F.col("command").isin("create", "add"), F.coalesce("n_urls", F.lit(0))).otherwise(0)).alias("n_urls"),
        F.max(F.col("command").isin("start", "resume")).alias("started"))
    state = moves[F.col("last.command")]
    return got.select("job_id", state.alias("state"), "n_urls", "started", state.isin(*ENDED).alias("ended"))
