"""What a user may supply: functions on batches, generators of descriptions, readers of dates, embeddings, alert channels and
stores, each with a default that needs no service. A name chooses one; a function given in its place is used as it is.
"""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.operators import learn, store, structure

log = logging.getLogger("quern")


class Descriptions(ABC):
    """Texts on structures, as columns over the rows of `structure.structures` with a site and a page type."""

    @abstractmethod
    def page(self, domain: Column, page_type: Column) -> Column: ...

    def change(self, old: Column, new: Column) -> Column:
        return structure.describe_change(old, new)


class ByRules(Descriptions):
    def page(self, domain: Column, page_type: Column) -> Column:
        return structure.describe()


class Briefly(Descriptions):
    def page(self, domain: Column, page_type: Column) -> Column:
        return structure.describe_briefly(page_type)


class Summaries(Descriptions):
    """What a language model would be given; where none is at hand the summary itself is the description."""

    def page(self, domain: Column, page_type: Column) -> Column:
        return structure.summary(domain, page_type)


class Channel(ABC):
    """Where alerts (alert_type, severity, title, message, domain, url, created_at) go; `send` gets a DataFrame of them."""

    @abstractmethod
    def send(self, alerts: DataFrame) -> None: ...


class TableChannel(Channel):
    """The default: an append-only Parquet table."""

    def __init__(self, path: str):
        self.path = path

    def send(self, alerts: DataFrame) -> None:
        alerts.write.mode("append").parquet(self.path)


class LogChannel(Channel):
    """A line in the driver's log for each kind and severity, not for each alert."""

    def send(self, alerts: DataFrame) -> None:
        for r in alerts.groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("n")).collect():
            log.warning("%s %s: %d", r["severity"], r["alert_type"], r["n"])


class CallChannel(Channel):
    """A function of the user's own that gets one alert as a dict, called where the rows are; a webhook is such a function. Its
    exceptions are counted, not raised."""

    def __init__(self, call: Callable[[dict], None]):
        self.call = call

    def send(self, alerts: DataFrame) -> None:
        call = self.call

        def each(rows: Iterable) -> None:
            for r in rows:
                try:
                    call(r.asDict(recursive=True))
                except Exception:  # noqa: BLE001 - one alert that can't be sent must not stop the others
                    log.exception("an alert was not sent")

        alerts.foreachPartition(each)


def deliver(alerts: DataFrame, channels: list[Channel]) -> Callable | None:
    """Alerts to all channels. Of a stream, what each micro-batch holds; the function for `foreachBatch` is returned."""
    if alerts.isStreaming:
        return lambda batch, _: [c.send(batch) for c in channels] and None
    for c in channels:
        c.send(alerts)
    return None


DESCRIPTIONS: dict[str, type[Descriptions]] = {"rules": ByRules, "brief": Briefly, "summary": Summaries}
EMBEDDINGS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"hashed": learn.embed}
CHANNELS: dict[str, Callable[..., Channel]] = {"table": TableChannel, "log": LogChannel, "call": CallChannel}


def descriptions(kind: str | Descriptions = "rules") -> Descriptions:
    return DESCRIPTIONS[kind]() if isinstance(kind, str) else kind


def embedding(kind: str | Callable[[DataFrame, str], DataFrame] = "hashed") -> Callable[[DataFrame, str], DataFrame]:
    return EMBEDDINGS[kind] if isinstance(kind, str) else kind


class Store:
    """Structures as a versioned table under a path; `kind` says whether rows also get a description and an embedding."""

    KEY = ("domain", "page_type")

    def __init__(self, spark: SparkSession, path: str, kind: str = "basic", keep: int = 10, describe: str | Descriptions = "rules", embed: str | Callable = "hashed"):
        if kind not in ("basic", "described"):
            raise ValueError(f"unknown kind of store: {kind}")
        self.spark, self.path, self.kind, self.keep, self.describe, self.embed = spark, path, kind, keep, descriptions(describe), embedding(embed)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def save(self, structures: DataFrame) -> DataFrame:
        """`structures` (domain, page_type, captured_at, ...) as next versions, written beside the table of before and put in its place by
        the caller's catalog; returns what is to be the table."""
        new = structures
        if self.kind == "described":
            new = self.embed(new.withColumn("description", self.describe.page(F.col("domain"), F.col("page_type"))), "description")
        try:
            old = self.rows()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = new.where("false").withColumn("version", F.lit(0))
        return store.save(old, new, list(self.KEY), self.keep)

    def latest(self) -> DataFrame:
        return store.latest(self.rows(), list(self.KEY))


def guarded(call: Callable | None, *args) -> bool:
    """A user's function, its exceptions logged and swallowed; whether it returned something true."""
    if call is None:
        return False
    try:
        return bool(call(*args))
    except Exception:  # noqa: BLE001 - a hook must not stop the job
        log.exception("a hook failed")
        return False
