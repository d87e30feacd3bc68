"""Alerts on what a crawl finds, as rows (alert_type, severity, title, message, domain, url, details), details a JSON object.

Each function is a projection of the operator's rows that it names; `plugins.deliver` sends the rows, `passing` is the gate
before it. Compliance and completion are information, which the default gate holds back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COLUMNS = ("alert_type", "severity", "title", "message", "domain", "url", "details")
#: Severities in rising order.
LEVELS = ("info", "warning", "error", "critical")


def _text(*parts: Column | str) -> Column:
    """The parts one after the other; a null one as 'unknown'."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts])


def _rows(df: DataFrame, kind: str, severity: Column, title: Column, message: Column, details: Column, domain: Column | None = None, url: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    given = (F.lit(kind), severity, title, message, none if domain is None else domain, none if url is None else url, F.to_json(details))
    return df.select(*[c.alias(n) for n, c in zip(COLUMNS, given, strict=True)])


def structure_changed(changes: DataFrame) -> DataFrame:
    """Of `changes` (domain, page_type, similarity, breaking): an error where the change is breaking, else a warning."""
    broken = F.coalesce("breaking", F.lit(False))
    share = F.format_string("%.1f%%", F.round(F.col("similarity").cast("double") * 100, 1))
    then = F.when(broken, "Requires re-learning extraction strategy.").otherwise("Minor change detected.")
    return _rows(
        changes, "structure_change", F.when(broken, "error").otherwise("warning"), _text("Structure change detected: ", F.col("domain")),
        _text("Page type '", F.col("page_type"), "' structure changed. Similarity: ", F.when(F.col("similarity").isNotNull(), share), ". ", then),
        F.struct("page_type", "similarity", broken.alias("breaking")), domain=F.col("domain"))


def blocked(rows: DataFrame) -> DataFrame:
    """Of addresses that weren't fetched (url, reason, block_type)."""
    return _rows(
        rows, "compliance_block", F.lit("info"), _text("URL blocked: ", F.col("block_type")), _text("URL was blocked due to compliance check: ", F.col("reason")),
        F.struct("block_type", "reason"), url=F.col("url"))


def personal(matches: DataFrame, action: str) -> DataFrame:
    """One for each address of `matches` (url, pii_type) of personal data, with the kinds found, each once and in order, and what is
    done about them. Kinds are a fixed few, so an address's set is small however many matches it has."""
    kinds = matches.groupBy("url").agg(F.array_sort(F.collect_set("pii_type")).alias("pii_types"))
    return _rows(
        kinds, "pii_detected", F.lit("warning"), F.lit("PII detected in crawled content"), _text("Found PII types: ", F.array_join("pii_types", ", "), ". Action taken: ", action),
        F.struct("pii_types", F.lit(action).alias("action")), url=F.col("url"))


def complete(totals: DataFrame) -> DataFrame:
    """Of the totals of crawls (pages_crawled, pages_failed, pages_blocked; other columns become details, too); a null counts as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return _rows(
        totals, "crawl_complete", F.lit("info"), F.lit("Crawl completed"),
        _text("Crawled ", n("pages_crawled"), " pages, ", n("pages_failed"), " failed, ", n("pages_blocked"), " blocked."), F.struct(*totals.columns))


def passing(alerts: DataFrame, least: str = "warning") -> DataFrame:
    """Alerts of the severity `least` or a higher one."""
    return alerts.where(F.col("severity").isin(*LEVELS[LEVELS.index(least):]))
