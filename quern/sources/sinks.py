"""Sinks: pages as files per domain, JSON lines, state tables; and an options object with YAML load and save."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

import yaml
from pyspark.sql import DataFrame, functions as F

from quern.functions import url as U


def write_pages(extractions: DataFrame, path: str) -> None:
    """Extractions (url, ...) as JSON, a folder per domain, with the file name each page would have."""
    _by_domain(extractions).write.mode("overwrite").partitionBy("domain").json(path)


def write_html(pages: DataFrame, path: str) -> None:
    """Pages (page_id, url, html) as Parquet, a folder per domain, with the same file names; a file for each page would be too many."""
    _by_domain(pages.select("page_id", "url", "html")).write.mode("overwrite").partitionBy("domain").parquet(path)


def _by_domain(rows: DataFrame) -> DataFrame:
    """`rows` with domain and file_name, domains together; adaptive execution splits a large one and merges small ones by size."""
    return rows.withColumn("domain", U.domain("url")).withColumn("file_name", U.file_name(F.col("url"))).hint("rebalance", "domain")


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_state(tables: dict[str, DataFrame], path: str) -> None:
    """Named tables (frontier, seen, robots, structures, strategies) under one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def shape(rows: DataFrame, column: str) -> str:
    """The schema that holds all JSON texts of a column, as the JVM merges it; texts that aren't JSON don't count."""
    return rows.select(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("s")).first()["s"]


#: Parts of the YAML form whose entries are options.
SECTIONS = ("crawl", "rate_limit", "pii", "structure", "robots", "fetch", "render", "alerts")


@dataclass(frozen=True)
class Options:
    """Crawl options; seed_urls and output_dir are required."""

    seed_urls: tuple[str, ...]
    output_dir: str
    max_depth: int = 10
    max_pages: int | None = None
    max_pages_per_domain: int | None = None
    allowed_domains: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    priority_boost_patterns: tuple[str, ...] = ()
    extract_resources: bool = False
    follow_external: bool = False
    follow_nofollow: bool = False
    respect_robots: bool = True
    respect_crawl_delay: bool = True
    adaptive: bool = True
    default_delay: float = 1.0
    min_delay: float = 0.5
    max_delay: float = 60.0
    backoff_multiplier: float = 2.0
    user_agent: str = "quern"
    pii_action: str = "redact"
    min_confidence: float = 0.5
    alert_on_sensitive: bool = True
    breaking_threshold: float = 0.70
    variant_threshold: float = 0.85
    structure_ttl: int = 604_800
    robots_ttl: int = 86_400
    max_versions: int = 10
    timeout: float = 30.0
    max_content_size: int = 10_485_760
    render_wait: str = "networkidle"
    block_resources: tuple[str, ...] = ("image", "media", "font")
    alert_min_severity: str = "warning"
    alert_throttle_minutes: int = 60
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, text: str, **own) -> Options:
        """Options from YAML; those given as arguments win."""
        data = yaml.safe_load(text) or {}
        flat = {k: v for name in SECTIONS for k, v in (data.get(name) or {}).items()} | own
        if missing := [k for k in ("seed_urls", "output_dir") if not flat.get(k)]:
            raise ValueError(f"missing: {', '.join(missing)}")
        known = {f.name for f in fields(cls)} - {"extra"}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in known}, extra={k: v for k, v in data.items() if k not in SECTIONS})

    def save(self) -> str:
        own = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if k != "extra"}
        return yaml.safe_dump({"crawl": own, **self.extra}, sort_keys=True)
