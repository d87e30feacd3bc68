"""One crawl over tables: from seeds along links, through the gate, to extractions, structures, a log and totals.

Pages are a table (page_id, url, html): what a fetcher has stored. Everything is one DataFrame plan per output; hooks get
DataFrames, not rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern import plugins
from quern.functions import url as U
from quern.operators import compliance, extract, frontier, lifecycle, metrics, pii, ranking, strategies, structure
from quern.sources import sinks
from quern.sources.sinks import Options


@dataclass
class Crawl:
    """The tables of a crawl, not yet computed: pages reached with depth and status, extractions, structures, log and totals; and
    what was learned: the life cycle of the structures, the versions of variants and of strategies that it leads to."""

    pages: DataFrame
    extractions: DataFrame
    structures: DataFrame
    log: DataFrame
    totals: DataFrame
    life: DataFrame
    variants: DataFrame
    strategies: DataFrame


@dataclass
class Learned:
    """What earlier crawls learned: all versions of variants (`lifecycle.VERSION`) and of their strategies."""

    variants: DataFrame
    strategies: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Learned | None:
        """What is kept under `path`; None where there is nothing yet."""
        try:
            return cls(spark.read.parquet(f"{path}/variants.parquet"), spark.read.parquet(f"{path}/strategies.parquet"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    @staticmethod
    def keep(done: Crawl, path: str) -> None:
        """Adds a crawl's versions. Variants come last: what only has strategies is learned again, under the same versions."""
        done.strategies.write.mode("append").parquet(f"{path}/strategies.parquet")
        done.variants.write.mode("append").parquet(f"{path}/variants.parquet")


#: Options of a fetcher, a renderer, an alerter or a store, which a crawl of stored pages hasn't.
WITHOUT_EFFECT = (
    "priority_boost_patterns", "respect_crawl_delay", "adaptive", "default_delay", "min_delay", "max_delay", "backoff_multiplier", "min_confidence", "robots_ttl",
    "max_versions", "timeout", "render_wait", "block_resources", "alert_min_severity", "alert_throttle_minutes",
)


def refuse(options: Options) -> None:
    """An error that names the options that were set but would do nothing."""
    defaults = {f.name: f.default for f in fields(Options)}
    if idle := [n for n in WITHOUT_EFFECT if getattr(options, n) != defaults[n]]:
        raise ValueError(f"without effect on stored pages: {', '.join(idle)}")


def reach(pages: DataFrame, options: Options, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pages that links lead to from the seeds, with depth; per site at most max_pages_per_domain, in all max_pages, nearest
    first. Pages with one normalized address are one page, that of the least id."""
    named = pages.withColumn("norm_url", U.normalize(F.col("url")))
    one = named.groupBy("norm_url").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("p")).select("norm_url", "p.*")
    links = extract.page_links(one)
    taken = extract.follow(links, external=options.follow_external, allowed=options.allowed_domains, exclude=options.exclude_patterns, resources=options.extract_resources, nofollow=options.follow_nofollow)
    edges = taken.join(one.select("page_id", F.col("norm_url").alias("from")), "page_id").select(F.col("from").alias("url"), F.col("norm_url").alias("target"))
    edges = cut(edges.join(one.select(F.col("norm_url").alias("target")), "target", "left_semi").distinct())
    spark = pages.sparkSession
    seeds = spark.createDataFrame([(u,) for u in options.seed_urls], "url string").select(U.normalize(F.col("url")).alias("url"))
    found = frontier.crawl(seeds, edges.select("url", "target"), options.max_depth, cut)
    got = one.join(found.withColumnRenamed("url", "norm_url"), "norm_url").withColumn("domain", U.domain("url")).withColumn("score", F.col("depth"))
    if options.max_pages_per_domain:
        got = frontier.pop(got, options.max_pages_per_domain).drop("rank")
    if options.max_pages:
        got = ranking.leading(got, options.max_pages, ["depth", "url"]).drop("rank")
    return got.drop("score")


def gated(pages: DataFrame, robots: DataFrame | None, blocklist: DataFrame | None, agent: str) -> DataFrame:
    """`pages` with basis, allowed and status, by `robots` files (domain, content, status) and blocked domains, if given."""
    rows = pages.withColumn("key", F.col("page_id"))
    if robots is None:
        rows = rows.withColumn("allowed", F.lit(True))
    else:
        urls = rows.select("key", "domain", U.path("url").alias("path"))
        rows = rows.join(compliance.allowed(urls, compliance.agent_rules(compliance.robots(robots), agent)).select("key", "allowed"), "key")
    if blocklist is None:
        rows = rows.withColumn("blocked", F.lit(False))
    else:
        rows = compliance.blocked_domain(rows, blocklist)
    no = F.lit(False)
    basis = compliance.authorization(F.col("blocked"), no, no, F.col("allowed"), no, no)
    rows = rows.withColumn("basis", basis)
    return rows.withColumn("status", compliance.gate(U.is_private("url"), F.col("basis"), F.col("allowed"))).drop("key", "blocked")


def _private(extractions: DataFrame, options: Options, salt: str | None) -> DataFrame:
    """Extractions with personal data in their content treated as the options say; excluded pages are left out."""
    safe = pii.processed(extractions.select("page_id", F.col("content").alias("text")), options.pii_action, key="page_id", salt=salt, alert_on_sensitive=options.alert_on_sensitive)
    return extractions.drop("content").join(safe.where("not excluded").select("page_id", F.col("text").alias("content"), "n_matches"), "page_id")


def _lived(
    shapes: DataFrame, named: DataFrame, pages: DataFrame, options: Options, learned: Learned | None, at: int, cut: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The life cycle of the structures, and the versions of variants and strategies that come of it."""
    order = Window.partitionBy("domain", "page_type").orderBy("depth", "url", "page_id")
    seq = named.select("page_id", F.row_number().over(order).cast("bigint").alias("seq"))
    rows = shapes.join(seq, "page_id").withColumn("key", F.concat_ws("/", "domain", "page_type")).withColumn("at", F.lit(at).cast("bigint")).withColumn("fingerprint", structure.fingerprint())
    rows = cut(rows.select("key", "seq", "at", "page_id", "fingerprint", *lifecycle.COLUMNS))
    known = None if learned is None else cut(lifecycle.stored(learned.variants))
    life = cut(lifecycle.life_cycle(rows, known=known, least=options.variant_threshold, breaking=options.breaking_threshold, seconds=options.structure_ttl))
    return life, lifecycle.versions(life, rows, known), strategies.lived(life, pages, None if learned is None else learned.strategies)


def crawl(
    spark: SparkSession, pages: DataFrame, options: Options, *, robots: DataFrame | None = None, blocklist: DataFrame | None = None, salt: str | None = None,
    learned: Learned | None = None, at: int | None = None, cut: Callable[[DataFrame], DataFrame] = frontier.shared_cut,
) -> Crawl:
    """The tables of a crawl of `pages` from the options' seeds. Options that stored pages give no meaning are refused.

    Each structure goes through the life of its site's and page type's variants, in the order of depth and address, from what
    `learned` holds; a variant's strategy is inferred, or adapted where the structure broke. `at` is the time in Unix seconds (now).
    """
    refuse(options)
    rows = gated(reach(pages, options, cut), robots if options.respect_robots else None, blocklist, options.user_agent)
    large = (F.col("status") == "success") & (F.octet_length("html") > options.max_content_size)
    rows = cut(rows.withColumn("status", F.when(large, "error_content_too_large").otherwise(F.col("status"))))
    good = rows.where("status = 'success'")
    got = extract.extractions(good.select("page_id", "url", "html")).join(good.select("page_id", "url", "domain", "depth"), "page_id")
    named = good.select("page_id", "domain", "depth", "url", U.classify(F.col("url"), U.PAGE_TYPES, "general").alias("page_type"))
    shapes = structure.structures(good).join(named.drop("depth", "url"), "page_id")
    life, variants, rules = _lived(shapes, named, good, options, learned, int(time.time()) if at is None else at, cut)
    is_: Callable[[str], Column] = lambda s: F.count_if(F.col("status").startswith(s))
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("status", "domain", F.length("html").alias("n"), none("string").alias("action")).unionByName(life.select("action"), allowMissingColumns=True)
    totals = both.agg(
        is_("success").alias("pages_crawled"), is_("blocked").alias("pages_blocked"), F.count_distinct("domain").alias("domains"), F.sum(F.when(F.col("status") == "success", F.col("n"))).alias("characters"),
        F.count_if(F.col("action").isin("learned", "relearned")).alias("structures_learned"), F.count_if(F.col("action") == "adapted").alias("structures_adapted"))
    return Crawl(rows, _private(got, options, salt), shapes, metrics.log(rows), totals, life, variants, rules)


def run_crawl(
    spark: SparkSession, pages: DataFrame, seed_urls: list[str], output_dir: str, *, robots: DataFrame | None = None, blocklist: DataFrame | None = None, salt: str | None = None,
    store: str | None = None, at: int | None = None, html: bool = False, on_pages_crawled: Callable[[DataFrame], object] | None = None, on_error: Callable[[DataFrame], object] | None = None, **options,
) -> dict:
    """Crawls `pages` and writes extractions (JSON, a folder per site), structures, log and totals under `output_dir`; returns the
    totals. Variants and strategies are read from `store` and their new versions added there, if it is given;
    `html` also keeps the pages fetched. Hooks get the written extractions and the log of what was blocked; what they raise is logged."""
    known = Options(seed_urls=tuple(seed_urls), output_dir=output_dir, **options)
    done = crawl(spark, pages, known, robots=robots, blocklist=blocklist, salt=salt, learned=Learned.load(spark, store) if store else None, at=at)
    sinks.write_pages(done.extractions, f"{output_dir}/extracted")
    sinks.write_state({"structures": done.structures, "log": done.log, "totals": done.totals}, output_dir)
    if html:
        sinks.write_html(done.pages.where("status = 'success'"), f"{output_dir}/html")
    if store:
        Learned.keep(done, store)
    plugins.guarded(on_pages_crawled, spark.read.json(f"{output_dir}/extracted"))
    plugins.guarded(on_error, spark.read.parquet(f"{output_dir}/log.parquet").where("event <> 'fetch_success' and step = 2"))
    return spark.read.parquet(f"{output_dir}/totals.parquet").first().asDict()
