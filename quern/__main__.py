"""The command line: crawl tables of pages, work on structures as a model's data, and look into what is stored.

    python -m quern crawl -u URL -o DIR --pages PAGES.parquet [--robots FILE] [--config FILE.yaml] [...]
    python -m quern ml {describe,embed,export,similar,train,predict,pairs,set-baselines,list-baselines,drift,compare} --pages ... [...]
    python -m quern inspect {stats,list,search,compare,history,fingerprint,export} --pages ... [...]

Results are shown, or written as Parquet where --output is given.
"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern import plugins, run
from quern.functions import url as U
from quern.operators import compliance, learn, store, structure, vectors
from quern.session import get_spark
from quern.sources import sinks


def structures(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The structures of the pages, with site, type and order."""
    pages = spark.read.parquet(a.pages)
    named = pages.select("page_id", "url", U.domain("url").alias("domain"), U.classify(F.col("url"), U.PAGE_TYPES, "general").alias("page_type"))
    rows = structure.structures(pages).join(named, "page_id")
    return rows.where(F.col("domain") == a.domain) if getattr(a, "domain", None) else rows


def described(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    kind = plugins.descriptions(a.describe)
    return structures(spark, a).withColumn("description", kind.page(F.col("domain"), F.col("page_type"))).select("page_id", "domain", "page_type", "description")


def embedded(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return plugins.embedding("hashed")(described(spark, a), "description")


def pairs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Consecutive structures of a site."""
    s = structures(spark, a)
    row = F.struct(*[c for c in s.columns if c not in ("url",)])
    order = Window.partitionBy("domain", "page_type").orderBy("page_id")
    return s.select("page_id", "domain", "page_type", row.alias("new"), F.lag(row).over(order).alias("old")).where("old is not null")


def similar(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    e = embedded(spark, a).select(F.col("page_id").alias("vec_id"), "embedding")
    return vectors.top_k(e.where(F.col("vec_id") == a.page), e, a.k)


def trained(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    model, accuracy = learn.train(embedded(spark, a), "page_type", a.model, folds=a.folds)
    learn.save(model, a.path)
    return spark.createDataFrame([(a.model, float(accuracy))], "model string, accuracy double")


def predicted(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return learn.predict(learn.load(a.path), embedded(spark, a)).select("page_id", "page_type", "predicted", "confidence")


def training_pairs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Pairs of the sites' page types, which are few: target 1 where the types are one, else 0."""
    shapes = structures(spark, a).select("domain", "page_type").distinct().withColumn("shape", F.concat_ws("|", "domain", "page_type"))
    both = vectors.pairs(shapes, "shape").where("a < b")
    return both.select("a", "b", F.when(F.col("x_page_type") == F.col("y_page_type"), 1.0).otherwise(0.0).alias("target"))


def set_baselines(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    saved = store.save_baselines(None, embedded(spark, a).select("domain", "page_type", "page_id", "embedding"), "page_id")
    saved.write.mode("overwrite").parquet(a.path)
    return spark.read.parquet(a.path).groupBy("page_type").agg(F.count(F.lit(1)).alias("baselines"))


def drift(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = store.drift(embedded(spark, a).select("domain", "page_type", "page_id", "embedding"), spark.read.parquet(a.path), ["domain", "page_type"])
    return rows.select("domain", "page_type", "page_id", "score", "status")


def compared(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return structure.compare_versions(pairs(spark, a)).drop("old", "new")


def history(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    order = Window.partitionBy("domain", "page_type").orderBy("page_id")
    rows = structures(spark, a).select("domain", "page_type", "page_id", "content_hash", F.row_number().over(order).alias("version"))
    return store.history(rows, ["domain", "page_type"], a.k)


def searched(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.read.parquet(a.pages).where(F.lower("url").contains((a.text or "").lower())).select("page_id", "url").orderBy("url").limit(a.k)


def stats(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return store.stats(structures(spark, a).select("domain", "page_type"), ["domain", "page_type"])


ML: dict[str, Callable] = {
    "describe": described, "embed": embedded, "export": structures, "similar": similar, "train": trained, "predict": predicted, "pairs": training_pairs, "set-baselines": set_baselines,
    "list-baselines": lambda spark, a: spark.read.parquet(a.path).drop("embedding"), "drift": drift, "compare": compared,
}
INSPECT: dict[str, Callable] = {
    "stats": stats, "list": lambda spark, a: structures(spark, a).groupBy("domain", "page_type").agg(F.count(F.lit(1)).alias("pages")), "search": searched, "compare": compared, "history": history,
    "fingerprint": lambda spark, a: structures(spark, a).select("page_id", structure.monitor_fingerprint().alias("fingerprint")), "export": structures,
}


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="quern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("-v", "--verbose", action="store_true")
    top.add_argument("--master", default="local[*]")
    kinds = top.add_subparsers(dest="kind", required=True)
    c = kinds.add_parser("crawl")
    c.add_argument("-u", "--seed-url", action="append", default=[])
    c.add_argument("-o", "--output")
    c.add_argument("--pages", required=True)
    c.add_argument("--config", help="YAML options; the command line wins")
    c.add_argument("-r", "--rate-limit", type=float, help="requests per second and site")
    c.add_argument("-d", "--max-depth", type=int)
    c.add_argument("-p", "--max-pages", type=int)
    c.add_argument("--max-pages-per-domain", type=int)
    c.add_argument("-a", "--allowed-domains", action="append")
    c.add_argument("--exclude", dest="exclude_patterns", action="append")
    c.add_argument("--user-agent")
    c.add_argument("--robots", help="table of robots files (domain, content, status)")
    c.add_argument("--ignore-robots", action="store_true")
    c.add_argument("--blocklist", help="text file of blocked domains")
    c.add_argument("--pii", dest="pii_action", choices=["redact", "pseudonymize", "flag", "exclude"])
    c.add_argument("--salt")
    c.add_argument("--html", action="store_true", help="also write the pages")
    c.add_argument("--store", help="folder of the variants and strategies that crawls have learned")
    for name, table in (("ml", ML), ("inspect", INSPECT)):
        p = kinds.add_parser(name)
        p.add_argument("what", choices=sorted(table))
        p.add_argument("--pages", required=True)
        p.add_argument("--domain")
        p.add_argument("--describe", default="rules", choices=sorted(plugins.DESCRIPTIONS))
        p.add_argument("--page", type=int, help="the page to compare with")
        p.add_argument("-k", type=int, default=10)
        p.add_argument("--model", default="logistic", choices=["logistic", "forest", "boosted"])
        p.add_argument("--folds", type=int, default=0)
        p.add_argument("--path", help="where a model or baselines are kept")
        p.add_argument("--text", help="what to search for")
        p.add_argument("--output")
    return top.parse_args(given)


def options(a: argparse.Namespace) -> sinks.Options:
    """The options of a crawl: those of the file, then those of the command line."""
    own = {k: v for k in ("max_depth", "max_pages", "max_pages_per_domain", "user_agent", "pii_action") if (v := getattr(a, k)) is not None}
    own |= {k: tuple(v) for k in ("allowed_domains", "exclude_patterns") if (v := getattr(a, k))}
    own |= {"default_delay": 1 / a.rate_limit} if a.rate_limit else {}
    own |= {"seed_urls": tuple(a.seed_url)} if a.seed_url else {}
    own |= {"output_dir": a.output} if a.output else {}
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            return sinks.Options.load(f.read(), **own)
    if missing := [n for n in ("seed_urls", "output_dir") if n not in own]:
        raise ValueError(f"missing: {', '.join(missing)}")
    return sinks.Options(**own)


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(given)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.WARNING)
    own = spark is None
    spark = spark or get_spark(a.master)
    try:
        if a.kind == "crawl":
            o = options(a)
            known = {k: v for k, v in vars(o).items() if k not in ("seed_urls", "output_dir")}
            robots = spark.read.parquet(a.robots) if a.robots and not a.ignore_robots else None
            block = compliance.read_domains(spark, a.blocklist) if a.blocklist else None
            print(run.run_crawl(spark, spark.read.parquet(a.pages), list(o.seed_urls), o.output_dir, robots=robots, blocklist=block, salt=a.salt, store=a.store, html=a.html, **known))
            return 0
        out = {"ml": ML, "inspect": INSPECT}[a.kind][a.what](spark, a)
        if a.output:
            out.write.mode("overwrite").parquet(a.output)
        else:
            out.show(a.k, truncate=80)
        return 0
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
