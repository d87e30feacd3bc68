"""Sitemaps: XML or gzip files to rows, and index files followed level by level."""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.functions import schedule as S, url as U

ROWS = "sitemap_url string, kind string, loc string, lastmod string, changefreq string, priority double"
# Where sitemaps usually are.
PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml", "/sitemap.xml.gz")


def parse(data: bytes | None) -> list[tuple[str, str, str | None, str | None, float | None]]:
    """(kind, loc, lastmod, changefreq, priority) of each entry; kind is url or sitemap. A broken file has none."""
    data = data or b""
    try:
        if data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
        root = ET.fromstring(data)
    except (ET.ParseError, OSError, EOFError):
        return []
    out = []
    for node in root:
        kind = node.tag.rsplit("}", 1)[-1]
        part = {c.tag.rsplit("}", 1)[-1]: (c.text or "").strip() for c in node}
        if kind in ("url", "sitemap") and part.get("loc"):
            try:
                priority = min(1.0, max(0.0, float(part["priority"])))
            except (KeyError, ValueError):
                priority = None
            freq = part.get("changefreq", "").lower()
            out.append((kind, part["loc"], part.get("lastmod") or None, freq if freq in {f[0] for f in S.FREQUENCIES} else None, priority))
    return out


def entries(files: DataFrame) -> DataFrame:
    """Entries of `files` (url, content binary), with `modified`, the date of lastmod where it can be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, *e) for u, c in zip(b["url"], b["content"], strict=True) for e in parse(c)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])

    return files.select("url", "content").mapInPandas(run, ROWS).withColumn("modified", S.lastmod(F.col("lastmod")))


def discover(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """The first default path of each site (url) that `responses` (url, status) answers with 200."""
    tried = sites.select("url", F.posexplode(F.transform(F.array(*[F.lit(p) for p in PATHS]), lambda p: F.concat(U.scheme("url"), F.lit("://"), U.part("url", 2), p))).alias("rank", "candidate"))
    hit = tried.join(responses.where("status = 200").select(F.col("url").alias("candidate")), "candidate", "left_semi")
    return hit.groupBy("url").agg(F.min_by("candidate", "rank").alias("sitemap_url"))


def follow(starts: DataFrame, parsed: DataFrame, levels: int = 100, cut=lambda df: df) -> DataFrame:
    """Page entries reachable from `starts` (url) over index files among `parsed` entries, each file once, until no new file
    is found or `levels` are. `cut` breaks the lineage of a level."""
    index = parsed.where("kind = 'sitemap'").select("sitemap_url", F.col("loc").alias("url"))
    seen = front = cut(starts.select("url").distinct())
    for _ in range(levels):
        step = index.join(front.select(F.col("url").alias("sitemap_url")), "sitemap_url").select("url").distinct()
        front = cut(step.join(seen, "url", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return parsed.where("kind = 'url'").join(seen.select(F.col("url").alias("sitemap_url")).distinct(), "sitemap_url")


def of_domain(rows: DataFrame, domain: str) -> DataFrame:
    return rows.where(U.domain("loc") == domain)


def keep(priority: Column, modified: Column, least: float, since: Column | None) -> Column:
    """The filter of sitemap entries: a priority of 0 or none passes, as does an unknown date."""
    ok = priority.isNull() | (priority == 0) | (priority >= least)
    return ok if since is None else ok & (modified.isNull() | (modified >= since))


def page_urls(spark: SparkSession, path: str, domain: str | None = None, limit: int = 50_000) -> DataFrame:
    """The page entries of the sitemap files under a path (XML or gzip), of one domain if it is named: at most `limit` per file,
    in the order of the file's addresses."""
    rows = entries(spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")).where("kind = 'url'")
    rows = rows if domain is None else of_domain(rows, domain)
    first = Window.partitionBy("sitemap_url").orderBy("loc")
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")
