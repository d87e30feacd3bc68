"""Keyed versioned tables: save, latest, history, statistics, expiry; signatures of structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions import text as T


def save(store: DataFrame, rows: DataFrame, key: list[str], keep: int | None = None) -> DataFrame:
    """`store` (key, version, captured_at, ...) with `rows` (no version) added as next versions in time order; at most the
    newest `keep` of each key stay."""
    top = store.groupBy(*key).agg(F.max("version").alias("_top"))
    order = Window.partitionBy(*key).orderBy("captured_at")
    fresh = rows.join(top, key, "left").withColumn("version", (F.row_number().over(order) + F.coalesce("_top", F.lit(0))).cast("int")).drop("_top")
    out = store.unionByName(fresh.select(store.columns))
    return history(out, key, keep).drop("age") if keep else out


def history(store: DataFrame, key: list[str], n: int) -> DataFrame:
    """The newest n versions of each key, `age` 1 the latest."""
    w = Window.partitionBy(*key).orderBy(F.desc("version"))
    return store.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def latest(store: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in store.columns if c not in key]
    return store.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(*key, "_r.*")


def delete(store: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return store.join(gone.select(*key).distinct(), key, "left_anti")


def upsert(store: DataFrame, rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """One row per key, the latest by `at`."""
    both = store.unionByName(rows)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*key, "_r.*").select(both.columns)


def unexpired(store: DataFrame, at: str, seconds: int, now: Column) -> DataFrame:
    return store.where(F.col(at) + F.make_interval(secs=F.lit(seconds)) > now)


def stats(store: DataFrame, by: list[str]) -> DataFrame:
    """Rows per value of each column of `by`, and in all, in one pass; `level` names the column."""
    level = F.lit("all")
    for c in reversed(by):
        level = F.when(F.grouping(c) == 0, c).otherwise(level)
    sets = store.groupingSets([[c] for c in by] + [[]], *by)
    return sets.agg(level.alias("level"), F.count(F.lit(1)).alias("n")).select(
        "level", F.coalesce(*[F.when(F.col("level") == c, F.col(c).cast("string")) for c in by], F.lit("")).alias("value"), "n")


def variant_stats(rows: DataFrame) -> DataFrame:
    """Variants of each key: `rows` (domain, page_type, variant_id) with `variants`, a row per domain and type."""
    return rows.groupBy("domain", "page_type").agg(F.count_distinct("variant_id").alias("variants"))


def variant_totals(rows: DataFrame) -> DataFrame:
    """Of `rows` (domain, page_type, variant_id) in all: variants, keys (domain and type), keys and domains with several variants
    (a domain, in one of its types). Nothing is 0 and one row."""
    several = F.col("variants") > 1
    return variant_stats(rows).agg(
        F.coalesce(F.sum("variants"), F.lit(0)).alias("variants"), F.count(F.lit(1)).alias("keys"), F.count_if(several).alias("keys_with_several"), F.count_distinct(F.when(several, F.col("domain"))).alias("domains_with_several"))


def save_baselines(saved: DataFrame | None, rows: DataFrame, at: str) -> DataFrame:
    """One baseline per domain and page_type: the latest of `rows` by `at`, in place of what was saved before."""
    key = ["domain", "page_type"]
    rest = [c for c in rows.columns if c not in key]
    new = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*key, "_r.*").select(rows.columns)
    return new if saved is None else saved.join(new, key, "left_anti").select(new.columns).union(new)


def drift(current: DataFrame, baselines: DataFrame, key: list[str], least: float = 0.85) -> DataFrame:
    """`current` with score, the cosine to the baseline of its key, and status ok, drifted, or error where there is none."""
    pairs = current.join(baselines.select(*key, F.col("embedding").alias("_base")), key, "left")
    score = F.round(T.cosine(F.col("_base"), F.col("embedding")), 6)
    status = F.when(F.col("score").isNull(), "error").when(F.col("score") < least, "drifted").otherwise("ok")
    return pairs.withColumn("score", F.when(F.col("_base").isNotNull(), score)).drop("_base").withColumn("status", status)


def signature(tags: Column, classes: Column, marks: Column) -> Column:
    """Hashes of tag counts, classes and landmarks, each over sorted JSON."""
    h = lambda c: F.substring(F.md5(F.to_json(c)), 1, 16)
    return F.struct(h(F.array_sort(F.map_entries(tags))).alias("tags"), h(F.array_sort(classes)).alias("classes"), h(F.array_sort(F.map_entries(marks))).alias("landmarks"))


def same_signature(a: Column, b: Column) -> Column:
    """Landmarks don't count."""
    return (a["tags"] == b["tags"]) & (a["classes"] == b["classes"])


def clean_json(text: Column) -> Column:
    """A language model's JSON answer without its code fence, as a variant; null where it isn't JSON."""
    return F.try_parse_json(F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")))


def strategy_override(rule: Column, selector: Column) -> Column:
    """A rule (primary, fallbacks, confidence, source) set by hand: full confidence, the old selector becomes the first fallback."""
    return F.struct(selector.alias("primary"), F.concat(F.array(rule["primary"]), rule["fallbacks"]).alias("fallbacks"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"))
