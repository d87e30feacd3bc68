"""Fingerprint, duplicate and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import text as T
from quern.operators import dedup, vectors
from quern.sources import shared
from quern.sources.tables import table

NORM = r"""regexp_replace(trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '\s+', ' ', 'g')), '[^\p{L}\p{N}\p{M}_\s]', '', 'g')"""
WORDS = "list_filter(string_split(t, ' '), lambda w: w <> '')"
PRINTS = f"""SELECT doc_id, md5(t) AS md5, len(w) AS word_count, length(t) AS char_count,
  CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END AS parts
FROM (SELECT doc_id, t, {WORDS} AS w FROM (SELECT doc_id, {NORM} AS t FROM documents))"""
HASHES = f"""SELECT doc_id, any_value(md5) AS md5, any_value(word_count) AS word_count, any_value(char_count) AS char_count,
  CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS simhash FROM (
  SELECT p.doc_id, md5, word_count, char_count, coalesce(s.h, 0) AS h FROM ({PRINTS}) p LEFT JOIN (
    SELECT doc_id, sum(CASE WHEN v > 0 THEN (1::HUGEINT << CAST(b AS INTEGER)) ELSE 0 END)::HUGEINT AS h FROM (
      SELECT doc_id, b, sum(2 * CAST((x >> b) & 1 AS BIGINT) - 1) AS v FROM (
        SELECT doc_id, CAST(concat('0x', substr(md5(s), 17, 16)) AS UBIGINT) AS x FROM (SELECT doc_id, unnest(parts) AS s FROM ({PRINTS}))), (SELECT CAST(unnest(range(64)) AS UBIGINT) AS b)
      GROUP BY doc_id, b) GROUP BY doc_id) s USING (doc_id)) GROUP BY doc_id, h"""


def content_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.fingerprints(table(spark, sf, "documents"))


def exact_dups(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("md5"))
    return t.groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def _hashes(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """The fingerprints of a table, computed once: joins on them read what is written."""
    return shared.written(dedup.fingerprints(table(spark, sf, name), key).select(key, "simhash"))


def near_dup_classes(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_duplicates(_hashes(spark, sf, "documents", "doc_id"))


def simhash_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against the benchmark: equal text or similarity of 0.9 or more."""
    docs, items = _hashes(spark, sf, "documents", "doc_id"), _hashes(spark, sf, "benchmark", "item_id")
    links = dedup.hamming_pairs(docs, 6, others=items)
    hits = links.join(items.select("item_id", F.col("simhash").alias("b")), "b").groupBy("a").agg(F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"))
    return docs.select("doc_id", F.col("simhash").alias("a")).join(hits, "a").select("doc_id", "n_items", "first_item")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by twenty, among all."""
    e = table(spark, sf, "embeddings")
    return vectors.top_k(e.where("vec_id % 20 = 0"), e, 5)


def similar_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Up to ten vectors of a cosine of 0.2 or more, of every vector whose id is divisible by twenty."""
    e = table(spark, sf, "embeddings")
    return vectors.top_k(e.where("vec_id % 20 = 0"), e, 10, 0.2)


def _baseline(e: DataFrame) -> DataFrame:
    """The first vector of each label is its baseline."""
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))


def drift_from_baseline(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.drift(e, _baseline(e), "label")


def drift_totals(spark: SparkSession, sf: str) -> DataFrame:
    return drift_from_baseline(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def label_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Cosines between the baselines of all labels, a row and a column for each of the ten labels."""
    return vectors.matrix(_baseline(table(spark, sf, "embeddings")), "label", list(range(10)), "l")


def similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Training pairs of the label baselines: 1 within a type (the parity of the label), else 0."""
    b = _baseline(table(spark, sf, "embeddings")).select("label")
    pairs = vectors.pairs(b, "label").where("a < b")
    return pairs.select("a", "b", F.when(F.expr("a % 2 = b % 2"), 1.0).otherwise(0.0).alias("target"))


def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("enough", F.col("n") >= 10)


COS = "coalesce(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 0)"
TOPK = f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT query_id, vec_id, round({COS}, 6) AS score FROM embeddings, (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0) WHERE vec_id <> query_id))"""
BASE = "(SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label)"
DRIFT = f"""SELECT vec_id, label, score, CASE WHEN score IS NULL THEN 'error' WHEN score < 0.85 THEN 'drifted' ELSE 'ok' END AS status
  FROM (SELECT e.vec_id, e.label, CASE WHEN q IS NOT NULL THEN round({COS}, 6) END AS score FROM embeddings e LEFT JOIN {BASE} b USING (label))"""

QUERIES = {f.__name__: f for f in (
    content_fingerprint, exact_dups, near_dup_classes, simhash_duplicates, cosine_topk, similar_threshold, drift_from_baseline, drift_totals, label_matrix,
    similarity_pairs, label_distribution)}
ORACLE_SQL = {
    "content_fingerprint": HASHES,
    "exact_dups": f"SELECT md5(t) AS md5, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {NORM} AS t FROM documents) GROUP BY 1 HAVING count(*) > 1",
    "near_dup_classes": f"""WITH h AS MATERIALIZED ({HASHES}), u AS MATERIALIZED (SELECT simhash, count(*) AS copies FROM h GROUP BY 1)
      SELECT doc_id, h.simhash, copies, coalesce(n, 0) AS n_near FROM h JOIN u USING (simhash) LEFT JOIN (
        SELECT a.simhash, count(*) AS n FROM u a, u b WHERE a.simhash <> b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 9 GROUP BY 1) USING (simhash)""",
    "simhash_duplicates": f"""WITH h AS MATERIALIZED ({HASHES}), i AS MATERIALIZED ({HASHES.replace('documents', 'benchmark_docs')})
      SELECT h.doc_id, count(*) AS n_items, min(i.doc_id) AS first_item FROM h JOIN i ON bit_count(xor(h.simhash, i.simhash)) <= 6 GROUP BY 1""".replace(
        "FROM benchmark_docs", "FROM (SELECT item_id AS doc_id, text FROM benchmark)"),
    "cosine_topk": TOPK + " WHERE rank <= 5",
    "similar_threshold": TOPK.replace("WHERE vec_id <> query_id))", "WHERE vec_id <> query_id) WHERE score >= 0.2)") + " WHERE rank <= 10",
    "drift_from_baseline": DRIFT,
    "drift_totals": f"SELECT status, count(*) AS n FROM ({DRIFT}) GROUP BY 1",
    "label_matrix": f"""SELECT a, {', '.join(f'max(s) FILTER (b = {i}) AS l{i}' for i in range(10))} FROM (
      SELECT x.label AS a, y.label AS b, round(list_cosine_similarity(CAST(x.q AS DOUBLE[]), CAST(y.q AS DOUBLE[])), 6) AS s FROM {BASE} x, {BASE} y) GROUP BY 1""",
    "similarity_pairs": f"SELECT x.label AS a, y.label AS b, CASE WHEN x.label % 2 = y.label % 2 THEN 1.0::DOUBLE ELSE 0.0 END AS target FROM {BASE} x, {BASE} y WHERE x.label < y.label",
    "label_distribution": "SELECT quality, toxic, count(*) AS n, count(*) >= 10 AS enough FROM labels GROUP BY ALL",
}
