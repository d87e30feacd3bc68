"""The pipeline's stages against what was planted, and its columns."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from quern.llm import packing, pii
from tests.llm.test_llm import edited, jaccard_classes, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    passage = prose(77, 120)
    rows = []
    for i in range(300):
        words = prose(i, 80).split()
        if i % 5 == 0:
            words.insert(random.Random(i).randrange(80), f"grobian{i % 9}")
        rows.append((i, " ".join(words)))
    rows += [(400 + i, edited(rows[301 - 300 + i][1], i, 1)) for i in range(3)] + [(500 + i, f"{prose(900 + i, 50)} {passage} {prose(950 + i, 50)}") for i in range(4)]
    rows += [(600, "write to someone@example.org now please"), (601, None), (602, ""), (None, "no id here")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, dict(rows), passage


def test_stages(spark, folder):
    d, rows, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "suffix_array", "private_data", "packing"]
    clean = stages["toxicity"](spark, docs, d)
    assert clean.columns == docs.columns
    ids = {r["doc_id"] for r in clean.collect()}
    assert ids >= {i for i in rows if i is None or i >= 400} and len(ids & {i for i in range(300) if i % 5 == 0}) <= 3 and len({i for i in range(300) if i % 5} - ids) <= 3
    one = stages["near_duplicates"](spark, clean, d)
    kept = {r["doc_id"] for r in one.collect()}
    assert one.columns == docs.columns and ids - kept == {i for i in (400, 401, 402) if i - 399 in ids}
    short = stages["suffix_array"](spark, one, d)
    texts = {r["doc_id"]: r["text"] for r in short.collect()}
    assert short.columns == docs.columns and set(texts) == kept and all(passage[50:400] not in texts[i] and texts[i].startswith(prose(900 + i - 500, 50)[:200]) for i in range(500, 504))
    safe = stages["private_data"](spark, short, d)
    assert safe.columns == docs.columns and "someone@example.org" not in {r["doc_id"]: r["text"] for r in safe.collect()}[600]
    assert stages["packing"](spark, safe, d).select("doc_id").distinct().count() == len(kept)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def rows_of(spark, rows):
    """Documents with a clashing extra column, in several partitions."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOCS + ", words string").repartition(3)


def brute_repeats(texts, least):
    """What is left of ASCII texts without the strings of `least` bytes that start elsewhere too."""
    count = Counter(t[j : j + least] for t in texts for j in range(len(t) - least + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for j in range(len(t) - least + 1):
            if count[t[j : j + least]] > 1:
                cover[j : j + least] = b"\1" * least
        out.append("".join(c for c, x in zip(t, cover) if not x))
    return out


def test_stages_by_brute_force(spark, folder):
    """Near-duplicates, repeated strings and surrogates against plain loops, over passages of the driver's own benchmark."""
    bench = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    bench = [t for t in bench if len(t.split()) > 50 and t.isascii()]
    assert bench and max(map(len, bench)) < 400
    rows = [(i, f"{prose(2000 + i, 30, 5000)} {bench[i % len(bench)]} {prose(3000 + i, 30, 5000)}") for i in range(6 * len(bench))]
    rows += [(500 + i, edited(prose(4000 + i // 5, 120, 5000), i, i % 4)) for i in range(40)] + [(600, "short"), (601, "short"), (602, "Mail Dr. John Smith at j.smith@example.org, please"), (603, "")]
    docs, d = rows_of(spark, rows), folder[0]
    classes = jaccard_classes(rows)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, d)
    kept = sorted((i, t) for k, (i, t) in enumerate(rows) if classes[k] == k)
    assert sorted((r["doc_id"], r["text"]) for r in one.collect()) == kept
    short = corpus_pipeline.drop_repeats(spark, one, d)
    want = dict(zip((i for i, _ in kept), brute_repeats([t for _, t in kept], corpus_pipeline.REPEAT_BYTES)))
    got = {r["doc_id"]: r for r in short.collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert not any(p in r["text"] for p in bench for r in got.values()) and want[600] == "short"  # passages of 300 to 394 bytes are gone
    safe = {r["doc_id"]: r["text"] for r in corpus_pipeline.replace_private(spark, short, d).collect()}
    key = hashlib.sha256(pii.session_key(spark).encode()).digest()
    assert safe == {i: pii.replace(t, lambda kind, x: pii.surrogate(kind, x, key))[0] for i, t in want.items()} and "j.smith@" not in safe[602]
    pieces = corpus_pipeline.pack_sequences(spark, corpus_pipeline.replace_private(spark, short, d), d).groupBy("doc_id").sum("length").collect()
    encode = packing.encoder()
    assert {r[0]: r[1] for r in pieces} == {i: len(encode(t)) + 1 for i, t in safe.items()}


def test_odd_rows(spark, folder):
    """Each stage with nulls, empty texts, repeated rows, a very long text, and an empty table."""
    long = " ".join(prose(k, 3000, 9000) for k in range(12))
    rows = [(1, None), (2, ""), (3, long), (None, "no id"), (None, "no id"), (4, "twice the same row"), (4, "twice the same row"), (5, " \n ")]
    docs, d = rows_of(spark, rows), folder[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == list(corpus_pipeline.COLUMNS) and stage(spark, docs.limit(0), d).count() == 0, name
        texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
        assert texts == sorted((i or 0, t or "") for i, t in rows), name  # clean documents stay, and so do rows without an id
    assert corpus_pipeline.pack_sequences(spark, docs, d).count() > 0 and corpus_pipeline.pack_sequences(spark, docs.limit(0), d).count() == 0


def test_one_id_with_several_texts(spark, folder):
    """Every stage keeps the texts that its own decisions don't concern, whatever else has their id."""
    one, two, far = prose(7001, 90, 5000), prose(7002, 90, 5000), prose(7003, 90, 5000)
    rows = [(0, one), (1, one), (1, far), (2, edited(one, 5, 1)), (2, two), (2, ""), (3, far), (3, edited(far, 6, 1)), (4, prose(7004, 90, 5000)), (4, None)]
    docs, d = rows_of(spark, rows), folder[0]
    kept = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, d).collect())
    classes = jaccard_classes([(k, t or "") for k, (_, t) in enumerate(rows)])
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(classes[k] if t else ("own", k), []).append((i, hashlib.md5(" ".join((t or "").lower().split()).encode()).digest(), t or ""))
    assert kept == sorted((min(g)[0], min(g)[2]) for g in groups.values()) and (1, far) in kept and (2, two) in kept
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_repeats, corpus_pipeline.replace_private):
        got = sorted((r["doc_id"], len(r["text"] or "")) for r in stage(spark, rows_of(spark, [(1, one), (1, far), (2, two), (2, None)]), d).collect())
        assert got == sorted([(1, len(one)), (1, len(far)), (2, len(two)), (2, 0)]), stage
