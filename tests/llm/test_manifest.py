"""Fill-in-middle, the Merkle manifest and exact duplicates against plain loops, with odd rows, and their queries against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import exact, fim, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, mark string, place int"


def documents(spark, rows, parts=3):
    """(doc_id, text, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, s, None if t is None else len(t), "x", "y", 1) for i, t, s in rows], DOCS).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = ["", None, "a", "\n", "<P>", "x<S", "one\ntwo\n\nthree", "café \U0001f600 你好", "\x01\x02\x010\x021", "é‍\U0001f468‍\U0001f469", "$1 \\1 \\$", "\x00 nul"]
LONG = " ".join(f"w{k % 977}" for k in range(400_000))


# --- fill-in-middle


def cut_by_hand(i, text):
    h = sha(f"1:{'' if i is None else i}")
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    return (n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}")


def test_cuts(spark):
    r = random.Random(5)
    alphabet = "ab \n<>PSM\x01\x02$\\01é\U0001f600́"
    rows = [(k, t, "s") for k, t in enumerate(ODD)] + [(100 + k, "".join(r.choices(alphabet, k=r.randrange(40))), "s") for k in range(400)]
    rows += [(7, "twice", "s"), (7, "twice", "s"), (None, "no id", "s"), (900, LONG, "s")]
    got = fim.fill_in_middle(documents(spark, rows)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *cut_by_hand(i, t or ""), t or "") for i, t, _ in rows]
    assert sorted(map(str, ((x["doc_id"], x["n"], x["form"], x["prefix_units"], x["middle_units"], x["output"], x["back"]) for x in got))) == sorted(map(str, want))
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("unit, pattern", [("word", r"(?s)[^ \t-\r]+[ \t-\r]*|[ \t-\r]+"), ("line", r"(?s)[^\n]*\n|[^\n]+")])
def test_other_units(spark, unit, pattern):
    rows = [(k, t, "s") for k, t in enumerate(ODD + ["  lead and trail \n", "a\nb\nc", "\x01 \x02 \n\x01"])]
    for x in fim.fill_in_middle(documents(spark, rows), unit=unit, percent=100).collect():
        units = re.findall(pattern, x["text"])
        assert x["n"] == len(units) and "".join(units) == x["text"]
        if x["form"] != "plain":
            low, high = x["prefix_units"], x["prefix_units"] + x["middle_units"]
            p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
            assert x["output"] == (f"<S>{s}<P>{p}<M>{m}" if x["form"] == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_texts_are_marked_once(spark):
    plan = fim.fill_in_middle(documents(spark, [(1, "a", "s")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


# --- the manifest


def H(values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def coded(*values):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    """The root, and each leaf's siblings from the bottom up, as (slot, others)."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 3 * 3 : p // 3 * 3 + 3]
            paths[k].append((p % 3, run[: p % 3] + run[p % 3 + 1 :]))
        level = [H(level[k : k + 3]) for k in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], paths


def manifest_by_hand(rows):
    groups = defaultdict(list)
    for k, (i, t, s) in enumerate(rows):
        lang = "en" if (i or 0) % 2 else None
        of = lambda x: coded(i, s, lang, None if t is None else len(t), x)  # noqa: B023, E731
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        groups[s].append((i, of(t), of(t.replace("\n", "")) if even and t is not None else of(t)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(tree([x[1] for x in groups[s]]))
    root, over = tree([t[0] for t in trees])
    out = []
    for s, (sub, paths), above in zip(names, trees, over):
        for (i, leaf, claimed), path in zip(groups[s], paths):
            fold = claimed
            for slot, others in path + above:
                fold = H(others[:slot] + [fold] + others[slot:])
            out.append((i, leaf, sub, root, H(x for _, others in path + above for x in others), fold, fold == root))
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3}, {"a": 4, None: 1}, {"hot": 250, "": 2, None: 7, "你": 10, "z": 1, "Z": 28, "y": 9}])
def test_manifest(spark, tmp_path, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "LEAST", 10)  # several tasks a level
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, ODD[i % len(ODD)] if i % 3 else f"line {i}\nline", s))
            i += 1
    if len(sizes) > 3:
        rows += [(None, "no id", "hot"), (None, "no id", "hot"), (5, "again\n", "hot"), (5, "again\n", "hot"), (5, "other", "hot"), (800, LONG, "long")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_merkle_supersteps"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, manifest_by_hand(rows)))


def test_numbers_in_groups(spark):
    """A hot group over several tasks, with repeated rows."""
    r = random.Random(3)
    rows = [("hot" if k % 3 else f"g{k % 7}", r.randrange(50)) for k in range(600)]
    got = merkle.numbered(spark.createDataFrame(rows, "g string, v int").repartition(5), ["g"], ["v"]).collect()
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    assert sorted((x["g"], x["place"], x["v"], x["width"]) for x in got) == sorted((g, k, v, len(vs)) for g, vs in groups.items() for k, v in enumerate(sorted(vs)))


def test_manifest_of_nothing(spark):
    leaves = spark.createDataFrame([], "doc_id long, source string, leaf binary")
    out = merkle.manifest(leaves, carry=("doc_id",))
    assert out.count() == 0 and out.columns[0] == "doc_id"


# --- exact duplicates


@pytest.mark.parametrize("support", [0.001, 0.05])
def test_exact_duplicates(spark, support):
    """A group of a third of all rows, further groups, odd texts; with and without heavy hitters."""
    texts = ["hot  text\n"] * 40 + ["hot text "] * 41 + [t for t in ODD for _ in range(3)] + [f"own {k}" for k in range(100)] + ["a b", "a b", "a\tb", "a\x0bb", " ", "\n\n", LONG, LONG + " "]
    rows = [(1000 - k, t, "s") for k, t in enumerate(texts)] + [(None, "only without id", "s")] * 2 + [(None, "hot text ", "s"), (3, "tie", "s"), (3, "tie", "s")]
    got = exact.exact_duplicates(documents(spark, rows), support=support).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[ \t-\r]+", " ", t or "")].append(i)
    want = {sha(t): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert sorted(str((x["doc_id"], x["digest"].hex())) for x in got) == sorted(str((i, sha(t))) for t, ids in groups.items() for i in ids)
    assert all((x["keep_id"], x["group_size"]) == want[x["digest"].hex()] for x in got)
    kept = [(x["doc_id"], x["digest"].hex()) for x in got if x["kept"]]
    assert sorted(map(str, kept)) == sorted(str((w[0], d)) for d, w in want.items())  # one row of each group
    assert exact.exact_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_heavy_hitters_are_found(spark):
    rows = spark.range(20_000).select(F.sha2(F.when(F.col("id") % 3 == 0, F.lit("a")).when(F.col("id") % 50 == 1, F.lit("b")).otherwise(F.col("id").cast("string")), 256).alias("d"))
    found = exact.heavy_hitters(rows.select(F.unhex("d").alias("d")), "d", 0.01).collect()
    assert {sha("a"), sha("b")} <= {x["d"].hex() for x in found} and len(found) <= 100


@pytest.mark.parametrize("name", ["op11_marker_injection", "op12_merkle_supersteps", "op13_heavy_hitter_dedup"])
def test_queries(spark, name):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) >= 200


def test_the_key_is_not_listed(spark):
    from quern.llm import pii

    key = pii.session_key(spark)
    assert len(key) == 64 and pii.session_key(spark) == key
    assert not any(key in str(tuple(r)) for q in ("SET", "SET -v", "SET spark.quern.surrogate.secret") for r in spark.sql(q).collect())
