"""Each operator against brute force and its edge cases: nulls, empty and long texts, ties, repeats, empty tables, other columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, bwt, common, near, nndescent, packing, paragraphs, pii, substring, text, toxicity, unigram, warc

DOCS = "doc_id long, text string, h string, words string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS).repartition(3)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def collected(df, key):
    return {r[key]: r for r in df.collect()}


# --- components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    """Against union-find: rounds alone, rounds until few edges are left, and one task alone."""
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(1, 20)]
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    frame_ = spark.createDataFrame(edges, "a long, b long")
    got = {x["id"]: x["component"] for x in common.components(frame_, small=(0, 12, None)[seed]).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_lookup(spark, monkeypatch):
    """A hot key is joined apart from the others, with the same rows."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    rows = spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(200)], "i long, k long")
    table = spark.createDataFrame([(0, 101, "hot"), (2, 1, "a"), (4, 1, "b"), (999, 1, "none")], "k long, n long, v string")
    got = {r["i"]: r["v"] for r in common.lookup(rows, table, "k", share=4).collect()}
    assert got == {i: {0: "hot", 2: "a", 4: "b"}.get(0 if i % 2 else i) for i in range(200)}


# --- packing


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rows = [(1, prose(1, 5000)), (2, None), (3, ""), (4, "ein kurzer Text <|endoftext|> é 日本"), (4, "ein kurzer Text <|endoftext|> é 日本"), (None, "no id"), (5, "x" * 300_000)]
    rows += [(6, "<|endoftext|>"), (7, "a<|endoftext|>b <|endoftext|>"), (8, prose(2, 30_000) + "<|endoftext|>" + prose(3, 30_000) + "<|endoftext|>"), (9, "<|endoftext")]
    rows += [(10 + i, prose(i, 30 + i)) for i in range(60)]
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))  # as loaded, with default settings
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids) + (1,)) for i, x in rows)
    pieces = packing.pack(frame(spark, rows)).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        by_doc.setdefault(p["doc_id"], []).append((p["start"], ids, p["doc_tokens"]))
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["tier"]))
    for parts in by_seq.values():
        parts.sort()
        assert [o for o, _, _ in parts] == np.cumsum([0, *[n for _, n, _ in parts]])[:-1].tolist()
        total = sum(n for _, n, _ in parts)
        assert total == parts[0][2] <= 2048 and total & (total - 1) == 0  # no padding at all
    for (doc, ids), n in want.items():
        if n == 1:
            assert [x for _, part, _ in sorted(by_doc[doc]) for x in part] == list(ids)
            assert {x for *_, x in by_doc[doc]} == {len(ids)}
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    crc = packing.pack(frame(spark, rows)).select("ids", F.crc32("ids").alias("c")).first()
    assert crc["c"] == zlib.crc32(crc["ids"])
    assert packing.pack(frame(spark, [])).count() == 0


def test_added_tokens():
    """The ids of the tokenizer as loaded, with default settings."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.encoder()
    for x in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\ny", " <|endoftext", "<|EndOfText|> é 日本", "", prose(1, 300)):
        assert encode(x) == t.encode(x, add_special_tokens=False).ids, x
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_long_text_parts():
    encode, whole = packing.encoder(), prose(3, 60_000)
    assert len(whole) > packing.PART_CHARS
    core = encode(whole[: packing.PART_CHARS - 7])
    assert encode(whole)[: len(core) - 5] == core[:-5]


# --- suffix arrays


def windows(texts, least):
    count = Counter(t[j : j + least] for t in texts for j in range(len(t) - least + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for j in range(len(t) - least + 1):
            if count[t[j : j + least]] > 1:
                cover[j : j + least] = b"\1" * least
        kept = bytes(c for c, x in zip(t, cover) if not x)
        out.append((len(t), len(t) - len(kept), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_transform(seed):
    r = random.Random(seed)
    least, letters = r.choice([3, 5, 12]), (b"ab", b"abcdef")[seed % 2]
    base = bytes(r.choice(letters) for _ in range(60))
    bodies = [base[(i := r.randrange(30)) : i + least + r.randrange(25)] for _ in range(5)] + [bytes(r.choice(letters) for _ in range(40))]
    n = np.array([len(b) - least + 1 for b in bodies])
    weight = np.array([r.choice([1, 1, 2]) for _ in bodies])
    count = Counter()
    for b, k, w in zip(bodies, n, weight):
        for j in range(k):
            count[b[j : j + least]] += w
    assert bwt.repeated(bodies, n, weight, least).tolist() == [count[b[j : j + least]] > 1 for b, k in zip(bodies, n) for j in range(k)]


@pytest.mark.parametrize("most", [1024, 2])  # 2: nearly all groups take the way for hot anchors
def test_substring(spark, most):
    passage, other = prose(1, 300), prose(2, 150)
    rows = [(i, f"{prose(100 + i, 20)} {passage} {prose(200 + i, 40)}") for i in range(8)]
    rows += [(20 + i, f"{other} {prose(300 + i, 90)}") for i in range(3)] + [(40, "a" * 1500), (41, "é" * 350 + passage[:500]), (42, prose(9, 400)), (43, ""), (44, None), (45, "short")]
    rows += [(50, prose(11, 200)), (50, prose(11, 200)), (None, prose(12, 200)), (None, prose(12, 200)), (60, prose(13, 100) + passage[100:600] + prose(14, 100))]
    done = substring.remove_repeats(frame(spark, rows), most=most)
    got = Counter(tuple(r) for r in done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, windows([(t or "").encode() for _, t in rows], 400)))
    assert substring.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1024, 2])
def test_substring_passages(spark, most):
    """Passages of over 50 words but under 400 bytes are counted, not removed; what is removed is as without the count."""
    passage, other = prose(21, 75), prose(22, 300)
    assert 240 < len(passage) < 400 and len(passage.split()) > 50
    rows = [(i, f"{prose(400 + i, 30)} {passage} {prose(430 + i, 50)}") for i in range(7)] + [(10, passage), (11, prose(460, 60) + passage), (12, passage[:239]), (13, prose(461, 300))]
    rows += [(20 + i, f"{prose(470 + i, 20)} {other[200 * i :]}") for i in range(4)] + [(30, "b" * 300), (31, "é" * 210), (32, None), (33, ""), (34, other[:399]), (35, other[5:404]), (36, other[:400])]
    rows += [(40, prose(480, 55)), (40, prose(480, 55)), (None, prose(481, 200)), (None, prose(481, 200))]
    done = substring.remove_repeats(frame(spark, rows), floor=240, most=most)
    got = Counter(tuple(r) for r in done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256), "n_repeated").collect())
    texts = [(t or "").encode() for _, t in rows]
    both = zip(rows, windows(texts, 400), windows(texts, 240), strict=True)
    assert got == Counter((i, *w, short[1]) for (i, _), w, short in both)
    counted = {r["doc_id"]: r for r in done.collect()}
    assert all(counted[i]["n_removed"] == 0 and counted[i]["n_repeated"] >= len(passage) for i in [*range(7), 10, 11])


def test_substring_query_columns(spark, tmp_path):
    """The query's five columns of the contract come first, the count of repeated passages after them."""
    passage = prose(21, 75)
    frame(spark, [(1, f"{prose(1, 40)} {passage}"), (2, f"{passage} {prose(2, 40)}"), (3, prose(3, 90))]).write.parquet(f"{tmp_path}/documents.parquet")
    done = substring.op2_suffix_array(spark, str(tmp_path))
    assert done.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"]
    got = collected(done, "doc_id")
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 0, 0] and [got[i]["n_repeated"] >= len(passage) for i in (1, 2, 3)] == [True, True, False]


# --- near duplicates


def jaccard_classes(rows, width=5):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def edited(t, seed, n):
    w, r = t.split(), random.Random(seed)
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark):
    base = [prose(i, 200) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(base[i % 6], i, 1 + i % 4)) for i in range(40)] + [(200 + i, base[0].upper() + "  ") for i in range(30)] + [(300, None), (301, ""), (302, "one two"), (303, "One  TWO"), (304, "x")]
    rows += [(305, prose(50, 4000)), (306, edited(prose(50, 4000), 1, 20)), (305, prose(50, 4000))]
    classes = jaccard_classes(rows)
    got = {r["doc_id"]: r for r in near.near_duplicates(frame(spark, rows)).collect()}
    assert {i: got[i]["class_id"] for i, _ in rows} == {i: rows[c][0] for (i, _), c in zip(rows, classes)}
    assert got[0]["kept"] and not got[200]["kept"] and got[300]["kept"] and got[301]["kept"]
    assert near.near_duplicates(frame(spark, [])).count() == 0
    assert {(r["doc_id"], r["class_id"], r["kept"]) for r in near.near_duplicates(frame(spark, [(None, "a b"), (5, "a b")])).collect()} == {(None, 5, False), (5, 5, True)}


def test_near_duplicates_of_a_family(spark, monkeypatch):
    """Variants of a passage that is not there itself: most pairs that link hold no leader of a bucket."""
    monkeypatch.setattr(near, "BLOCK", 64)  # several blocks in a bucket
    base = prose(700, 100, 5000)
    rows = [(j, edited(base, j, 2 + j % 3)) for j in range(400)]
    classes = jaccard_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: rows[c][0] for (i, _), c in zip(rows, classes)}


def test_weighted_near_duplicates(spark):
    """With counts, texts that repeat their shingles differ from those that don't; against multisets, by brute force."""
    base = [prose(800 + i, 60, 5000) for i in range(8)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, f"{t} {t}") for i, t in enumerate(base[:4])] + [(200 + i, f"{t} {' '.join(t.split()[:9])}") for i, t in enumerate(base)]
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append(Counter(" ".join(w[j : j + 5]) for j in range(len(w) - 4)))
    similar = lambda a, b: sum((a & b).values()) / sum((a | b).values())
    want = {i: min(j for (j, _), b in zip(rows, sets) if similar(a, b) >= 0.8) for (i, _), a in zip(rows, sets)}
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(frame(spark, rows), counts=True).collect()}
    assert got == want and got[100] == 100 and got[200] == 0
    assert near.near_duplicates(frame(spark, rows)).where("doc_id = 100").first()["class_id"] == 0  # as sets they are alike


def test_pairs_at_the_threshold(spark):
    """Nine shingles of which eight are shared: 8 of 10 in all, a similarity of 0.8 exactly, is a link."""
    a = " ".join(f"w{i}" for i in range(13))
    b = " ".join([*(f"w{i}" for i in range(12)), "other"])
    assert jaccard_classes([(1, a), (2, b)]) == [0, 0]
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(frame(spark, [(1, a), (2, b)])).collect()}
    assert got == {1: 1, 2: 1}


def test_dart_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    item = text.mix(np.arange(400, dtype=np.uint64))
    wa, wb = r.choice([0.0, 0.5, 1.0, 3.0], 400), r.choice([0.0, 0.5, 1.0, 3.0], 400)
    wb[:250] = wa[:250]
    doc = np.concatenate([np.zeros(400, int), np.ones(400, int)])
    w = np.concatenate([wa, wb])
    keep = w > 0
    sig = near.signatures(doc[keep], np.concatenate([item, item])[keep], w[keep], 2, 2000)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05 and (sig > 0).all()


def test_shingles():
    doc, value = text.shingles([b"a b c d e f", b"", b"a b", b"a b c d e f a b c d e f"], 5)
    assert np.bincount(doc, minlength=4).tolist() == [2, 0, 1, 6]
    assert set(value[doc == 0]) <= set(value[doc == 3])


# --- paragraphs


def brute_units(t, reach=7):
    """Paragraphs as lists of words, by the definition in words: runs start where a word pair's hash is least nearby."""
    w = paragraphs.words(t or "")
    if not w:
        return []
    x = text.Words([" ".join(w).encode()])
    i = np.arange(len(w))
    v = (x.hashes(i, np.minimum(i + 1, len(w) - 1)) >> np.uint64(1)).tolist()
    start = [0, *(k for k in range(1, len(w)) if v[k] < min(v[max(0, k - reach) : k]) and v[k] <= min([*v[k + 1 : k + 1 + reach], 1 << 63]))]
    if len(start) > 1 and start[1] < 2 * (reach + 1):
        del start[1]
    if len(start) > 1 and len(w) - start[-1] < 2 * (reach + 1):
        del start[-1]
    return [(a, b - a, " ".join(w[a:b])) for a, b in zip(start, [*start[1:], len(w)])]


def test_paragraphs(spark):
    """Against all pairs of paragraphs: passages inside lines, edited ones, short texts, scripts without blanks."""
    passage, cjk = prose(70, 60), "今日は天気がいいので公園まで歩いて行きました"
    rows = [(i, f"{prose(100 + i, 40, 5000)} {passage if i % 2 else edited(passage, i, 1)}\n{prose(200 + i, 30, 5000)}") for i in range(30)]
    rows += [(40, "Read more"), (41, "read  MORE"), (42, None), (43, ""), (44, cjk), (45, cjk[:-1] + "よ"), (None, passage), (46, passage), (46, passage), (47, prose(8, 3000, 5000)), (48, f"{passage} {passage}"), (49, "\n")]
    units = sorted({(-(1 << 63) if i is None else i, p, n, u) for i, t in rows for p, n, u in brute_units(t)})
    kinds = sorted({u for *_, u in units})
    of = dict(zip(kinds, jaccard_classes(list(enumerate(kinds)))))
    first, many = {}, Counter(of[u] for i, t in rows for _, _, u in brute_units(t))
    for d, p, _, u in units:
        first.setdefault(of[u], (d, p))
    want = {}
    for i, t in rows:
        d = -(1 << 63) if i is None else i
        mine = [(p, n, of[u]) for p, n, u in brute_units(t) if many[of[u]] > 1]
        want[i] = (len(mine), sorted((p, n) for p, n, c in mine if first[c] != (d, p)), sorted({"%d:%d" % first[c] for *_, c in mine}))
    got = paragraphs.near_paragraphs(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_repeated"], [tuple(x) for x in r["removed"]], r["classes"]) for r in got} == want
    assert all(r["n_removed"] == len(r["removed"]) for r in got) and want[41] == (1, [(0, 2)], ["40:0"]) and want[45][1] and all(want[i][0] for i in range(30))
    kept = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(frame(spark, rows)).collect()}
    for i, t in rows:
        gone = {k for p, n in want[i][1] for k in range(p, p + n)}
        assert (kept[i] is None) == (t is None) and paragraphs.words(kept[i] or "") == [w for k, w in enumerate(paragraphs.words(t or "")) if k not in gone]
    assert paragraphs.near_paragraphs(frame(spark, [])).count() == 0 and paragraphs.without_repeats(frame(spark, [])).count() == 0
    bands, r = paragraphs.tune(0.8, 0.995)
    assert 1 - (1 - 0.8**r) ** bands >= 0.995


def test_passages_are_found_inside_lines(spark):
    """Passages of fifty words or more of the benchmark, put into other prose, are found wherever they stand."""
    rows = [(i, f"{prose(3000 + i, 25 + i % 9, 9000)} {prose(900 + i % 20, 52, 9000)} {prose(4000 + i, 35, 9000)}") for i in range(200)]
    rows += [(1000 + i, prose(5000 + i, 90, 9000)) for i in range(100)]
    got = {r["doc_id"]: r["n_repeated"] for r in paragraphs.near_paragraphs(frame(spark, rows)).collect()}
    assert np.mean([got[i] > 0 for i in range(200)]) >= 0.9 and not any(got[1000 + i] for i in range(100))


# --- toxicity


def labelled(n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, prose(i, 60) + (f" grobian{i % 7} " if bad else " ") + prose(i + 10_000, 20)))
        labels.append((i, int(i % 3 > 0), int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled(400)
    docs = frame(spark, [*rows, (1000, None), (1001, ""), (1002, "Grobian9 " + prose(5, 150)), (None, "x")])
    chain = toxicity.train(docs, spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert chain.f1 > 0.95 and chain.models[1].chain.shape == (1,)
    got = toxicity.score(docs, chain).collect()
    assert len(got) == 404
    by = {r["doc_id"]: r["rejected"] for r in got}
    assert sum(by[i] == (t == 1) for i, _, t in labels) >= 396 and by[1002] and not by[1001] and not by[1000]
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not any(r["rejected"] for r in toxicity.score(docs, none).collect())
    assert toxicity.score(frame(spark, []), chain).count() == 0


def test_toxicity_on_held_out_labels(spark):
    """Trained on the labels of half of the documents, the chain finds the toxic ones among the others."""
    rows, labels = labelled(800)
    chain = toxicity.train(frame(spark, rows), spark.createDataFrame([x for x in labels if x[0] % 8 < 4], "doc_id long, quality int, toxic int"))
    by = {r["doc_id"]: r["rejected"] for r in toxicity.score(frame(spark, rows), chain).collect()}
    held = [(by[i], t == 1) for i, _, t in labels if i % 8 >= 4]
    assert len(held) == 400 and sum(t for _, t in held) == 100 and sum(a == b for a, b in held) >= 390


def test_threshold_stands_for_all_labels():
    """The threshold has the best F1 over all labelled rows, of which the sample holds a tenth of the clean ones."""
    r = random.Random(3)
    y = np.array([i % 3 == 0 for i in range(600)]).astype(int)
    texts = [" ".join([prose(i, 12, 80), *(f"grobian{r.randrange(5)}" for _ in range(r.random() < (0.7 if bad else 0.15)))]).encode() for i, bad in enumerate(y)]
    label = np.column_stack([np.arange(600) % 2, y])
    even, ten = (toxicity.fit(texts, label, ("low", "toxic"), share=s) for s in ((1.0, 1.0), (10.0, 1.0)))
    assert ten.threshold > even.threshold and ten.f1 < even.f1


# --- personal data


def test_permutation():
    import itertools

    key = b"k" * 32
    for sizes in ([7], [5, 3], [5, 3, 4]):
        every = list(itertools.product(*map(range, sizes)))
        new = {v: tuple(pii.permute(key, "t", sizes, list(v))) for v in every}
        assert len(set(new.values())) == len(every) and all(a != b for a, b in new.items())


def test_names_are_a_bijection():
    """All words of listed names' patterns, listed ones among them, get different names of their own kind."""
    import itertools

    key = b"k" * 32
    for name in ("Lisa", "Juan"):
        letters = [pii.ALPHABETS[pii._CLASS[c][0]] for c in name.lower()]
        words = ["".join(w).capitalize() for w in itertools.product(*letters)]
        new = {w: pii._name(key, w) for w in words}
        others = [w for w in words if w not in pii._FIRST]
        assert name in words and len({new[w] for w in others}) == len(others) and not any(new[w] in pii._FIRST for w in others)
    ends = [a + b + e for x, y, z in (("BDG", "aeiou", ("rska", "rová")), ("БВГ", "аеиоу", ("рова", "рина"))) for a in x for b in y for e in z]
    assert all(pii._name(key, w)[-3:] == w[-3:] for w in ends) and len({pii._name(key, w) for w in ends}) == len(ends)


def test_surrogates(spark):
    text_ = "Mr. John Smith, BOB.x@Mail.com bob.x@mail.com, +1 (988) 555-2485 or 988-555-2485, 4111 1111 1111 1111, 10.1.2.3, 123-45-6789, DE89370400440532013000. Анна Петрова"
    docs = frame(spark, [(1, text_), (2, text_), (2, text_), (3, None), (4, ""), (None, "a@b.com"), (5, prose(1, 5000))])
    rows = pii.surrogates(docs, key="one").collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 7 and got[1]["text"] == got[2]["text"] and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == prose(1, 5000)
    new = {text_[s["start"] : s["stop"]]: (s["kind"], got[1]["text"][s["new_start"] : s["new_stop"]]) for s in got[1]["spans"]}
    assert [k for k, _ in new.values()] == ["name", "email", "email", "phone", "phone", "card", "ip", "ssn", "iban", "name"]
    assert all(old != v for old, (_, v) in new.items())
    assert new["BOB.x@Mail.com"][1].lower() == new["bob.x@mail.com"][1] and new["bob.x@mail.com"][1].endswith(".com")
    assert new["+1 (988) 555-2485"][1][-14:-10][1:4] == new["988-555-2485"][1][:3]
    assert pii.luhn(re.sub(r"\D", "", new["4111 1111 1111 1111"][1])) and new["10.1.2.3"][1].startswith("10.")
    assert pii._iban_ok(new["DE89370400440532013000"][1]) and new["Mr. John Smith"][1].split()[1] in pii.GIVEN["latin", "m"]
    assert new["Анна Петрова"][1].split()[0] in pii.GIVEN["cyrillic", "f"] and new["Анна Петрова"][1].endswith("ова")
    assert pii.surrogates(docs, key="other").where("doc_id = 1").first()["text"] != got[1]["text"]
    many = frame(spark, [(i, f"u{i}@h{i % 7}.org {4000000000000000 + i} +1 (200) 555-{i:04d} 1.2.3.{i % 250}") for i in range(2000)])
    assert pii.collisions(many, key="one").count() == 0
    assert pii.surrogates(frame(spark, []), key="one").count() == 0 and pii.collisions(frame(spark, [(1, None)]), key="one").count() == 0
    assert pii.collisions(frame(spark, [(i, f"Mr {n} Smith") for i, n in enumerate(pii._FIRST)]), key="quern").count() == 0  # none keeps itself


def test_names_by_phrases_and_again(spark):
    """Names after phrases, and family names that stand alone later, get what they got before."""
    text_ = "my name is Greta Vogel. Dear Quentin, ask Vogel or Frau Vogel. Ich heiße Tamsin Ashgrove; Ashgrove said so. The Vogels weren't asked."
    row = pii.surrogates(frame(spark, [(1, text_)]), key="one").first()
    was = [text_[s["start"] : s["stop"]] for s in row["spans"]]
    new = [row["text"][s["new_start"] : s["new_stop"]] for s in row["spans"]]
    assert was == ["Greta Vogel", "Quentin", "Vogel", "Frau Vogel", "Tamsin Ashgrove", "Ashgrove"]
    assert new[0].split()[1] == new[2] == new[3].split()[1] != "Vogel" and new[4].split()[1] == new[5] and new[1] != "Quentin"
    assert row["text"].endswith("The Vogels weren't asked.")
    key = pii.session_key(spark)
    assert len(key) == 64 and pii.session_key(spark) == key


# --- revisits


def test_revisits(spark):
    rows = [
        (1, "http://www.a.com:80/x?b=1&a=2#f", 10, "response", {"etag": "e1", "date": "1", "content-length": "9"}), (2, "https://A.com/x/?a=2&b=1", 20, "revisit", {"etag": "e1", "date": "2", "content-length": "0"}),
        (3, "http://a.com/x?a=2&b=1", 30, "response", {"etag": "e2"}), (4, "http://a.com/x?a=2&b=1", 30, "revisit", {"etag": "e1"}), (5, "http://a.com/x?a=2&b=1", 40, "revisit", {"etag": "e1"}),
        (6, "http://b.com/", 5, "revisit", None), (7, None, 5, "revisit", None), (8, "http://a.com/x?a=2&b=1", None, "response", {"etag": "e1"}), (9, "http://c.com", 1, "response", {"last-modified": "m"}),
        (10, "http://c.com", 1, "response", {"last-modified": "m"}), (11, "http://c.com/", 2, "revisit", {"last-modified": "m"}), (12, "http://c.com/", 3, "request", None), (13, "http://c.com", None, "revisit", None),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>")
    for slices in (1, 3, 64):
        got = {r["record_id"]: r for r in warc.resolve(records, slices=slices).collect()}
        assert {i: (r["status"], r["refers_to"]) for i, r in got.items()} == {
            2: ("resolved", 1), 4: ("resolved", 1), 5: ("mismatch", None), 6: ("no_response", None), 7: ("no_response", None), 11: ("resolved", 10), 13: ("no_response", None)}
        assert got[2]["headers"] == {"etag": "e1", "date": "2", "content-length": "9"}
    assert warc.resolve(records.limit(0)).count() == 0


def test_revisit_query(spark):
    """The query's rows against its SQL, with pages that share a canonical address."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    rows = warc.op8_revisits(spark, "/root/testdata/sf0.01")
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({warc.OP8_SQL})").fetchall()
    got = [tuple(r) for r in rows.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r[3] for r in got} >= {"resolved", "mismatch"}


# --- encoding


def brute(model, word):
    best = [(0.0, [])] + [None] * len(word)
    for e in range(1, len(word) + 1):
        options = [(best[s][0] + model.score[word[s:e]], best[s][1] + [word[s:e]]) for s in range(e) if word[s:e] in model.score]
        if word[e - 1] not in model.score:
            options.append((best[e - 1][0] + model.unknown_score, best[e - 1][1] + [word[e - 1]]))
        top = max(o[0] for o in options)
        best[e] = next(o for o in options if o[0] == top)  # the earliest start, so the longest last piece
    return best[-1]


def test_viterbi(spark):
    m = unigram.Model.load()
    words = sorted({w for i in range(20) for w in m.words(" ".join(random.Random(i).choice(["thering", "ationed", "été", "straße", "日本", "x1", "ing", "theringation"]) + str(i) for _ in range(9)))})
    for word, ids in m.encode_words(words):
        score, pieces = brute(m, word)
        want = [i for p in pieces for i in ([m.id_of[p]] if p in m.score else [m.byte_id[b] for b in p.encode()])]
        assert ids == want
    rows = [(1, "The weather is fine  today.\n\tYes 😀"), (2, None), (3, ""), (4, " lead"), (4, " lead"), (5, prose(1, 20_000)), (6, "x" * 5000), (None, "q")]
    got = unigram.encode(frame(spark, rows))
    assert all(r["same"] is (None if r["doc_id"] == 2 else True) for r in got.collect())
    back = {r["doc_id"]: r["text"] for r in unigram.decode(got).collect()}
    assert back == dict(rows)
    assert unigram.encode(frame(spark, [])).count() == 0 and unigram.decode(got.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [-1, 10**9, None]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in unigram.decode(odd).collect()} == {1: "\ufffd" * 3, 2: "", 3: None}


# --- vectors


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, v int").repartition(3)


def clustered(seed, n, d=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[: n // 3] = x[0] + 0.05 * r.normal(size=(n // 3, d))
    x[n // 3 : n // 3 + 20] = x[n // 3]
    return x.astype(np.float32).astype(float)


BAD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (9005, [1.0, None] * 8), (9006, []), (9007, [1.0])]


def linked(x):
    """Links and least-id components of the rows of x, by brute force."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    comp = list(range(len(x)))
    while (new := [min(comp[j] for j in np.flatnonzero(link[i])) for i in range(len(x))]) != comp:
        comp = new
    return link.sum(axis=1) - 1, comp


def arcs(seed, n, d=16):
    """Vectors along an arc, in which each links with its surroundings and the ends are far apart, and a tight bunch beside it."""
    r = np.random.default_rng(seed)
    axes = np.linalg.qr(r.normal(size=(d, 3)))[0].T
    t = np.linspace(0, 2.4, n)
    x = np.cos(t)[:, None] * axes[0] + np.sin(t)[:, None] * axes[1] + 0.02 * r.normal(size=(n, d))
    bunch = np.cos(1.0) * axes[0] + np.sin(1.0) * axes[1] + 0.28 * axes[2] + 0.01 * r.normal(size=(40, d))
    return np.concatenate([x, bunch])


@pytest.mark.parametrize("case", ["cluster", "arc"])
def test_nn_descent(spark, monkeypatch, case):
    monkeypatch.setattr(nndescent, "CLUSTER", 16)
    monkeypatch.setattr(nndescent, "GROUP", 2)
    x = (clustered(1, 300) if case == "cluster" else arcs(1, 200)).astype(np.float32).astype(float)
    links, comp = linked(x)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in nndescent.near_vectors(vectors(spark, [*rows, *BAD]), rounds=1).collect()}
    assert len(got) == len(rows) + len(BAD)
    assert {i: (got[i * 3]["n_links"], got[i * 3]["component_id"]) for i in range(len(x))} == {i: (int(links[i]), comp[i] * 3) for i in range(len(x))}
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in BAD)


def test_nn_descent_cases(spark, monkeypatch):
    assert nndescent.near_vectors(vectors(spark, [])).count() == 0
    one = nndescent.near_vectors(vectors(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0])]), rounds=1).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in one) == [(0, 0), (1, 1), (2, 1), (2, 1)]
    # An id with several vectors joins their components; a pair at the threshold exactly (19, 0 and 19 * 0.95, ...) is linked.
    some = nndescent.near_vectors(vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]), rounds=1)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in some.collect()} == {(1, 1, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4)}
    monkeypatch.setattr(nndescent, "_linked", lambda rows, *_: (rows.select("u", F.lit(0).alias("far")), rows.select(F.col("u").alias("id"), F.col("u").alias("component"))))
    with pytest.raises(RuntimeError, match="audit"):
        nndescent.near_vectors(vectors(spark, [(i, [1.0, 0.001 * i]) for i in range(9)]), rounds=1, attempts=1)


def rare_pairs(r, x, n, c):
    """Rows of x, and others at the cosine c from the first n of them."""
    a = x[:n] / np.linalg.norm(x[:n], axis=1, keepdims=True)
    z = r.normal(size=a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    return np.concatenate([x, c * a + np.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=1, keepdims=True)])


@pytest.mark.parametrize("case", ["rare", "cone", "bunches"])
def test_nn_descent_audit(spark, monkeypatch, caplog, case):
    """Few links among many vectors, few in a narrow cone with crowded buckets, and 50 clusters in one cone: what the audit says
    holds to 0.01, and it has linked vertices to go by."""
    monkeypatch.setattr(nndescent, "BLOCK", 64)
    r = np.random.default_rng(1)
    one = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(r.normal(size=(n, 48)))
    if case == "rare":
        x = rare_pairs(r, one(1500), 60, 0.953)
    elif case == "cone":
        x = rare_pairs(r, one(1) + 0.6 * one(1200), 60, 0.953)
    else:
        x = np.concatenate([c + 0.1 * one(12) for c in one(1) + 0.6 * one(50)])
    x = x.astype(np.float32).astype(float)
    links, _ = linked(x)
    assert (links > 0).sum() >= 120
    with caplog.at_level("INFO", logger="quern"):
        got = {r["vec_id"]: r["n_links"] for r in nndescent.near_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    said, over = re.search(r"recall ([0-9.]+) over (\d+) linked", caplog.messages[-1]).groups()
    share = np.mean([got[i] / links[i] for i in range(len(x)) if links[i]])
    assert all(got[i] <= links[i] for i in range(len(x))) and abs(share - float(said)) <= 0.01 and float(said) >= 0.98 and int(over) >= 50


def test_nn_descent_unmeasured(spark, caplog):
    """Without any link the audit says that it measured nothing."""
    with caplog.at_level("INFO", logger="quern"):
        got = nndescent.near_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(np.eye(40))])).collect()
    assert all(r["n_links"] == 0 and r["kept"] for r in got) and "unmeasured over 0" in caplog.messages[-1]


@pytest.mark.parametrize("size", [8, 64])
def test_cluster_blocks(spark, monkeypatch, size):
    """Enlarged lists with blocks and groups so small that every kind of pair occurs, and two clusters that links join."""
    monkeypatch.setattr(nndescent, "CLUSTER", size)
    monkeypatch.setattr(nndescent, "GROUP", 2)
    x = np.concatenate([clustered(4, 120)[:60], arcs(2, 60), -clustered(4, 120)[:20]])
    n = np.array([1 + i % 2 for i in range(len(x))])
    c = np.array([1 + (i >= 90) + (i >= 160) for i in range(len(x))])
    members = spark.createDataFrame([(int(c[i]), i, int(n[i]), v.tolist()) for i, v in enumerate(x)], "c long, u long, n long, v array<double>")
    between = spark.createDataFrame([(1, 2), (1, 3)], "c long, c2 long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    met = np.isin(c[:, None] * 10 + c[None, :], [11, 22, 33, 12, 21, 13, 31])
    links, merged = nndescent.enlarge(members, between, 0.95)
    got = {r["u"]: r["links"] for r in links.collect()}
    assert [got[i] for i in range(len(x))] == (((u @ u.T >= 0.95) & met) @ n - 1).tolist()
    joined = {(int(c[i]), int(c[j])) for i, j in zip(*np.nonzero((u @ u.T >= 0.95) & met)) if c[i] < c[j]}
    assert {(r["a"], r["b"]) for r in merged.collect()} == joined and (1, 2) in joined


def test_search(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 64)
    monkeypatch.setattr(ann, "DEAL", 16)
    x = clustered(2, 900)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.search(vectors(spark, [*rows, *BAD, (0, x[0].tolist())]), sample=500, parts=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    recall = []
    for q in range(0, 900, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(900), -np.round(s, 9))) if i != q][:20]
        assert len(got[q]) == 20 and q not in dict(got[q])
        assert all(abs(v - s[i]) < 1e-9 for i, v in got[q]) and got[q] == sorted(got[q], key=lambda z: (-z[1], z[0]))
        recall.append(len({i for i, _ in got[q]} & set(order)) / 20)
    assert np.mean(recall) >= 0.9
    seen = ann.search(vectors(spark, rows), sample=500, parts=6).groupBy("query_id").agg(F.max("probes").alias("p"), F.max("parts").alias("n"), F.min("recall").alias("r")).collect()
    assert all(1 <= r["p"] <= r["n"] <= 6 and r["r"] >= 0.9 for r in seen)
    few = ann.search(vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (7, [0.5, 0.0])])).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 1, 1.0), (0, 2, 7, 0.5)]
    assert ann.search(vectors(spark, [])).count() == 0


def bunches(seed, n, groups=24, d=16):
    r = np.random.default_rng(seed)
    return r.normal(size=(groups, d))[r.integers(groups, size=n)] + 0.25 * r.normal(size=(n, d))


@pytest.mark.parametrize("leaf", [10**9, 300])
def test_search_skips_parts(spark, monkeypatch, leaf):
    """On clustered vectors queries go to a few parts, of one level and of two, at a recall of 0.9 against brute force."""
    monkeypatch.setattr(ann, "LEAF", leaf)
    x = bunches(5, 3000)
    found = ann.search(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), sample=1500, parts=8).collect()
    probes = {r["query_id"]: r["probes"] for r in found}
    parts = found[0]["parts"]
    assert np.mean(list(probes.values())) < 0.6 * parts and (parts > 8 or leaf > 3000)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = []
    for q in range(0, 3000, 20):
        s = x.astype(np.float32).astype(float) @ x[q].astype(np.float32)
        s[q] = -np.inf
        hit.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hit) >= 0.9


def test_search_widens(spark, monkeypatch):
    """Queries that go to one part only, of vectors without clusters: the audit finds it out, and more parts are searched."""
    fit = ann.fit

    def narrow(*a, **k):
        router = fit(*a, **k)
        router.mass = 0.0
        return router

    monkeypatch.setattr(ann, "fit", narrow)
    x = np.random.default_rng(6).normal(size=(400, 16))
    found = ann.search(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), parts=8).collect()
    assert min(r["recall"] for r in found) >= 0.9 and np.mean([r["probes"] for r in found]) > 1.5


def test_balanced_parts():
    x = clustered(3, 600)
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 8), 6)
    assert np.bincount(part, minlength=6).max() <= np.ceil(1.05 * 100)
