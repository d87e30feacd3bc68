"""The index of variants against a loop over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import url as U
from quern.operators import store, structure
from quern.operators.structure import variant_similarity
from quern.operators.variants import Variants
from quern.plans import lifecycle

TAGS = [f"t{i}" for i in range(60)]


def page(r, base=None):
    p = dict(base) if base else {
        "tag_counts": {t: r.randrange(1, 9) for t in r.sample(TAGS, r.randrange(0, 25))}, "content_regions": [{"name": x} for x in r.sample("abcdef", r.randrange(4))],
        "semantic_landmarks": {x: "s" for x in r.sample("mnopq", r.randrange(4))}, "pagination": r.choice([None, "a"]), "navigation_selectors": ["n"] * r.randrange(4)}
    if base and r.random() < 0.7:
        tags = dict(p["tag_counts"])
        for _ in range(r.randrange(5)):
            tags[r.choice(TAGS)] = r.randrange(1, 9)
        p["tag_counts"] = tags
    return p


def loop(pages, least):
    out, variants = [], []
    for p in pages:
        near, i = max(((variant_similarity(v, p), -k) for k, v in enumerate(variants)), default=(0.0, 0))
        if near < least:
            variants.append(p)
            i = -(len(variants) - 1)
        out.append(-i)
    return out


def indexed(pages, least):
    out, known = [], Variants(least, variant_similarity)
    for p in pages:
        _, i = known.best(p)
        if i is None:
            known.add(p)
        out.append(len(known.items) - 1 if i is None else i)
    return out, known


@pytest.mark.parametrize("seed, least", [(1, 0.85), (2, 0.85), (3, 0.95), (4, 0.75), (5, 0.6), (6, 1.0)])
def test_same_variants_as_the_loop(seed, least):
    r = random.Random(seed)
    bases = [page(r) for _ in range(25)]
    pages = [page(r, r.choice(bases)) for _ in range(500)] + [page(r) for _ in range(60)]
    assert indexed(pages, least)[0] == loop(pages, least)


def test_replaced_variants():
    r = random.Random(9)
    pages = [page(r) for _ in range(80)]
    known = Variants(0.85, variant_similarity)
    for p in pages[:40]:
        known.add(p)
    for i in range(0, 40, 3):
        known.replace(i, pages[40 + i])
    for p in pages + [page(r, q) for q in pages]:
        near, i = max((variant_similarity(v, p), -k) for k, v in enumerate(known.items))
        assert known.best(p) == ((near, -i) if near >= 0.85 else (0.0, None))


def test_a_large_key_is_linear():
    """A hundred thousand pages of one key, of a thousand shapes: what is compared grows with shapes and variants, not with pages."""
    r = random.Random(11)
    shapes = [page(r) for _ in range(1000)]
    pages = [r.choice(shapes) for _ in range(100_000)]
    half, known = indexed(pages[:50_000], 0.85)[1], indexed(pages, 0.85)[1]
    assert len(known.items) > 300 and known.compared <= 1.01 * half.compared and known.compared < 0.7 * 1000 * len(known.items)
    fresh = indexed([page(r) for _ in range(1500)], 0.85)[1]  # every page a shape of its own
    n = len(fresh.items)
    assert fresh.compared < 0.6 * n * n / 2


def test_totals(spark):
    """The totals of all pages against a loop over their structures, and of nothing."""
    sf, keys = "/root/testdata/sf0.001", {}
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html", U.domain("url").alias("d"), U.classify(F.col("url"), U.PAGE_TYPES, "general").alias("t"))
    for r in p.orderBy("page_id").collect():
        keys.setdefault((r["d"], r["t"]), []).append(structure.analyze(r["html"]))
    n = {k: len(set(loop(pages, 0.85))) for k, pages in keys.items()}
    got = lifecycle.variant_totals(spark, sf).first()
    assert tuple(got) == (sum(n.values()), len(n), sum(v > 1 for v in n.values()), len({d for (d, _), v in n.items() if v > 1}))
    rows = [("a", "x", "1"), ("a", "x", "2"), ("a", "x", "2"), ("a", "y", "1"), ("b", "x", "1"), ("a", "z", "1"), ("a", "z", "3")]  # the pages have one variant of each key
    assert tuple(store.variant_totals(spark.createDataFrame(rows, "domain string, page_type string, variant_id string")).first()) == (6, 4, 2, 1)
    assert [tuple(r) for r in store.variant_totals(spark.createDataFrame([], "domain string, page_type string, variant_id string")).collect()] == [(0, 0, 0, 0)]


def test_only_first_pages_of_a_shape_start_variants(spark, monkeypatch):
    """`started_variants` gives what `assign_variants` starts, and takes pages of one shape once, however many there are."""
    r = random.Random(5)
    names = {"header": "<header>h</header>", "main": "<main>m</main>", "nav": "<nav><a href=x>n</a></nav>", "table": "<table><tr><td>1</table>", "form": "<form></form>", "aside": "<aside>a</aside>", "p": "<p>a<p>b<p>c", "article": "<article>z</article>"}
    bodies = ["".join(names[k] for k in r.sample(sorted(names), r.randrange(1, 6))) for _ in range(30)]
    pages = spark.createDataFrame([(i, f"http://s{i % 3}.org/", f"<body>{bodies[(i * i) % 30]}</body>") for i in range(400)], "page_id long, url string, html string")
    rows = structure.structures(pages).join(pages.select("page_id", U.domain("url").alias("key")), "page_id").withColumn("fingerprint", structure.fingerprint()).withColumn("seq", F.col("page_id"))
    want = sorted(map(tuple, structure.assign_variants(rows).where("started").drop("started").collect()))
    seen, through = [], structure._assigned
    monkeypatch.setattr(structure, "_assigned", lambda first, least: seen.append(first.count()) or through(first, least))
    assert sorted(map(tuple, structure.started_variants(rows).collect())) == want and len(want) > 10
    assert seen[0] <= 90
