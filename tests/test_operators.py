import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.functions import dom, schedule as S, text as T
from quern.operators import compliance, dedup, extract, frontier, limits, pii, structure
from quern.sources import sitemap
from quern.sources.sinks import Options


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def simhash(text):
    words = text.split()
    parts = words if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    votes = [0] * 64
    for p in parts:
        h = int(hashlib.md5(p.encode()).hexdigest()[16:], 16)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    out = sum(1 << b for b in range(64) if votes[b] > 0) if parts else 0
    return out - (1 << 64) if out >> 63 else out


@pytest.mark.parametrize("text", ["", "one", "two words", "a b c d e f g", "é ü ö x y z " * 5])
def test_simhash(spark, text):
    row = dedup.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["simhash"] == simhash(text)


def test_simhash_in_pieces(monkeypatch):
    """A long text's votes are added piece by piece: no piece holds more shingles than allowed."""
    text, sizes, whole = " ".join(f"w{i % 97}" for i in range(1000)), [], T.np.unpackbits
    monkeypatch.setattr(T, "AT_ONCE", 64)
    monkeypatch.setattr(T.np, "unpackbits", lambda a, axis: sizes.append(len(a)) or whole(a, axis=axis))
    assert list(T._votes(T.pd.Series([text, "", "a b", text]), 3)) == [simhash(text), 0, simhash("a b"), simhash(text)]
    assert max(sizes) == 64


def test_normalized_text(spark):
    t = spark.createDataFrame([("<b>A</b> - b",), (None,), ("<p>one</p><p>two</p>",)], "t string").select(T.normalize(F.col("t")))
    assert [r[0] for r in t.collect()] == ["a  b", "", "one two"]


def test_hamming_pairs_are_all(spark):
    hashes = [0, 1, 3, 0xFF, 1 << 63, -1, -2, 0x3FF, 0x7FF]
    hashes = [h - (1 << 64) if h >= 1 << 63 else h for h in hashes]
    df = spark.createDataFrame([(h,) for h in hashes], "simhash long")
    want = {(a, b) for a in hashes for b in hashes if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 9}
    for spare in (None, 1, 2, 3):
        assert {(r["a"], r["b"]) for r in dedup.hamming_pairs(df, 9, spare).collect()} == want


def test_hamming_pairs_are_not_broadcast(spark):
    """The exploded rows are many times what the optimizer takes them for; each pair comes once."""
    df = spark.range(300).select((F.col("id") * 3).alias("simhash"))
    pairs = dedup.hamming_pairs(df, 9, 3)
    assert "Broadcast" not in pairs._jdf.queryExecution().toString()
    near = sum(bin(3 * i ^ 3 * j).count("1") <= 9 for i in range(300) for j in range(i))
    assert pairs.count() == pairs.distinct().count() == near
    few = spark.createDataFrame([(0,), (7,), (7,), (None,)], "simhash long")
    want = {(3 * i, b, bin(3 * i ^ b).count("1")) for i in range(300) for b in (0, 7) if bin(3 * i ^ b).count("1") <= 2}
    for small in (dedup.SMALL, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(dedup, "SMALL", small)
            assert sorted(tuple(r) for r in dedup.hamming_pairs(df, 2, others=few).collect()) == sorted(want)


def test_hamming_tables_grow_with_the_corpus():
    assert [dedup.spare_blocks(9, n) for n in (1_000, 1_000_000, 10**9)] == [1, 3, 3] or dedup.spare_blocks(9, 1_000) < dedup.spare_blocks(9, 10**9)
    masks = dedup.block_masks(9, 2)
    assert len(masks) == len(set(masks)) == 55 and all(bin(m & (1 << 64) - 1).count("1") in range(10, 14) for m in masks)


def test_similarities(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    got = values(
        spark, T.multiset_overlap(m(p=2, a=1), m(p=1, b=1)), T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), T.jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))),
        T.hamming_similarity(F.lit(0).cast("long"), F.lit(7).cast("long")))
    assert got == [0.25, 0.0, 0.5, 1 - 3 / 64]


ROBOTS = "User-agent: *\nDisallow: /a\nAllow: /a/b # more\nDisallow:\n\nUser-agent: bot\nDisallow: /*.pdf$\nCrawl-delay: 2\nSitemap: http://h/s.xml"


@pytest.mark.parametrize("agent, path, want", [
    ("x", "/a/c", False), ("x", "/a/b", True), ("x", "/z", True), ("botlet", "/x.pdf", False), ("botlet", "/x.pdf?", True), ("botlet", "/a", True),
])
def test_robots(spark, agent, path, want):
    parsed = compliance.robots(spark.createDataFrame([("h", ROBOTS, 200)], "domain string, content string, status int"))
    urls = spark.createDataFrame([(1, "h", path)], "key long, domain string, path string")
    assert compliance.allowed(urls, compliance.agent_rules(parsed, agent)).first()["allowed"] is want


def test_robots_status():
    assert compliance.parse_robots("Disallow: /", 404)[0] == []
    assert compliance.parse_robots("", 403)[0][0]["pattern"] == "/"
    assert compliance.parse_robots(ROBOTS)[1] == ["http://h/s.xml"]


def test_javascript(spark):
    reason = lambda h: spark.createDataFrame([(h,)], "h string").select(compliance.needs_scripts(F.col("h"))).first()[0]
    assert reason('<div id="root"></div>') == "framework"
    assert reason("<body></body>") == "minimal"
    assert reason("<script></script>" * 5 + "x") == "script_heavy"
    assert reason("<noscript>Please enable JavaScript</noscript>" + "x" * 600) == "noscript"
    assert reason("<p>text</p>") is None


def test_delay_and_priority(spark):
    p = frontier.discovered_priority(F.lit("http://h/news/1"), F.lit(2), [])
    assert values(spark, F.round(p, 6)) == [0.567]


@pytest.mark.parametrize("cron, at, want", [
    ("0 9 * * 1-5", "2024-01-01 09:00", False), ("0 9 * * 0-4", "2024-01-01 09:00", True), ("*/20 * * * *", "2024-01-01 09:40", True), ("1,3 * * * *", "2024-01-01 00:03", True),
    ("1-3,5 * * * *", "2024-01-01 00:05", True), ("x * * * *", "2024-01-01 00:05", False), ("* * *", "2024-01-01 00:05", False),
])
def test_cron(spark, cron, at, want):
    assert values(spark, S.matches(F.lit(cron), F.lit(at).cast("timestamp"))) == [want]


def test_next_run(spark):
    rows = spark.createDataFrame([("a", "30 6 * * *", datetime(2024, 1, 1, 6, 30)), ("b", "0 0 30 2 *", datetime(2024, 1, 1))], "target string, cron string, after timestamp")
    got = {r["target"]: r["next_run"] for r in S.next_run(rows).collect()}
    assert got == {"a": datetime(2024, 1, 2, 6, 30), "b": datetime(2024, 1, 2)}


def test_next_runs_by_search(spark):
    """Against a search minute by minute; fields are read once a row, not once a day."""
    crons = ["* * * * *", "*/7 3-5 * * *", "0 0 31 * *", "5,50 23 29 2 *", "0 12 13 * 4", "59 23 1,15 */5 6", "0 0 * * 7", "30 6", "x * * * *", " 0  0 1 1 * ", "*/0 * * * *"]
    starts = [datetime(2023, 12, 31, 23, 59, 30), datetime(2024, 2, 29, 23, 49), datetime(2024, 5, 13, 12, 0)]
    rows = spark.createDataFrame([(f"{i}-{j}", c, a) for i, c in enumerate(crons) for j, a in enumerate(starts)], "target string, cron string, after timestamp")

    def fits(p, v):
        if p == "*":
            return True
        if p.startswith("*/"):
            return int(p[2:]) > 0 and v % int(p[2:]) == 0
        low, _, high = p.partition("-")
        return str(v) in p.split(",") if not high else int(low) <= v <= int(high)

    def search(cron, after):
        p, at = cron.split(), after.replace(second=0) + timedelta(minutes=1)
        for i in range(367 * (len(p) == 5)):
            day = at.replace(hour=0, minute=0) + timedelta(days=i)
            if fits(p[2], day.day) and fits(p[3], day.month) and fits(p[4], day.weekday()):
                for m in range(1440):
                    t = day + timedelta(minutes=m)
                    if t >= at and fits(p[1], t.hour) and fits(p[0], t.minute):
                        return t
        return after + timedelta(days=1)

    out = S.next_run(rows)
    assert {r["target"]: r["next_run"] for r in out.collect()} == {f"{i}-{j}": search(c, a) for i, c in enumerate(crons) for j, a in enumerate(starts)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("sequence") < 20


PAGE = """<html><head><title>A page</title><meta property="og:published_time" content="2024-01-15T10:00:00Z"></head><body><header><nav class="menu"><a href="/a">A</a></nav></header>
<article class="post"><h1 class="title">The long title</h1><div class="author">Jo</div><p>one sentence that is long enough to count as the content of a page of this kind, and then some words more<p>two <b>bold</p><ul><li>x<li>y</ul><img src="i.png"><a href="http://o.org/z" rel="nofollow">z</a></article>
<script>var a = "</p>";</script></body></html>"""


def test_references_need_semicolons():
    """As libxml2 reads them, and the SQL of the page queries."""
    root = dom.parse("<h1 title='a&amp;b&ampc'>x &amp; y&amp</h1><a href='/?a=1&copy=2'>&ampfoo; &copy &#65; &nope;</a><script>a&amp&amp;b</script>")
    assert dom.select(root, "h1")[0].text() == "x & y&amp" and dom.select(root, "h1")[0].attrs["title"] == "a&b&ampc"
    assert dom.select(root, "a")[0].attrs["href"] == "/?a=1&copy=2" and dom.select(root, "a")[0].text() == "&ampfoo; &copy A &nope;"
    assert dom.select(root, "script")[0].text(raw=True) == "a&amp&amp;b"
    assert dom.parse("\ue000&lt").text() == "\ue000&lt"


def test_counts_have_the_words_of_sql(spark):
    """Letters beyond ASCII end a word, and a vertical tab is no white space, as in the query's SQL."""
    import duckdb

    from quern.plans import pages

    texts = ["7794 eine st\u00df illp", "\u00e912345678", "\u00fca@b.org\u00e9 x@y.com", "born\x0b1/2/2000 dob 3/4/2001\u00e4", "12 Main\x0bStreet 12 Main Street", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(pages.ORACLE_SQL["pii_counts"]).fetchall()
    assert sorted(tuple(r) for r in pii.counts(df, kinds=pages.SIMPLE).collect()) == sorted(want)


def test_batches_are_handed_on_in_pieces(monkeypatch):
    """What a task makes of a long batch is not held as a whole."""

    class Frame:
        select = lambda self, *columns: self
        mapInPandas = lambda self, run, schema: run

    batch = T.pd.DataFrame({"page_id": range(600), "html": ["<body><p>x</p></body>"] * 600, "doc_id": range(600), "text": ["a@b.org"] * 600})
    for run in (structure.structures(Frame()), pii.matches(Frame()), pii.processed(Frame(), "redact")):
        sizes = [len(b) for b in run(iter([batch, batch[:0]]))]
        assert sum(sizes) == 600 and max(sizes) <= 256


def test_dom_repair():
    root = dom.parse(PAGE)
    assert [len(dom.select(root, s)) for s in ("p", "li", "article p", "article > h1", "h1.title", "[rel='nofollow']", "div, header", "nav a", "#none")] == [2, 2, 2, 1, 1, 1, 2, 1, 0]
    assert dom.select(root, "li")[0].text() == "x"


def test_structure(spark):
    s = structure.analyze(PAGE)
    assert s["tag_counts"]["p"] == 2 and s["parent_child_pairs"]["article>p"] == 2 and s["semantic_landmarks"]["nav"] == "nav.menu"
    assert s["content_regions"][0] == {"name": "article", "primary_selector": "article", "fallback_selectors": ["main", ".content", "#content"], "confidence": 0.9} and s["pagination"] is None
    pages = spark.createDataFrame([(1, PAGE), (2, PAGE), (3, "<body><div>x</div></body>"), (4, None)], "page_id long, html string")
    rows = structure.structures(pages)
    pairs = rows.where("page_id = 1").select(F.struct(*rows.columns).alias("old")).join(rows.select(F.struct(*rows.columns).alias("new")))
    got = {r["new"]["page_id"]: (r["similarity"], r["change_class"]) for r in structure.changes(pairs).collect()}
    assert got[1] == got[2] == (pytest.approx(1.0), "cosmetic") and got[3][1] == "breaking"
    seq = rows.withColumn("key", F.lit("k")).withColumn("seq", F.col("page_id")).withColumn("fingerprint", structure.fingerprint())
    started = {r["page_id"]: r["started"] for r in structure.assign_variants(seq).collect()}
    assert started[1] and not started[2] and started[3]


def test_pagination():
    html = '<body><div class="pagination"><a href="?page=1">1</a><a href="?page=2">Next</a></div></body>'
    assert structure.analyze(html)["pagination"] == {"next_selector": "a", "prev_selector": None, "pattern": "?page={n}"}


def test_extract():
    got = extract.extract(PAGE, "http://h/x/")
    assert got["success"] and got["title"] == "The long title" and got["author"] == "Jo" and got["date"] == "2024-01-15T10:00:00+00:00"
    assert got["images"] == ["http://h/x/i.png"]
    assert extract.extract("<p", "http://h/")["success"] is False
    found = extract.links(PAGE, "http://h/x/")
    assert [(x["url"], x["is_external"], x["nofollow"]) for x in found[:2]] == [("http://h/a", False, False), ("http://o.org/z", True, True)]
    strategy = extract.infer(PAGE)
    assert strategy["title"] == ("h1.title", 0.9)
    assert extract.adapt(strategy, PAGE)["title"] == ("h1.title", pytest.approx(0.855))
    assert extract.valid_fields({"title": ("h1", 1.0), "x": (".none", 1.0)}, PAGE) == {"title": True, "x": False}


@pytest.mark.parametrize("text, want", [("1700000000", "2023-11-14T22:13:20+00:00"), ("2024-02-30", None), ("", None), ("May 3, 2021", "2021-05-03T00:00:00+00:00")])
def test_dates(text, want):
    assert extract.parse_date(text) == want


@pytest.mark.parametrize("text, kinds", [
    ("mail a@b.com", ["email"]), ("ssn 000-12-3456", []), ("ssn 123-45-6789", ["ssn"]), ("card 4111 1111 1111 1111", ["credit_card"]), ("4111 1111 1111 1112", []),
    ("ip 1.2.3.400", []), ("version 1.2.3.4", []), ("born: 1/2/1990", ["date_of_birth"]), ("12 Long Hill Street", ["address"]), ("passport no: A1234567", ["passport"]),
    ("driver license A12345", ["driver_license"]), ("national id: AB123456", ["national_id"]), ("diagnosis: acute flu", ["health_info"]), ("iban: DE89370400440532", ["financial"]),
    ("fingerprint id: ab123", ["biometric"]), ("Mr John Smith", ["name"]), ("New York", []),
])
def test_pii(text, kinds):
    found = {m[0] for m in pii.detect(text)}
    assert set(kinds) <= found and (kinds or not found & {"ssn", "credit_card", "ip_address", "name"})


def test_pii_replace(spark):
    found = pii.detect("call a@b.com now", ("email",))
    assert pii.replace("call a@b.com now", found, "redact") == "call [REDACTED:email] now"
    mark = hashlib.sha256(b"s:email:a@b.com").hexdigest()[:8]
    assert pii.replace("call a@b.com now", found, "pseudonymize", "s") == f"call [email:{mark}] now"


def test_limits(spark):
    ts = [datetime(2024, 1, 1, 0, 0, s) for s in (0, 1, 1, 2)]
    rows = spark.createDataFrame([(i, "d", t, i == 1, False, 500.0) for i, t in enumerate(ts)], "event_id long, domain string, ts timestamp, failed boolean, limited boolean, ms double")
    got = {r["event_id"]: r["wait"] for r in limits.replay(rows).collect()}
    assert got[0] == got[1] == 0.0 and got[2] == pytest.approx(2.0)  # the delay doubled by the error
    sent = limits.throttle(rows.select("event_id", F.lit("k").alias("key"), "ts"), 1)
    assert [r["sent"] for r in sent.orderBy("event_id").collect()] == [True, False, False, False]
    waits = limits.bucket(rows.select("event_id", "domain", "ts"), 1.0, 1)
    assert [r["wait"] for r in waits.orderBy("event_id").collect()] == [0.0, 0.0, 1.0, 1.0]


def test_sitemap():
    import gzip
    xml = b"<urlset xmlns='x'><url><loc> http://h/a </loc><priority>1.7</priority><changefreq>Daily</changefreq></url><url><loc>http://h/b</loc><changefreq>now</changefreq></url></urlset>"
    want = [("url", "http://h/a", None, "daily", 1.0), ("url", "http://h/b", None, None, None)]
    assert sitemap.parse(xml) == sitemap.parse(gzip.compress(xml)) == want
    assert sitemap.parse(b"<bad") == []


def test_options():
    o = Options.load("crawl: {seed_urls: [http://h], output_dir: out, max_depth: 3}\nother: 1")
    assert o.max_depth == 3 and Options.load(o.save()) == o
    with pytest.raises(ValueError):
        Options.load("crawl: {seed_urls: [x]}")


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "url string, target string")
    got = frontier.crawl(spark.createDataFrame([("a",)], "url string"), links, 2, lambda d: d.cache())
    assert {(r["url"], r["depth"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_table_functions(spark):
    """Null texts and pages give no matches and no links, and a page row that isn't a success; kinds are chosen by name; a second
    registration changes nothing."""
    from quern.functions import tables

    tables.register(spark)
    tables.register(spark)
    docs = spark.createDataFrame([(1, "write to a@b.org or 10.1.2.3"), (2, None), (3, "")], "id int, text string")
    rows = spark.sql("SELECT d.id, m.pii_type, m.start FROM {d} d, LATERAL quern_pii(d.text) m WHERE m.pii_type IN ('email', 'ip_address')", d=docs).collect()
    assert sorted(map(tuple, rows)) == [(1, "email", 9), (1, "ip_address", 20)]
    assert [tuple(r) for r in spark.sql("SELECT d.id, m.value FROM {d} d, LATERAL quern_pii(d.text, 'ip_address') m", d=docs).collect()] == [(1, "10.1.2.3")]
    pages = spark.createDataFrame([(1, "http://a.org/", "<a href='/x'>x</a><img src='http://b.org/i.png'>"), (2, None, None)], "id int, url string, html string")
    found = spark.sql("SELECT p.id, l.target, l.link_type, l.is_external FROM {p} p, LATERAL quern_links(p.url, p.html) l", p=pages).collect()
    assert sorted(map(tuple, found)) == [(1, "http://a.org/x", "anchor", False), (1, "http://b.org/i.png", "image", True)]
    assert [r["success"] for r in spark.sql("SELECT x.success FROM {p} p, LATERAL quern_page(p.url, p.html) x", p=pages).collect()] == [False, False]
