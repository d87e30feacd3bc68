"""Structures in time, strategies, claims, plug-ins, crawls and the command line, by hand-computed cases and brute force."""

import json
from datetime import datetime, timezone
from urllib.parse import parse_qs, urlencode

import pytest
from pyspark.sql import functions as F

from quern import __main__ as cli, plugins, run
from quern.functions import dom, url as U
from quern.operators import claims, compliance, extract, learn, lifecycle, limits, metrics, pii, store, strategies, structure
from quern.sources import sinks, sitemap, tables

LEFT = """<html><body class="home"><nav class="menu"><a href="/a">A</a></nav><main id="m"><div class="post-body x"><p>one<p>two</div><div class="post-body">y</div><div class="side">z</div>
<iframe src="/v/12"></iframe></main><footer id="f">end</footer></body></html>"""
RIGHT = """<html><body><header><nav><a href="/a">A</a></nav></header><article><section class="entry"><p>one</section></article><table><tr><td>1</table><form></form></body></html>"""


def pages(spark, *html):
    return spark.createDataFrame([(i, h) for i, h in enumerate(html, 1)], "page_id long, html string")


def both(spark, old, new):
    s = structure.structures(pages(spark, old, new))
    a, b = (s.where(f"page_id = {i}").select(F.struct(*s.columns).alias(n)) for i, n in ((1, "old"), (2, "new")))
    return a.join(b)


def test_regions():
    names = lambda h: [(r["name"], r["primary_selector"], r["confidence"]) for r in structure.analyze(h)["content_regions"]]
    assert names(LEFT) == [("main", "main", 0.85), ("post-body", "div.post-body", 0.7)]
    assert names("<article>a</article><article>b</article><main>c</main><div class='a Content-1 post'></div>") == [("article", "article", 0.9), ("Content-1", "div.Content-1", 0.7)]
    assert len(names("".join(f"<div class='post{i}'></div>" for i in range(9)))) == 5 and names("<p>x") == []


def test_change_records(spark):
    r = structure.change_records(both(spark, LEFT, RIGHT)).first()
    by = {x["component"]: x for x in r["records"]}
    assert by["content_regions"]["change_type"] == "content_relocated" and by["content_regions"]["added"] == ["article"] and by["content_regions"]["removed"] == ["main", "post-body"]
    assert by["id_attributes"]["removed"] == ["f", "m"] and by["semantic_landmarks"]["added"] == ["article", "header", "section"] and by["semantic_landmarks"]["moved"] == ["nav"]
    assert by["css_classes"]["added"] == ["entry"] and by["css_classes"]["breaking"] and by["css_classes"]["confidence"] == 1.0 and by["css_classes"]["reason"] == "css_classes similarity: 0.00%"
    assert r["relearn"] and r["change_class"] == "breaking"
    assert round(r["similarity"], 9) == round(structure.change_similarity(structure.analyze(LEFT), structure.analyze(RIGHT)), 9)
    same = structure.change_records(both(spark, LEFT, LEFT)).first()
    assert same["records"] == [] and not same["relearn"] and same["similarity"] == pytest.approx(1.0)


def test_comparisons(spark):
    a, b = structure.analyze(LEFT), structure.analyze(RIGHT)
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = [share(a[c], b[c]) for c in ("tag_counts", "css_class_map", "id_attributes", "semantic_landmarks")]
    assert structure.compare(both(spark, LEFT, RIGHT)).first()["similarity"] == pytest.approx(sum(want) / 4)
    assert structure.compare(both(spark, "x", "y")).first()["similarity"] == 0.0 and structure.compare(both(spark, "<p>x", "<p>y")).first()["similarity"] == 1.0
    v = structure.compare_versions(both(spark, LEFT, RIGHT)).first()
    assert v["tag_similarity"] == pytest.approx(want[0]) and v["class_similarity"] == 0.0 and v["classes_added"] == ["entry"] and "table" in v["tags_added"] and not v["same_hash"]


def test_descriptions(spark):
    s = structure.structures(pages(spark, LEFT, RIGHT)).orderBy("page_id")
    got = s.select(structure.describe_briefly(F.lit("article")), structure.describe_plainly(F.lit("h.org"), F.lit("listing")), structure.summary(F.lit("h.org"), F.lit("x")), structure.monitor_fingerprint()).collect()
    assert got[0][0] == "type:article size:small has:iframes landmark:footer landmark:main landmark:nav"
    assert got[1][0] == "type:article size:small has:article has:tables has:forms landmark:article landmark:header landmark:nav landmark:section"
    assert got[0][1] == "Page on h.org of type listing with content in main, post-body using footer, main, nav landmarks."
    assert "Content Regions: main(main), post-body(div.post-body)\nNavigation Count: 1\nIframes: main" in got[0][2] and got[0][2].startswith("Domain: h.org\nPage Type: x\nTop Tags: div:3, p:2, ")
    assert got[0][3] != got[1][3] and len(got[0][3]) == 16
    text = structure.structures(pages(spark, LEFT.replace("one", "three"))).select(structure.monitor_fingerprint()).first()[0]
    assert text == got[0][3]  # only the words differ
    assert s.select((structure.to_json(structure.from_json(structure.to_json(F.struct(*s.columns)))) == structure.to_json(F.struct(*s.columns))).alias("x")).where("x").count() == 2


def _rows(spark, *html):
    s = structure.structures(pages(spark, *html)).withColumn("key", F.lit("k")).withColumn("seq", F.col("page_id")).withColumn("at", F.col("page_id") * 10)
    return s.withColumn("fingerprint", structure.fingerprint()).withColumn("hash", structure.monitor_fingerprint())


MANY = "<nav>n</nav><article>" + "<p>x</p>" * 20 + "</article>"
MORE = "<nav>n</nav><article>" + "<p>x</p>" * 20 + "<b>y</b>" * 12 + "</article>"


def test_life_cycle(spark):
    html = [MANY, MANY, RIGHT, MORE, MANY, RIGHT]
    got = {r["page_id"]: r for r in lifecycle.life_cycle(_rows(spark, *html), seconds=35).collect()}
    s, variants, want = [structure.analyze(h) for h in html], [], {}
    for i, x in enumerate(s, 1):  # the same by brute force, over the structures themselves
        near = max(((structure.variant_similarity(v[0], x), -k) for k, v in enumerate(variants)), default=(0, 0))
        if near[0] < 0.85:
            variants.append([x, 1, i * 10])
            want[i] = ("learned", 1, len(variants) - 1)
        else:
            v = variants[-near[1]]
            kind = "relearned" if i * 10 - v[2] > 35 else "adapted" if structure.change_similarity(v[0], x) < 0.7 else "matched"
            if kind != "matched":
                v[:] = [x, v[1] + 1, i * 10]
            want[i] = (kind, v[1], -near[1])
    ids = [got[next(i for i, w in want.items() if w[2] == k)]["variant_id"] for k in range(len(variants))]
    assert {i: (r["action"], r["version"], ids.index(r["variant_id"])) for i, r in got.items()} == want
    assert {w[0] for w in want.values()} >= {"learned", "matched", "relearned"} and len(set(ids)) == len(ids)


def test_life_cycle_goes_on(spark):
    """Three calls that hand on what is stored give the rows of one, and the strategies of a plain loop."""
    titled = lambda x, tag: x.replace("<nav", f"<{tag}>A title</{tag.split()[0]}><nav", 1)
    html = [titled(x, tag) for x, tag in ((MANY, "h1"), (MANY, "h1"), (RIGHT, "h1"), (MORE, "h1"), (MANY, "h1"), (RIGHT, "h1"), (LEFT, "h1"), (MORE, "h1 class='headline'"))]
    rows = _rows(spark, *html).cache()
    at_once = {r["page_id"]: tuple(r) for r in lifecycle.life_cycle(rows, breaking=0.99, seconds=25).collect()}
    known = kept = rules = None
    got, made = {}, []
    for low, high in ((1, 3), (4, 4), (5, 8)):
        part = rows.where(f"seq between {low} and {high}")
        life = lifecycle.life_cycle(part, known=known, breaking=0.99, seconds=25).cache()
        got |= {r["page_id"]: tuple(r) for r in life.collect()}
        new = lifecycle.versions(life, part, known)
        made += strategies.lived(life, pages(spark, *html), rules).collect()
        kept = new if kept is None else kept.union(new)
        known = lifecycle.stored(kept)
        rules = spark.createDataFrame(made, strategies.STRATEGY)
    assert got == at_once and {r[3] for r in got.values()} >= {"learned", "matched", "relearned", "adapted"}
    want, state = {}, {}
    for i in sorted(at_once):
        key, _, variant, action, _, version = at_once[i]
        if action == "matched":
            continue
        root = dom.parse(html[i - 1])
        if action == "adapted":
            state[variant] = {f: r for f, (sel, c) in state[variant].items() if (r := (sel, c * 0.95) if dom.select(root, sel) else (lambda b: b and (b[0], b[1] * 0.8))(extract.best_selector(root, f)))}
        else:
            state[variant] = extract.infer(root)
        want[f"{key}#{variant}", version] = ("adaptation" if action == "adapted" else "learned", {f: (sel, round(c, 9)) for f, (sel, c) in state[variant].items()})
    assert {(r["key"], r["version"]): (r["source"], {f: (x["primary"], round(x["confidence"], 9)) for f, x in r["rules"].items()}) for r in made} == want
    none = rows.where("false")
    assert lifecycle.life_cycle(none, known=known).count() == 0 and strategies.lived(lifecycle.life_cycle(none), pages(spark, *html), rules).count() == 0


def test_crawls_learn(spark, site):
    """A second crawl of the same pages learns nothing, one of broken pages adapts, one after the lifetime learns anew."""
    path, out = site
    one = spark.read.parquet(path)
    crawl = lambda p, n, **own: run.run_crawl(spark, p, ["http://h.org/"], f"{out}/{n}", store=f"{out}/store", **own)
    first, again = crawl(one, "o1", at=1000, html=True), crawl(one, "o2", at=2000)
    kept = {r["url"]: r for r in spark.read.parquet(f"{out}/o1/html").collect()}
    assert len(kept) == first["pages_crawled"] and {(u, r["html"]) for u, r in kept.items()} <= {(r["url"], r["html"]) for r in one.collect()} and all(r["domain"] == "h.org" and r["file_name"] for r in kept.values())
    assert first["structures_learned"] >= 1 and (again["structures_learned"], again["structures_adapted"]) == (0, 0)
    changed = one.withColumn("html", F.regexp_replace("html", "<h1>(.*?)</h1>", "<h2 class='headline'>$1</h2><table><tr><td>1</td></tr></table>"))
    third = crawl(changed, "o3", at=3000, breaking_threshold=0.99, variant_threshold=0.3)
    assert third["structures_adapted"] >= 1
    kept = run.Learned.load(spark, f"{out}/store")
    assert kept.strategies.where("source = 'adaptation'").count() == third["structures_adapted"] and kept.variants.count() == kept.strategies.count()
    assert crawl(changed, "o4", at=10_000_000, structure_ttl=60, variant_threshold=0.3)["structures_learned"] >= 1
    assert run.Learned.load(spark, f"{out}/nothing") is None


def test_monitor(spark):
    got = [(r["page_id"], r["change_type"], r["version"]) for r in lifecycle.monitor(_rows(spark, MANY, MANY.replace("x", "y"), MORE, RIGHT, RIGHT, LEFT)).orderBy("page_id").collect()]
    assert got[0] == (1, "new_content", 1) and got[1][0] == 3 and got[2][:2] == (4, "structure_changed") and [g[0] for g in got] == [1, 3, 4, 6]


def test_strategies(spark):
    rows = [("k", 1, "learned", {"title": ("h3", [], "text", None, 1.0)}), ("k", 2, "learned", {"title": (".none", ["h1"], "text", None, 1.0), "date": ("time", [], "text", None, 0.8), "images": (".gallery img", ["img"], "text", None, 1.0),
            "body": ("p", [], "html", None, 0.5), "lang": ("html", [], "attribute", "lang", 0.9), "when": (".when", [], "text", "date", 0.7)})]
    s = spark.createDataFrame(rows, strategies.STRATEGY)
    html = "<html lang='en'><body><h1>Title</h1><time datetime='2024-03-01'>x</time><p>a <strong>b</strong></p><p>c</p><img src='1.png'><img data-src='2.png'><i class='when'>May 3, 2021</i></body></html>"
    p = spark.createDataFrame([(1, "k", html), (2, "other", html), (3, "k", None)], "page_id long, key string, html string")
    got = {r["page_id"]: {f["field"]: f for f in r["found"]} for r in strategies.apply(p, s).collect()}
    assert set(got) == {1, 3} and got[3] == {}
    f = got[1]
    assert (f["title"]["value"], f["title"]["confidence"]) == ("Title", 0.9) and f["date"]["value"] == "2024-03-01T00:00:00+00:00" and f["images"]["items"] == ["1.png", "2.png"] and f["images"]["confidence"] == 0.9
    assert f["body"]["value"] == "<p>a <strong>b</strong></p>\n\n<p>c</p>" and f["lang"]["value"] == "en" and f["when"]["value"].startswith("2021-05-03")
    a = {r["page_id"]: r for r in strategies.adapted(p, s).collect()}[1]
    assert a["version"] == 3 and a["source"] == "adaptation" and a["rules"]["title"]["primary"] == "h1" and a["rules"]["title"]["confidence"] == pytest.approx(0.56) and a["rules"]["date"]["confidence"] == pytest.approx(0.76)
    v = {r["page_id"]: r for r in strategies.validated(p, s).collect()}
    assert v[1]["valid"] and not v[3]["valid"] and set(v[3]["fields"].values()) == {False}
    o = strategies.overridden(s, spark.createDataFrame([("k", "title", "h2.new")], "key string, field string, selector string")).first()
    assert o["version"] == 3 and o["source"] == "manual" and o["rules"]["title"].asDict() == {"primary": "h2.new", "fallbacks": [".none"], "method": "text", "attribute": None, "confidence": 1.0} and len(o["rules"]) == 6
    text = s.where("version = 2").select(strategies.describe()).first()[0]
    assert text.startswith("Extraction strategy for k pages Learning source: learned Title extracted using .none selector (100% confidence)")


def test_claims(spark):
    log = [("a", 1, "add", None, None), ("a", 2, "claim", "w1", None), ("a", 3, "fail", "w1", "x"), ("a", 4, "claim", "w2", None), ("b", 1, "add", None, None), ("c", 1, "claim", "w1", None), ("c", 2, "complete", "w1", None),
           ("d", 1, "claim", "w", None), ("d", 2, "fail", "w", None), ("d", 3, "claim", "w", None), ("d", 4, "fail", "w", "gone"), ("e", 1, "fail", "w", None), ("c", 3, "add", None, None)]
    got = {r["url"]: tuple(r)[1:] for r in claims.task_states(spark.createDataFrame(log, "url string, seq long, kind string, worker string, error string"), 2).collect()}
    assert got == {"a": ("processing", 2, "w2", None), "b": ("queued", 0, None, None), "c": ("completed", 1, None, None), "d": ("failed", 2, None, "gone"), "e": ("failed", 0, None, "Max retries exceeded")}
    tasks = spark.createDataFrame([("x", "queued", 0, 2.0), ("y", "queued", 1, 1.0), ("z", "failed", 3, 0.0), ("u", "queued", 0, 2.0)], "url string, state string, attempts int, score double")
    done = {r["url"]: (r["state"], r["attempts"], r["worker"]) for r in claims.claim(tasks, spark.createDataFrame([("w1", 1), ("w2", 1)], "worker string, slots int"), F.current_timestamp()).collect()}
    assert done == {"y": ("processing", 2, "w1"), "u": ("processing", 1, "w2"), "x": ("queued", 0, None), "z": ("failed", 3, None)}


def test_crawl_delay_overrides(spark):
    rows = [(i, "d", datetime(2024, 1, 1, 0, 0, 2 * i), i == 1, False, 500.0, 4.0 if i != 3 else None) for i in range(4)]
    schema = "event_id long, domain string, ts timestamp, failed boolean, limited boolean, ms double, crawl_delay double"
    got = [r["wait"] for r in limits.replay(spark.createDataFrame(rows, schema)).orderBy("event_id").collect()]
    assert got == [0.0, 2.0, 8.0, 1.0]  # four seconds asked for, doubled after the error; the last row has the default of one


@pytest.mark.parametrize("query", ["utm%5Fsource=1&b=x y", "q=a+b&q=a%20b", "k=%C3%A9&é=1", "a=%zz&b=100%", "=x&y", "z=~*-_.!&SID9=1", "x=1=2&x=", "sessionfoo=1&%73id=2&n=%2B", "q=日本&a=/p?"])
def test_normalize_like_forms(spark, query):
    """Against the standard library's form decoding and encoding."""
    drop = lambda k: k.lower() in U.TRACKING or any(k.lower().startswith(s) for s in U.SESSION)
    want = urlencode(sorted((k, v) for k, v in parse_qs(query, keep_blank_values=True).items() if not drop(k)), doseq=True)
    got = spark.createDataFrame([(f"http://h/?{query}",)], "u string").select(U.normalize(F.col("u"))).first()[0]
    assert got == "http://h/" + (f"?{want}" if want else "")


def test_file_names_and_links(spark):
    one = lambda u, f: spark.createDataFrame([(u,)], "u string").select(f(F.col("u"))).first()[0]
    assert one("http://h/a/my-page_1.html;v=1?x", U.file_name).rsplit("_", 1)[0] == "my_page_1_html" and one("http://h/é-1/", U.file_name).startswith("é_1_") and one("http://h", U.file_name).startswith("index_")
    j = lambda b, r: spark.createDataFrame([(b, r)], "b string, r string").select(U.resolve(F.col("b"), F.col("r"))).first()[0]
    assert [j("http://h/a/b", r) for r in ("c", "../c", "//x/y", "?q", None)] == ["http://h/a/c", "http://h/c", "http://x/y", "http://h/a/b?q", None]
    rows = extract.page_links(spark.createDataFrame([(1, "http://h/", '<a href="/x">x</a><a href="http://o.org/y">y</a><a href="http://s.ok.org/z">z</a>')], "page_id long, url string, html string"))
    names = lambda df: {r["url"] for r in df.collect()}
    assert names(extract.follow(rows)) == {"http://h/x"} and names(extract.follow(rows, allowed=("ok.org",))) == {"http://h/x", "http://s.ok.org/z"}
    assert len(names(extract.follow(rows, external=True, allowed=("ok.org",)))) == 3 and names(extract.page_urls(rows, allowed=("ok.org",))) == {"http://h/x"}


def test_dates_of_the_future(spark):
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert extract.parse_date("2024-06-01", now) is None and extract.parse_date("2023-06-01", now) == "2023-06-01T00:00:00+00:00" and extract.parse_date("9999-01-01") is None
    assert extract.parse_date("x 1700000000000 y", now) == "2023-11-14T22:13:20+00:00" and extract.parse_date("12", now) is None
    assert extract.page_date(dom.parse('<time datetime="2024-06-01">2023-05-01</time>'), now) == ("2023-05-01T00:00:00+00:00", 0.9)
    p = spark.createDataFrame([(1, "http://h", '<h1>t</h1><time datetime="2024-06-01">', datetime(2024, 1, 1)), (2, "http://h", '<h1>t</h1><time datetime="2024-06-01">', datetime(2025, 1, 1))], "page_id long, url string, html string, at timestamp")
    assert {r["page_id"]: r["date"] for r in extract.extractions(p, "at").collect()} == {1: None, 2: "2024-06-01T00:00:00+00:00"}


def test_stores_and_models(spark, tmp_path):
    s = spark.createDataFrame([('{"a": 1, "b": [true]}',), ('{"a": 2.5}',), ("no json",)], "j string")
    assert "a" in sinks.shape(s, "j") and "b" in sinks.shape(s, "j")
    e = spark.createDataFrame([(i, [float(i % 2), 1.0], "ab"[i % 2]) for i in range(40)], "id long, embedding array<double>, label string")
    model, accuracy = learn.train(e, "label")
    learn.save(model, f"{tmp_path}/m")
    assert accuracy == 1.0 and {(r["label"], r["predicted"]) for r in learn.predict(learn.load(f"{tmp_path}/m"), e).collect()} == {("a", "a"), ("b", "b")}
    w = learn.importances(model)
    assert w[0] > w[1] and learn.importances(learn.train(e, "label", "forest")[0])[0] > 0.5
    changes = e.select(F.array(F.lit(0.0), F.lit(1.0)).alias("old"), F.col("embedding").alias("new"), "label")
    assert learn.train_changes(changes, "label")[1] == 1.0
    first = store.save_baselines(None, spark.createDataFrame([("d", "p", 1, "x"), ("d", "p", 2, "y"), ("e", "p", 1, "z")], "domain string, page_type string, at int, v string"), "at")
    second = store.save_baselines(first, spark.createDataFrame([("d", "p", 0, "new")], "domain string, page_type string, at int, v string"), "at")
    assert {(r["domain"], r["v"]) for r in second.collect()} == {("d", "new"), ("e", "z")}
    with pytest.raises(ValueError, match="salt"):
        pii.processed(spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string"), "pseudonymize")
    body = spark.createDataFrame([(1, b"caf\xc3\xa9 \xff"), (2, b"x" * 20), (3, None)], "id long, body binary")
    assert {r["id"]: (r["html"], r["status"]) for r in tables.fetched(body, 10).collect()} == {1: ("café �", "success"), 2: (None, "error_content_too_large"), 3: (None, "success")}


def test_lists_and_notices(spark, tmp_path):
    (tmp_path / "block.txt").write_text("# listed\n\n Bad.ORG \nother.com\n")
    listed = compliance.read_domains(spark, f"{tmp_path}/block.txt")
    assert {r[0] for r in listed.collect()} == {"bad.org", "other.com"}
    given = spark.createDataFrame([("Sued.com", datetime(2024, 1, 2).date(), "R7"), ("sued.com", datetime(2024, 1, 1).date(), "")], "domain string, received date, reference string")
    block, records = compliance.record_notices(listed, given)
    assert {r[0] for r in block.collect()} == {"bad.org", "other.com", "sued.com"}
    assert [(r["domain"], r["basis"], r["notes"], r["authorized"]) for r in records.collect()] == [("sued.com", "cease_desist", "Reference: R7", False)]
    import gzip
    xml = lambda *locs: b"<urlset>" + b"".join(b"<url><loc>%s</loc></url>" % x for x in locs) + b"</urlset>"
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "a.xml").write_bytes(xml(b"http://h/1", b"http://o/2", b"http://h/3"))
    (tmp_path / "maps" / "b.xml.gz").write_bytes(gzip.compress(xml(b"http://h/4")))
    assert sorted(r["loc"] for r in sitemap.page_urls(spark, f"{tmp_path}/maps", "h", 1).collect()) == ["http://h/1", "http://h/4"]


def test_metrics(spark):
    m = pii.matches(spark.createDataFrame([(1, "a@b.com c@d.org 1.2.3.4")], "doc_id long, text string"), kinds=("email", "ip_address"))
    assert {(r["pii_type"], r["action"], r["n"]) for r in metrics.personal(m, "redact").collect()} == {("email", "redact", 2), ("ip_address", "redact", 1)}
    b = spark.createDataFrame([("h", None, True), ("h", "robots_txt", False), ("h", "public_access", True), ("h", "explicit_permission", False)], "domain string, basis string, allowed boolean")
    assert {(r["reason"], r["n"]) for r in metrics.blocked(b).collect()} == {("unknown", 1), ("robots_txt", 1), ("robots", 1)}


@pytest.fixture
def site(spark, tmp_path):
    page = lambda links, title: f"<html><body><article><h1>{title} of the site</h1><p>{'words of the text ' * 12} mail me@h.org</p>{''.join(f'<a href={x!r}>l</a>' for x in links)}</article></body></html>"
    rows = [(1, "http://h.org/", page(["/a", "/b?utm_source=x", "http://o.org/"], "First")), (2, "http://h.org/a", page(["/c"], "Second")), (3, "http://h.org/b", page([], "Third")), (4, "http://h.org/c", page(["/d"], "Fourth")),
            (5, "http://h.org/lost", page([], "Lost")), (6, "http://o.org/", page([], "Other")), (7, "http://h.org/d", page([], "Deep"))]
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    return path, tmp_path


def test_run_crawl(spark, site):
    path, out = site
    robots = spark.createDataFrame([("h.org", "User-agent: *\nDisallow: /b", 200)], "domain string, content string, status int")
    seen = []
    done = run.run_crawl(spark, spark.read.parquet(path), ["http://H.org"], f"{out}/o", robots=robots, max_depth=2, on_pages_crawled=lambda df: seen.append(df.count()), on_error=lambda df: 1 / 0)
    assert (done["pages_crawled"], done["pages_blocked"], done["domains"]) == (3, 1, 1) and seen == [3]
    got = {r["url"]: r for r in spark.read.json(f"{out}/o/extracted").collect()}
    assert set(got) == {"http://h.org/", "http://h.org/a", "http://h.org/c"} and "[REDACTED:email]" in got["http://h.org/a"]["content"] and got["http://h.org/a"]["title"] == "Second of the site"
    log = {r["event"]: r["n"] for r in spark.read.parquet(f"{out}/o/log.parquet").groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert log == {"fetch_start": 4, "robots_check": 4, "fetch_success": 3, "fetch_blocked": 1} and spark.read.parquet(f"{out}/o/structures.parquet").count() == 3


def test_command_line(spark, site, capsys):
    path, out = site
    assert cli.main(["crawl", "-u", "http://h.org/", "-o", f"{out}/c", "--pages", path, "-d", "1", "--max-pages-per-domain", "2", "-a", "o.org"], spark) == 0
    assert "'pages_crawled': 3" in capsys.readouterr().out
    for args in (["ml", "describe", "--describe", "brief"], ["ml", "embed"], ["ml", "similar", "--page", "1", "-k", "2"], ["ml", "set-baselines", "--path", f"{out}/b"], ["ml", "drift", "--path", f"{out}/b"], ["ml", "list-baselines", "--path", f"{out}/b"],
                 ["ml", "pairs"], ["ml", "compare"], ["inspect", "stats"], ["inspect", "list"], ["inspect", "search", "--text", "LOST"], ["inspect", "history", "-k", "1"], ["inspect", "fingerprint"]):
        assert cli.main([*args, "--pages", path, "--output", f"{out}/{args[0]}-{args[1]}"], spark) == 0
    assert [r["url"] for r in spark.read.parquet(f"{out}/inspect-search").collect()] == ["http://h.org/lost"] and spark.read.parquet(f"{out}/ml-similar").count() == 2
    with pytest.raises(ValueError, match="missing"):
        cli.options(cli.arguments(["crawl", "--pages", path]))
    (out / "c.yaml").write_text("crawl: {seed_urls: [http://h], output_dir: o, max_depth: 3}\nrate_limit: {default_delay: 2}\nextra: {x: 1}")
    o = cli.options(cli.arguments(["crawl", "--pages", path, "--config", f"{out}/c.yaml", "-d", "1", "-r", "4"]))
    assert (o.max_depth, o.default_delay, o.seed_urls, o.extra) == (1, 0.25, ("http://h",), {"extra": {"x": 1}})


def test_plugins(spark, tmp_path):
    alerts = spark.createDataFrame([("structure", "error", "t", "m", "h", "u"), ("pii", "warning", "t", "m", "h", "u")], "alert_type string, severity string, title string, message string, domain string, url string")
    folder = str(tmp_path / "sent")

    def call(alert, folder=folder):
        import os
        os.makedirs(folder, exist_ok=True)
        if alert["alert_type"] == "pii":
            raise ValueError("refused")
        with open(f"{folder}/{alert['alert_type']}", "w") as f:
            json.dump(alert, f)

    plugins.deliver(alerts, [plugins.TableChannel(f"{tmp_path}/alerts"), plugins.LogChannel(), plugins.CallChannel(call)])
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 2 and [p.name for p in (tmp_path / "sent").iterdir()] == ["structure"]
    assert plugins.guarded(lambda: 1 / 0) is False and plugins.guarded(lambda x: x, 1) is True and plugins.guarded(None) is False
    rows = structure.structures(pages(spark, LEFT)).select(F.lit("h").alias("domain"), F.lit("p").alias("page_type"), F.lit(1).alias("captured_at"), "*")
    kept = plugins.Store(spark, f"{tmp_path}/store", "described").save(rows).first()
    assert kept["version"] == 1 and len(kept["embedding"]) == 384 and kept["description"].startswith("Page with")
    with pytest.raises(ValueError):
        plugins.Store(spark, "x", "other")


def test_options_take_effect_or_are_refused(spark):
    """Each option that a crawl of stored pages knows changes what it gives; each other one is an error if it is set."""
    link = lambda *a: "".join(f"<a {x}>x</a>" for x in a)
    rows = [
        (1, "http://h.org/", "<p>" + link('href="/a"', 'href="http://o.org/b"', 'href="/c" rel="nofollow"', 'href="/d.pdf"', 'href="/big"')), (2, "http://h.org/a", "<html><body><article><h1>t</h1><p>" + "some words of a text " * 30 + "my SSN is 123-45-6789</p></article></body></html>"), (3, "http://o.org/b", "<p>b"),
        (4, "http://h.org/c", "<p>c"), (5, "http://h.org/d.pdf", "<p>d"), (6, "http://h.org/big", "<p>" + "x" * 5000)]
    pages_ = spark.createDataFrame(rows, "page_id long, url string, html string")
    robots = spark.createDataFrame([("h.org", "User-agent: *\nDisallow: /a", 200)], "domain string, content string, status int")

    def crawl(**own):
        got = run.crawl(spark, pages_, sinks.Options(seed_urls=("http://h.org/",), output_dir="o", **own), robots=robots)
        return {r["page_id"]: r["status"] for r in got.pages.collect()}, {r["page_id"] for r in got.extractions.collect()}

    status, kept = crawl()
    assert set(status) == {1, 2, 6} and status[2].startswith("blocked") and kept == {1, 6}
    assert set(crawl(follow_external=True)[0]) == {1, 2, 3, 6} and set(crawl(follow_nofollow=True)[0]) == {1, 2, 4, 6} and set(crawl(extract_resources=True)[0]) == {1, 2, 5, 6}
    status, kept = crawl(respect_robots=False)
    assert status[2] == "success" and kept == {1, 6}  # its sensitive data exclude it
    assert crawl(respect_robots=False, alert_on_sensitive=False)[1] == {1, 2, 6}
    assert crawl(max_content_size=4000)[0][6] == "error_content_too_large"
    for own in ({"default_delay": 2.0}, {"timeout": 1.0}, {"priority_boost_patterns": ("x",)}, {"alert_throttle_minutes": 1}):
        with pytest.raises(ValueError, match=next(iter(own))):
            crawl(**own)


def test_training_pairs(spark, site, capsys):
    path, out = site
    assert cli.main(["ml", "pairs", "--pages", path, "--output", f"{out}/pairs"], spark) == 0
    got = spark.read.parquet(f"{out}/pairs").collect()
    assert got and all(r["a"] < r["b"] and r["target"] == float(r["a"].split("|")[1] == r["b"].split("|")[1]) for r in got)


def test_a_store_that_cannot_be_read_is_no_empty_one(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("not a Parquet file")
    shapes = spark.createDataFrame([("h.org", "article", 1)], "domain string, page_type string, captured_at long")
    with pytest.raises(Exception, match="(?i)parquet"):
        plugins.Store(spark, str(tmp_path)).save(shapes).collect()
    assert plugins.Store(spark, f"{tmp_path}/none").save(shapes).count() == 1


def test_boosted_trees(spark, tmp_path):
    """Classes that no line parts: held-out rows, out-of-fold accuracy, importances, and a model saved and loaded."""
    r = __import__("random").Random(8)
    rows = [(i, f"c{(x > 0.5) ^ (y > 0.5)}" if x < 0.8 else "edge", [x, y, r.random()]) for i in range(400) for x, y in [(r.random(), r.random())]]
    df = spark.createDataFrame(rows, "i long, label string, embedding array<double>").coalesce(2)
    model, accuracy = learn.train(df.where("i < 300"), "label", "boosted", folds=2, rounds=6)
    assert accuracy > 0.8
    learn.save(model, f"{tmp_path}/m")
    got = learn.predict(learn.load(f"{tmp_path}/m"), df.where("i >= 300")).collect()
    assert sum(x["label"] == x["predicted"] for x in got) > 85 and all(1 / 3 <= x["confidence"] <= 1 for x in got)
    weights = learn.importances(model)
    assert len(weights) == 3 and min(weights[:2]) > weights[2]
