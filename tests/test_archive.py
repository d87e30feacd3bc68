"""The data sources: round trips, versions, pushed filters, failed jobs, and WARC files from elsewhere."""

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.sources import archive

PAGES = "page_id long, url string, html string, fetched_at timestamp"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    archive.register(spark)


def rows(n=40):
    return [(i, f"http://h{i % 9}.org/p?{i}", f"<p>page {i} é\r\n\r\nWARC/1.0\r\n</p>", datetime(2024, 1, 1, 0, 0, i)) for i in range(n)]


def save(spark, data, at, mode="append", **options):
    spark.createDataFrame(data, PAGES).repartition(3).write.format("quern_pages").options(**options).mode(mode).save(str(at))


def load(spark, at, **options):
    return spark.read.format("quern_pages").options(**options).load(str(at))


def plain(df):
    return sorted(map(tuple, df.select("page_id", "url", "html", "fetched_at").collect()), key=str)


def test_round_trip(spark, tmp_path):
    odd = [(None, "http://x.org/", "", datetime(2024, 1, 1)), (100, None, "no address", datetime(2024, 1, 1)), (101, "http://y.org/", None, None), (102, "//[bad/", "x" * 300_000, None)]
    save(spark, rows() + odd, tmp_path)
    assert plain(load(spark, tmp_path)) == sorted(rows() + odd, key=str)
    one = load(spark, tmp_path).where("page_id = 3").first()
    assert (one["host"], one["status_code"], one["content_type"], one["status"]) == ("h3.org", 200, "text/html", "success")


def test_versions(spark, tmp_path):
    save(spark, rows(5), tmp_path)
    save(spark, rows(9)[5:], tmp_path)
    save(spark, rows(2), tmp_path, "overwrite")
    count = lambda **o: load(spark, tmp_path, **o).count()
    assert (count(), count(version=1), count(version=2), count(version=3)) == (2, 5, 9, 2)
    with pytest.raises(Exception, match="no version 7"):
        count(version=7)


def test_filters_are_pushed(spark, tmp_path):
    save(spark, rows(), tmp_path)
    all_files = len(archive.listed(*archive.opened(str(tmp_path))))
    for cond, hosts in (("host = 'h3.org'", {"h3.org"}), ("host in ('h1.org', 'h5.org')", {"h1.org", "h5.org"}), ("host = 'none.org'", set())):
        got = load(spark, tmp_path).where(cond)
        assert plain(got) == [r for r in sorted(rows(), key=str) if r[1].split("/")[2] in hosts]
        assert got.rdd.getNumPartitions() < all_files
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Filter (isnotnull(host" not in plan or "(host" not in plan.split("Filter")[1].split("isnotnull(host")[1][8:40]  # the equality isn't evaluated again
    r = archive.Reader({"path": str(tmp_path)}, None, "host", archive.page_records)
    left = list(r.pushFilters([archive.EqualTo(("host",), "a"), archive.EqualTo(("url",), "b"), archive.In(("host",), ("a", "c"))]))
    assert left == [archive.EqualTo(("url",), "b")] and r.hosts == {"a"}


def test_a_failed_job_leaves_no_rows(spark, tmp_path):
    save(spark, rows(5), tmp_path)
    broken = spark.createDataFrame(rows(20), PAGES).repartition(4).withColumn("url", F.when(F.col("page_id") == 17, F.lit("http://a\r\nb")).otherwise(F.col("url")))
    with pytest.raises(Exception, match="line break"):
        broken.write.format("quern_pages").mode("append").save(str(tmp_path))
    assert plain(load(spark, tmp_path)) == sorted(rows(5), key=str)


def test_long_pages(spark, tmp_path):
    save(spark, [(1, "http://a.org/", "x" * 1000, None), (2, "http://a.org/b", "y" * 10, None)], tmp_path)
    got = {r["page_id"]: (r["status"], r["html"]) for r in load(spark, tmp_path, max_bytes=100).collect()}
    assert got == {1: ("error_content_too_large", None), 2: ("success", "y" * 10)}


def test_files_from_elsewhere(spark, tmp_path):
    """No list: all WARC files are read, plain or compressed, and records that aren't responses passed over."""
    body = b"HTTP/1.1 404 Not Found\r\ncontent-type: text/plain\r\n\r\n\xff gone"
    record = lambda kind, url, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-02-03T04:05:06Z\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.warc").write_bytes(record("warcinfo", "x", b"software: y\r\n") + record("response", "<http://Q.org/1>", body))
    (tmp_path / "sub" / "b.warc.gz").write_bytes(gzip.compress(record("request", "http://q.org/2", b"GET /\r\n\r\n")) + gzip.compress(record("response", "http://q.org/2", body)))
    (tmp_path / "notes.txt").write_text("not a WARC file")
    got = sorted(map(tuple, load(spark, tmp_path).select("page_id", "url", "host", "status_code", "content_type", "html", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss")).collect()))
    assert got == [(None, f"http://{q}.org/{i}", "q.org", 404, "text/plain", "� gone", "2024-02-03 04:05:06") for i, q in ((1, "Q"), (2, "q"))]
    assert load(spark, tmp_path).where("host = 'z.org'").count() == 0


def test_frontier(spark, tmp_path):
    df = spark.createDataFrame([(f"http://d{i % 5}.org/{i}", None, f"d{i % 5}.org" if i else None, i, i / 7, None, "queued", i) for i in range(50)], archive.FrontierSource({}).schema())
    df.write.format("quern_frontier").mode("append").save(str(tmp_path))
    back = spark.read.format("quern_frontier").load(str(tmp_path))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert sorted(r["url"] for r in back.where("domain = 'd2.org'").collect()) == sorted(f"http://d2.org/{i}" for i in range(2, 50, 5))
