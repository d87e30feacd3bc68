import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import url as U


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "u string").select(f(F.col("u"))).first()[0]


@pytest.mark.parametrize("url, want", [
    ("HTTP://A.com:80//x//y?b=2&a=1&utm_source=q#f", "http://a.com/x/y?a=1&b=2"),
    ("http://a.com/?side=1&z=2", "http://a.com/?z=2"),
    ("https://a.com:443", "https://a.com/"),
    ("http://a.com/p;x?ref=1", "http://a.com/p"),
    ("http://a.com/?k=2&a&k=1", "http://a.com/?a=&k=2&k=1"),
])
def test_normalize(spark, url, want):
    assert one(spark, url, U.normalize) == want
    assert one(spark, want, U.normalize) == want


def test_normalize_options(spark):
    assert one(spark, "http://A.com/x/?b=1&a=2#f", lambda c: U.normalize(c, sort_params=False, remove_trailing_slash=True, lowercase_domain=False, remove_fragment=False)) == "http://A.com/x?b=1&a=2#f"


@pytest.mark.parametrize("url, want", [
    ("http://h/users/12345/profile", "/users/{id}/profile"), ("http://h/2024/my-post", "/{id}/{slug}"),
    ("http://h/123e4567-e89b-12d3-a456-426614174000", "/{uuid}"), ("http://h", "/"),
])
def test_pattern(spark, url, want):
    assert one(spark, url, U.pattern) == want


@pytest.mark.parametrize("url, private", [
    ("http://10.1.2.3/", True), ("http://127.0.0.1:80/", True), ("http://172.20.0.1", True), ("http://172.32.0.1", False), ("http://8.8.8.8/", False),
    ("http://localhost/x", True), ("http://999.1.1.1/", False), ("", False),
])
def test_private(spark, url, private):
    assert one(spark, url, U.is_private) is private


def test_domain_keeps_port_and_validity(spark):
    assert one(spark, "http://U@A.com:8080/x", U.domain) == "u@a.com:8080"
    assert one(spark, "ftp://a.com", U.is_valid) is False
    assert one(spark, "http:///x", U.is_valid) is False


def test_matches(spark):
    assert one(spark, "http://h/a/b", lambda c: U.matches(c, ["/a/*"])) is True
    assert one(spark, "http://h/a/b/c", lambda c: U.matches(c, ["/a/*"])) is False
    assert one(spark, "http://h/a/b/c", lambda c: U.matches(c, ["/a/**"])) is True
    assert one(spark, "http://h/a", lambda c: U.matches(c, ["/[a"])) is False


def test_ipv6_against_the_standard_library(spark):
    """Random addresses inside and beside the ranges, in all spellings; and what only looks like one."""
    r = random.Random(6)
    leads = ["", "fe8", "febf", "fec0", "fc", "fd", "ff02", "20010db8", "2001000", "200101ff", "20010200", "2002", "3fff0", "3fff1", "2", "3", "0" * 20 + "ffff", "0" * 31, "0064ff9b" + "0" * 16, "4", "2001002", "2001003", "2001004", "200100040112", "20010003"]
    texts = []
    for _ in range(600):
        lead = r.choice(leads)
        d = (lead + "".join(r.choice("0123456789abcdef0000") for _ in range(32)))[:32]
        a = ipaddress.IPv6Address(int(d, 16))
        texts.append(r.choice([a.exploded, a.compressed, a.compressed.upper(), f"{a.compressed}%25en0"]))
    texts += ["::ffff:10.1.2.3", "::ffff:8.8.8.8", "::8.8.8.8", "64:ff9b::1.2.3.4", "2600::1:1.2.3.4", "::1", "::", "2001:1::1", "2001:1::2", "2001:1::3", "1::2:3:4:5:6:7"]
    urls = [f"http://{r.choice(['', 'u:p@'])}[{t}]{r.choice(['', ':8080'])}/p" for t in texts]
    bad = ["[::1", "[1:2:3]", "[1::2::3]", "[12345::]", "[g::1]", "[::1.2.3.999]", "[1:2:3:4:5:6:7:8:9]", "[1:2:3:4:5:6:7::8:9]", "[]", "[:]", "[:::]", "[1:2:3:4:5:6:7:]", "::1"]
    rows = spark.createDataFrame([(u,) for u in urls] + [(f"http://{b}/p",) for b in bad], "url string")
    got = {x["url"]: (x["d"], x["p"]) for x in rows.select("url", U.ipv6(U.domain("url")).alias("d"), U.is_private("url").alias("p")).collect()}
    for t, u in zip(texts, urls):
        a = ipaddress.IPv6Address(t.split("%")[0])
        b = a.ipv4_mapped or a
        want = b.is_private or b.is_loopback or b.is_reserved or b.is_link_local or a in ipaddress.ip_network("3fff::/20")  # a later range for documentation
        assert got[u] == (f"{int(a):032x}", want), u
    assert all(got[f"http://{b}/p"] == (None, False) for b in bad)


def test_an_address_is_taken_apart_once(spark):
    """`is_private` reads the host once, however many rules look at it, and numbers over 255 are no address."""
    df = spark.createDataFrame([(u,) for u in ("http://10.0.0.1:80/", "http://256.0.0.1/", "http://172.31.0.9/", "http://172.32.0.9/", "http://[::ffff:10.0.0.1]/", "http://[::ffff:8.8.8.8]:80/", "http://localhost/", "", None)], "url string")
    out = df.select(U.is_private("url").alias("private"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract(url") == 1
    assert [r[0] for r in out.collect()] == [True, False, True, False, True, False, True, False, False]
