"""Table functions for SQL, used with LATERAL: rows of one text or page beside the columns of its own row.

`register(spark)` names them: `quern_pii(text)` and `quern_pii(text, kinds)` (kinds by commas), `quern_links(url, html)`, and
`quern_page(url, html)` with one row. Of a null text or page the first two give no rows, the last one that isn't a success.
Rows go to them as they come, without a shuffle; only what a query names of the input is sent along.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quern.operators import extract, pii

PII = "pii_type string, value string, start int, end int, confidence double, category string"
LINK = "target string, link_type string, is_external boolean, nofollow boolean"
PAGE = "success boolean, title string, content string, author string, date string, confidence double, errors array<string>"


class _Pii:
    def eval(self, text: str | None, kinds: str | None = None) -> Iterator[tuple]:
        wanted = tuple(k.strip() for k in kinds.split(",")) if kinds else tuple(pii.PATTERNS)
        for m in pii.detect(text or "", wanted):
            yield (*m, pii.SENSITIVE.get(m[0]))


class _Links:
    def eval(self, url: str | None, html: str | None) -> Iterator[tuple]:
        for link in extract.links(html, url or "") if html is not None else ():
            yield link["url"], link["link_type"], link["is_external"], link["nofollow"]


class _Page:
    def eval(self, url: str | None, html: str | None) -> Iterator[tuple]:
        e = extract.extract(html, url or "")
        yield tuple(e[c.split()[0]] for c in PAGE.split(", "))


def register(spark: SparkSession) -> None:
    """The table functions under their names in a session; a second time changes nothing."""
    for name, cls, schema in (("quern_pii", _Pii, PII), ("quern_links", _Links, LINK), ("quern_page", _Page, PAGE)):
        spark.udtf.register(name, udtf(cls, returnType=schema, useArrow=False))
