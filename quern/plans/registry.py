"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

from quern.plans import compliance, control, crawl, events, learned, lifecycle, pages, stores, streams, texts, urls, work

MODULES = (urls, texts, compliance, events, crawl, pages, learned, stores, lifecycle, work, streams, control)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
