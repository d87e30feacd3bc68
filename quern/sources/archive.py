"""Stored pages (WARC) and the frontier (JSON lines) as Spark data sources: `quern_pages` and `quern_frontier`.

    archive.register(spark)
    pages.write.format("quern_pages").mode("append").save(folder)
    spark.read.format("quern_pages").load(folder).where("host = 'www.example.org'")

Each task writes gzip files of its own, one per bucket of hosts; a commit publishes them all at once, by a list of the files
that make up the table from then on, so that what a failed job leaves is never read, and every list is a version of
its own. A file is a partition. Equality and IN on the host reach the reader, which opens only the hosts' buckets and skips other
records undecoded. Folders of WARC files from elsewhere, which have no list, are read whole. One writer at a time.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.sources.tables import MAX_PAGE

BUCKETS = 16
#: Rows and bytes of an Arrow batch that a reader returns.
ROWS, BYTES = 1000, 16 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, with or without a scheme, and the path there."""
    if re.match("[a-z0-9]+:", uri) and not uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), re.sub("^file:(//)?", "", uri)


def bucket(host: str | None) -> int:
    return zlib.crc32((host or "").encode()) % BUCKETS


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def versions(fs: pafs.FileSystem, root: str) -> dict[int, str]:
    """The lists in a folder, by number."""
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return {int(m[1]): f.path for f in found if (m := re.fullmatch(r"_files-(\d+)[.]json", f.base_name))}


def listed(fs: pafs.FileSystem, root: str, version: int | None = None) -> list[str] | None:
    """The files of a version (the newest), or None where there is no list."""
    there = versions(fs, root)
    if not there:
        return None
    if version is not None and version not in there:
        raise ValueError(f"there is no version {version} in {root}")
    with fs.open_input_stream(there[max(there) if version is None else version]) as f:
        return json.loads(f.read())


class Reader(DataSourceReader):
    """Reads records by `records(stream, keys)` of a subclass: (host, row) for each record; rows of other hosts may be None."""

    def __init__(self, options: dict, schema: StructType, key: str, parse):
        self.options, self.schema, self.key, self.parse = options, schema, key, parse
        self.hosts: frozenset | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.key,):
                asked = frozenset(f.value if isinstance(f, In) else [f.value])
                self.hosts = asked if self.hosts is None else self.hosts & asked
            else:
                yield f

    def partitions(self) -> list[File]:
        fs, root = opened(self.options["path"])
        version = self.options.get("version")
        files = listed(fs, root, None if version is None else int(version))
        if files is None:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            return [File(f.path) for f in found if re.search(r"[.]warc([.]gz)?$", f.path)]
        if self.hosts is not None:
            mine = {bucket(h) for h in self.hosts}
            files = [f for f in files if int(re.match(r"b(\d+)-", f)[1]) in mine]
        return [File(f"{root}/{f}") for f in files]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        fs, _ = opened(self.options["path"])
        schema, rows, size = to_arrow_schema(self.schema), [], 0
        names = [f.name for f in self.schema]
        with fs.open_input_stream(partition.path, compression=None) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else io.BufferedReader(raw)
            for host, row, weight in self.parse(stream, self.hosts, self.options):
                if self.hosts is None or host in self.hosts:
                    rows.append(row)
                    size += weight
                if len(rows) >= ROWS or size >= BYTES:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema)


class Writer(DataSourceArrowWriter):
    """Writes rows as `coded(row)` says, which gives (host, bytes), at least `member` bytes to a gzip member."""

    def __init__(self, options: dict, overwrite: bool, suffix: str, coded, member: int):
        self.options, self.overwrite, self.suffix, self.coded, self.member = options, overwrite, suffix, coded, member

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.options["path"])
        fs.create_dir(root, recursive=True)
        task, out, waiting = uuid.uuid4().hex, {}, {}
        name = lambda b: f"b{b:02d}-{task}.{self.suffix}.gz"

        def put(b: int) -> None:
            if b not in out:
                out[b] = fs.open_output_stream(f"{root}/{name(b)}", compression=None)
            out[b].write(gzip.compress(bytes(waiting.pop(b)), 6))

        for batch in iterator:
            for row in batch.to_pylist():
                host, data = self.coded(row)
                held = waiting.setdefault(b := bucket(host), bytearray())
                held += data
                if len(held) >= self.member:
                    put(b)
        for b in list(waiting):
            put(b)
        for f in out.values():
            f.close()
        return Written([name(b) for b in out])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.options["path"])
        fs.create_dir(root, recursive=True)
        new = [f for m in messages if m for f in m.files]
        old = [] if self.overwrite else listed(fs, root) or []
        draft = f"{root}/_draft-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps(old + new).encode())
        fs.move(draft, f"{root}/_files-{max(versions(fs, root), default=0) + 1:09d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.options["path"])
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f}")


# --- pages


def host_of(url: str | None) -> str | None:
    """Lower-case authority of an address, as `quern.functions.url.domain` gives it."""
    if url is None:
        return None
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url)
    return m[1].lower() if m else ""


def _headers(stream) -> dict[str, str] | None:
    """Header lines up to an empty one, names in lower case; None at the end. The first line is under ''."""
    out: dict[str, str] = {}
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            if out:
                return out
            continue  # empty lines between records
        text = line.decode("utf-8", "replace")
        if not out:
            out[""] = text
        else:
            name, _, value = text.partition(":")
            out[name.strip().lower()] = value.strip()
    return out or None


class _Limited:
    """The next `n` bytes of a stream."""

    def __init__(self, stream, n: int):
        self.stream, self.left = stream, n

    def readline(self) -> bytes:
        line = self.stream.readline(self.left) if self.left else b""
        self.left -= len(line)
        return line

    def read(self, n: int) -> bytes:
        data = self.stream.read(min(n, self.left))
        self.left -= len(data)
        return data

    def skip(self) -> None:
        while self.left and self.read(1 << 20):
            pass


def page_records(stream, hosts, options) -> Iterator[tuple]:
    """(host, row, bytes) of each response in a WARC stream."""
    most = int(options.get("max_bytes", MAX_PAGE))
    while head := _headers(stream):
        block = _Limited(stream, int(head.get("content-length", 0)))
        url = head.get("warc-target-uri")
        url = url and url.strip("<>")
        host = host_of(url)
        if head.get("warc-type") == "response" and (hosts is None or host in hosts):
            row = {"url": url, "host": host, "status": "success"}
            m = re.fullmatch("<urn:quern:page:(-?[0-9]+)>", head.get("warc-record-id", ""))
            row["page_id"] = m and int(m[1])
            if at := head.get("warc-date"):
                row["fetched_at"] = datetime.fromisoformat(at.replace("Z", "+00:00")).astimezone(timezone.utc)
            http = _headers(block) if block.left else None
            if http:
                words = http[""].split()
                row["status_code"] = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
                row["content_type"] = http.get("content-type")
                if max(block.left, int(http.get("content-length", 0)) if http.get("content-length", "").isdigit() else 0) > most:
                    row["status"] = "error_content_too_large"
                else:
                    row["html"] = block.read(block.left).decode("utf-8", "replace")
            yield host, row, len(row.get("html") or "")
        block.skip()


def page_bytes(row: dict) -> tuple[str | None, bytes]:
    """A page as a WARC record. A null html is a record without a response."""
    at, html, url = row.get("fetched_at"), row.get("html"), row.get("url")
    block = b""
    if html is not None:
        body = html.encode()
        block = f"HTTP/1.1 {row.get('status_code') or 200} -\r\nContent-Type: {row.get('content_type') or 'text/html'}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    lines = ["WARC/1.1", "WARC-Type: response"]
    if url is not None:
        if re.search("[\r\n]", url):
            raise ValueError("an address with a line break can't be stored")
        lines.append(f"WARC-Target-URI: {url}")
    if row.get("page_id") is not None:
        lines.append(f"WARC-Record-ID: <urn:quern:page:{row['page_id']}>")
    if at is not None:
        lines.append(f"WARC-Date: {at.astimezone(timezone.utc).isoformat().replace('+00:00', 'Z')}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return host_of(url), "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class PagesSource(DataSource):
    """Options: path, version (of a folder written by this source), max_bytes (a longer page has a status and no html)."""

    @classmethod
    def name(cls) -> str:
        return "quern_pages"

    def schema(self) -> str:
        return "page_id long, url string, host string, fetched_at timestamp, status_code int, content_type string, html string, status string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options), schema, "host", page_records)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(dict(self.options), overwrite, "warc", page_bytes, 1)


# --- the frontier


def frontier_records(stream, hosts, options) -> Iterator[tuple]:
    for line in stream:
        row = json.loads(line)
        yield row.get("domain"), row, len(line)


def frontier_bytes(row: dict) -> tuple[str | None, bytes]:
    return row.get("domain"), json.dumps(row, ensure_ascii=False).encode() + b"\n"


class FrontierSource(DataSource):
    """Options: path, version. A version is the frontier as one commit left it."""

    @classmethod
    def name(cls) -> str:
        return "quern_frontier"

    def schema(self) -> str:
        return "url string, norm_url string, domain string, depth int, priority double, score double, state string, attempts int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options), schema, "domain", frontier_records)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(dict(self.options), overwrite, "jsonl", frontier_bytes, 1 << 20)


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session and lets filters reach them."""
    spark.conf.set(PUSHDOWN, "true")
    for source in (PagesSource, FrontierSource):
        spark.dataSource.register(source)
