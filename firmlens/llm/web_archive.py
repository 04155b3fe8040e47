"""WARC archives with a two-level capture index.

Pages become WARC records, compressed one by one, in archive files of the shared folder. A page
whose payload an earlier-chosen page already holds becomes a revisit record without payload. The
index has two levels: lines (reversed-host key, page, place of the record) sorted by key and kept in
compressed blocks, and a sparse directory with the first line of each block. Index files hold the
blocks of a range of keys and end with their directory; the first lines of the files, of which there
are at most ``MAX_PARTS`` at any size, go to the tasks that look up. A look-up searches the files'
first lines, the directory and the block by bisection, and reads only byte ranges: the directory,
one block, the records. The op5 query reads every page back this way.

Writers name their files afresh on every attempt and hand over the places of the records; only
files named in the stored lines belong to the archive, so a lost or repeated task does no harm.

Null html is an empty payload. Null or unparsable URLs get the key of an empty host. Equal pages
(repeated rows) with the largest page_id of a payload are all responses. Pages without page_id can
be revisits but never the response of others.
"""
from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.registry import query, table
from firmlens.llm.scratch import folder, stored

#: Lines of an index block, and bytes after which a new archive file begins.
BLOCK_LINES, FILE_BYTES = 2000, 256 << 20
#: Index files at most, so that their first lines are bounded.
MAX_PARTS = 4096
#: Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"


def reversed_host_key(url: Column) -> Column:
    """``com,example,m)/path?query`` for ``http://m.example.com/path?query``; case and fragment do not count."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*", 0), r"^[^@]*@|:[0-9]*$", "")
    rest = F.regexp_replace(plain, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of SHA-1, from the hexadecimal digits: 10 of them are 8 digits of base 32."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_responses(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds payload digest and ``refers_to``, the page whose payload a page repeats (null: none)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    # the digest is computed for either use: a stored copy of the pages would take their whole size on disk again
    told = pages.select(F.col("page_id").cast("bigint"), "url", "html", payload_digest(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("n_bytes"))
    largest = stored(told.filter(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("largest")), "responses")
    return told.join(largest, ["digest", "n_bytes"], "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit names the record that holds its payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}",
                  f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def write_archives(captures: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records and returns (key, page_id, file, start, size), stored. A task begins a new file after ``file_bytes``."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        places, out, name, at = [], None, None, 0
        for batch in batches:
            for key, page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                raw = gzip.compress(record(page_id, url, (html or "").encode(), digest, refers_to), 1, mtime=0)
                out.write(raw)
                places.append((key, page_id, name, at, len(raw)))
                at += len(raw)
                if at >= file_bytes:  # places are handed over only when their file is closed
                    out.close()
                    yield _table(places, LINE)
                    places, out = [], None
        if out is not None:
            out.close()
            yield _table(places, LINE)

    keyed = captures.withColumn("key", reversed_host_key(F.col("url")))
    return stored(keyed.mapInArrow(write, "key string, page_id bigint, file string, start bigint, size bigint"), "lines")


LINE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64())])
PART = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("n_lines", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _place(key: str, page_id: int | None) -> tuple[str, int, int]:
    """Place of a line in the order of the index: by key, then page, pages without id first."""
    return (key, 0, 0) if page_id is None else (key, 1, page_id)


class Index(NamedTuple):
    """Folder of archives and index files, and the parts in order: (first place, file, where its directory starts, its size), ``MAX_PARTS`` at most."""

    path: str
    parts: list[tuple[tuple[str, int, int], str, int, int]]


def build_index(lines: DataFrame, path: str, n_parts: int, block_lines: int = BLOCK_LINES) -> Index:
    """Sorts the lines and writes them as compressed blocks, a file per part, each file ending with its directory.

    The directory holds the first place of every block with its byte range.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        held, out, at, name, directory, n = [], None, 0, f"index-{uuid.uuid4().hex}", [], 0

        def put(rows) -> bytes:
            raw = zlib.compress("\n".join(map(json.dumps, rows)).encode(), 6)
            out.write(raw)
            return raw

        def block(rows) -> int:
            directory.append((rows[0][0], rows[0][1], at, len(raw := put(rows))))
            return at + len(raw)

        for batch in batches:
            held += zip(*(batch.column(f.name).to_pylist() for f in LINE))
            n += batch.num_rows
            if held and out is None:
                store.create_dir(root)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            while len(held) >= block_lines:
                at = block(held[:block_lines])
                held = held[block_lines:]
        if held:
            at = block(held)
        if out is not None:
            size = len(put(directory))
            out.close()
            yield _table([(directory[0][0], directory[0][1], name, at, size, n)], PART)

    # the page splits the lines of one key over several parts
    ordered = lines.select(*[f.name for f in LINE]).repartitionByRange(n_parts, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "start")
    parts = stored(ordered.mapInArrow(write, "key string, page_id bigint, file string, start bigint, size bigint, n_lines bigint"), "parts")
    rows = parts.collect()  # one row per part
    return Index(path, sorted((_place(r["key"], r["page_id"]), r["file"], r["start"], r["size"]) for r in rows))


class Finder:
    """Finds lines: binary search over the parts, in the directory of a part, and in a block, each read by its byte range."""

    def __init__(self, index: Index):
        self.store, self.root = fs.FileSystem.from_uri(index.path)
        self.parts = index.parts
        self.firsts = [p[0] for p in index.parts]
        self.open: tuple[str, object] = ("", None)
        self.last: dict[str, tuple] = {}

    def read(self, name: str, start: int, size: int) -> bytes:
        if self.open[0] != name:
            self.close()
            self.open = (name, self.store.open_input_file(f"{self.root}/{name}"))
        return self.open[1].read_at(size, start)

    def close(self) -> None:
        if self.open[1] is not None:
            self.open[1].close()
        self.open = ("", None)

    def _rows(self, kind: str, name: str, start: int, size: int) -> tuple[list, list]:
        """Rows of a directory or block and their places; the last of each kind is remembered, as look-ups come in order."""
        if kind not in self.last or self.last[kind][:2] != (name, start):
            rows = [json.loads(x) for x in zlib.decompress(self.read(name, start, size)).decode().split("\n")]
            self.last[kind] = (name, start, rows, [_place(r[0], r[1]) for r in rows])
        return self.last[kind][2:]

    def lines(self, low: tuple, high: tuple) -> Iterator[list]:
        """Lines from place ``low`` to place ``high``, both included."""
        p = max(bisect.bisect_left(self.firsts, low) - 1, 0)
        while p < len(self.parts) and self.firsts[p] <= high:
            _, name, start, size = self.parts[p]
            directory, firsts = self._rows("directory", name, start, size)
            b = max(bisect.bisect_left(firsts, low) - 1, 0)
            while b < len(directory) and firsts[b] <= high:
                rows, places = self._rows("block", name, *directory[b][2:])
                yield from rows[bisect.bisect_left(places, low):bisect.bisect_right(places, high)]
                b += 1
            p += 1

    def records(self, lines: list[list]) -> Iterator[tuple]:
        """(page_id, header fields, payload) of lines, in the order of their places in the archives."""
        for _, page_id, name, start, size in sorted(lines, key=lambda x: (x[2], x[3])):
            yield (page_id, *parsed(gzip.decompress(self.read(name, start, size))))


def look_up(index: Index, spark: SparkSession, urls: list[str]) -> list[tuple[dict[str, str], bytes]]:
    """Records of a few URLs, each found by two binary searches and read by its range."""
    asked = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(reversed_host_key(F.col("url"))).collect()]
    finder, found = Finder(index), []
    for key in dict.fromkeys(asked):
        found += [(fields, payload) for _, fields, payload in finder.records(list(finder.lines((key, 0, 0), (key, 2, 0))))]
    finder.close()
    return found


def read_back(index: Index, asked: DataFrame, n_parts: int) -> DataFrame:
    """Records of the asked (key, page_id), looked up in the index: (page_id, record_type, refers_to, digest, payload).

    The asked keys are dealt out by range, so the look-ups of a task stay within few blocks.
    """
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, lines = Finder(index), []

        def taken() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for page_id, fields, payload in finder.records(lines):
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rows.append((page_id, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if revisit else None, digest, payload))
                size += len(payload)
                if size > 16 << 20:
                    yield _table(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _table(rows, schema)

        for batch in batches:
            for key, page_id in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist()):
                place = _place(key, page_id)
                for line in finder.lines(place, place):
                    lines.append(line)
                    if len(lines) >= BLOCK_LINES:
                        yield from taken()
                        lines = []
        yield from taken()
        finder.close()

    dealt = asked.select("key", "page_id").distinct().repartitionByRange(n_parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return dealt.mapInArrow(read, "page_id bigint, record_type string, refers_to bigint, digest string, payload binary")


def archive(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> tuple[Index, DataFrame]:
    """Writes all pages; returns the index and the stored lines (key, page_id, file, start, size)."""
    spark = pages.sparkSession
    path = folder(spark, "warc")
    where = path if "://" in path or path.startswith("file:") else f"file://{_absolute(path)}"
    lines = write_archives(with_responses(pages, min_bytes), where)
    return build_index(lines, where, parts_of(lines.count())), lines


def parts_of(n_lines: int) -> int:
    return min(MAX_PARTS, max(1, -(-n_lines // (4 * BLOCK_LINES))))


def _absolute(path: str) -> str:
    import os
    return os.path.abspath(path)


@query("op5_indexed_archives")
def op5_indexed_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index, lines = archive(pages)
    asked = pages.select(reversed_host_key(F.col("url")).alias("key"), F.col("page_id").cast("bigint").alias("page_id"))
    found = read_back(index, asked, parts_of(lines.count()))
    records = stored(found.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("bigint").alias("n")), "records")
    responses = stored(records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("n").alias("held")), "held")
    return records.join(responses, "refers_to", "left").select(
        "page_id", F.when(F.col("record_type") == "response", F.col("n")).otherwise(F.col("held")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to")
