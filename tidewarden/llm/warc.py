"""WARC archives with a two-level capture index.

Archives are ordinary files of gzip members, one a record, written through Spark's own writer, so that any file system that Spark
reaches will do. An indexer scans them once: lines of reversed-host URL keys are sorted into compressed blocks, and a sparse
directory keeps the first and last key of each block. A lookup sorts the keys it wants, bisects the directory, reads
the blocks' byte ranges, bisects them, and reads the records' byte ranges; all of it inside Spark tasks.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import table_of

ENTRY = "key string, page_id long, url string, file string, offset long, length long"
_ENTRY = [("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
DIRECTORY = "first_key string, first_page long, last_key string, last_page long, file string, offset long, length long"
_DIRECTORY = [
    ("first_key", pa.string()), ("first_page", pa.int64()), ("last_key", pa.string()), ("last_page", pa.int64()),
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
]
CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, body binary, intact boolean, key string"
_CAPTURE = [
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("body", pa.binary()), ("intact", pa.bool_()), ("key", pa.string()),
]


def url_key(url: str | None) -> str:
    """Reversed-host key: ``https://a.b.org:80/p?q`` becomes ``org,b,a:80)/p?q``; without :// the url itself."""
    m = re.match(r"(?s)[^:/?#]*://([^/?#:]*)([^/?#]*)(.*)", url or "")
    if not m:
        return url or ""
    return ",".join(reversed(m[1].lower().split("."))) + m[2] + ")" + m[3]


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit (refers_to given) carries no payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {len(payload)}", f"X-Page-Url: {json.dumps(url)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member, the same for the same bytes."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of a record's gzip member."""
    data = zlib.decompress(raw, 31)
    head, body = data.split(b"\r\n\r\n", 1)
    fields = _fields(head + b"\r\n\r\n")
    return fields, body[: int(fields["Content-Length"])]


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def _members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a file."""
    at, end = 0, len(raw)
    while at < end and raw[at : at + 2] == b"\x1f\x8b":  # the writer's line end may follow the last one
        z = zlib.decompressobj(31)
        content = z.decompress(memoryview(raw)[at:])
        size = end - at - len(z.unused_data)
        yield at, size, content
        at += size


def _rank(page: int | None) -> tuple[bool, int]:
    return page is not None, page or 0


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_revisit: int = 0, file_bytes: int = 4 << 20) -> None:
    """Write every row as a WARC record under path/warc and the index under path/index and path/directory.

    The payload is the body column in UTF-8, null as empty. Of records with equal payloads of at least
    ``least_revisit`` bytes the row with the largest id is the response (each such row, if an id repeats), the others revisit it;
    smaller ones, and rows with a null id, are responses.

    Payload digests are aggregated before they are joined back, on rows of an id and a digest, so a payload that a third of
    the rows share moves no page bodies. Bodies move once, spread by id, digest and url; a task streams its rows into files of about
    ``file_bytes``, so neither an id that many rows share nor a large partition has to fit in memory.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"))
    brief = rows.where(F.col("page_id").isNotNull() & (F.octet_length("body") >= least_revisit)).select("page_id", F.sha1("body").alias("sha"))
    heads = brief.groupBy("sha").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = brief.join(heads, "sha").where("page_id < head").select("page_id", "sha", "head").distinct()
    joined = rows.withColumn("sha", F.sha1("body")).join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "body", "head")

    def build(batches):
        waiting, size = [], 0
        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = member(record(page, url, payload, digest32(payload), refers))
                waiting.append(raw)
                size += len(raw)
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(waiting)], pa.binary())], ["content"])
                    waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(waiting)], pa.binary())], ["content"])

    _write_files(joined.mapInArrow(build, "content binary"), F.col("content"), f"{path}/warc")
    write_index(index_entries(pages.sparkSession, path), path)


def _write_files(rows: DataFrame, content: Column, folder: str) -> None:
    """Each row's bytes as a file of its own."""
    rows.select(content.cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder)


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of the files that _write_files wrote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file"), "content")


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """ENTRY of every record of the archives, by a scan over them; memory is that of a few archive files."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for at, size, data in _members(content):
                    fields = _fields(data)
                    url = json.loads(fields["X-Page-Url"])
                    rows.append((url_key(url), _page(fields["WARC-Record-ID"]), url, file, at, size))
                yield from table_of(_ENTRY, rows).to_batches()

    return _scan(spark, f"{path}/warc").mapInArrow(run, ENTRY)


def write_index(entries: DataFrame, path: str, block_lines: int = 1000, file_bytes: int = 4 << 20) -> None:
    """Sort entries by key into compressed blocks (files under path/index), and write their sparse directory (path/directory), sorted too."""

    def blocks(batches):
        lines, waiting, size = [], [], 0

        def close():
            nonlocal size
            if lines:
                waiting.append(member("\n".join(map(json.dumps, lines)).encode()))
                size += len(waiting[-1])
                lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c, _ in _ENTRY), strict=True):
                lines.append(row)
                if len(lines) == block_lines:
                    close()
                    if size >= file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(waiting)], pa.binary())], ["content"])
                        waiting, size = [], 0
        close()
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(waiting)], pa.binary())], ["content"])

    def directory(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for at, size, data in _members(content):
                    lines = data.split(b"\n")
                    first, last = json.loads(lines[0]), json.loads(lines[-1])
                    rows.append((first[0], first[1], last[0], last[1], file, at, size))
                yield from table_of(_DIRECTORY, rows).to_batches()

    # ties are dealt by page too, so that one key can't fill one range
    ordered = entries.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    _write_files(ordered.mapInArrow(blocks, "content binary"), F.col("content"), f"{path}/index")
    listed = _scan(entries.sparkSession, f"{path}/index").mapInArrow(directory, DIRECTORY)
    listed.repartitionByRange("first_key", "first_page").sortWithinPartitions("first_key", "first_page").write.mode("overwrite").parquet(f"{path}/directory")


class _Store:
    """Ranged reads from a folder that pyarrow's file systems reach (local and shared folders, HDFS, S3, GCS)."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")

    def ranges(self, file: str, wanted: list[tuple[int, int]], gap: int = 1 << 16) -> list[bytes]:
        """The bytes of (offset, length) ranges in ascending order; ranges with less than gap bytes between them are one read."""
        out, k = [], 0
        with self.fs.open_input_file(f"{self.root}/{file}") as f:
            while k < len(wanted):
                lo, hi, to = wanted[k][0], wanted[k][0] + wanted[k][1], k + 1
                while to < len(wanted) and wanted[to][0] - hi < gap and wanted[to][0] + wanted[to][1] - lo < 1 << 23:
                    hi, to = max(hi, wanted[to][0] + wanted[to][1]), to + 1
                raw = f.read_at(hi - lo, lo)
                out += [raw[at - lo : at - lo + n] for at, n in wanted[k:to]]
                k = to
        return out

    def directory(self, low: str, high: str) -> list[tuple]:
        """The directory's rows of blocks that may hold keys from low to high, in order; row groups beyond are not read."""
        import pyarrow.dataset as ds

        found = ds.dataset(f"{self.root}/directory", filesystem=self.fs, format="parquet").to_table(filter=(ds.field("last_key") >= low) & (ds.field("first_key") <= high))
        return sorted(zip(*(found.column(c).to_pylist() for c, _ in _DIRECTORY), strict=True), key=lambda r: (r[0], _rank(r[1]), r[2], _rank(r[3]), r[4], r[5]))


def lookup(spark: SparkSession, path: str, wanted: DataFrame, each: int = 4096) -> DataFrame:
    """CAPTURE of every record of the wanted (key, page_id) pairs; a null page_id that is asked for by ``any_page`` true names all pages of the key.

    wanted: key string, page_id long, any_page boolean. Keys are dealt and sorted by range. A task takes ``each`` of them at a time, bisects the
    directory's part that they span, reads the blocks it names by byte range, bisects them for the keys, and reads the records by byte range.
    Pairs that aren't in the index give no row. Records are parsed and their digests checked.
    """
    ordered = wanted.select("key", "page_id", "any_page").distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def captures(store: _Store, asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        asked = sorted(asked, key=lambda r: (r[0], _rank(r[1])))
        blocks = store.directory(asked[0][0], asked[-1][0])
        lasts = [(b[2], _rank(b[3])) for b in blocks]
        need: dict[tuple[str, int, int], list[tuple]] = {}
        for key, page, any_page in asked:
            low, high = ((key, (False, 0)), (key, (True, 1 << 63))) if any_page else ((key, _rank(page)),) * 2
            at = bisect.bisect_left(lasts, low)
            while at < len(blocks) and (blocks[at][0], _rank(blocks[at][1])) <= high:
                need.setdefault(blocks[at][4:], []).append((low, high))
                at += 1
        records: dict[str, set] = {}
        for file in sorted({b[0] for b in need}):
            mine = sorted(b[1:] for b in need if b[0] == file)
            for (at, size), raw in zip(mine, store.ranges(f"index/{file}", mine), strict=True):
                lines = [json.loads(x) for x in zlib.decompress(raw, 31).split(b"\n")]
                keys = [(x[0], _rank(x[1])) for x in lines]
                for low, high in need[file, at, size]:
                    for k in range(bisect.bisect_left(keys, low), bisect.bisect_right(keys, high)):
                        records.setdefault(lines[k][3], set()).add((lines[k][4], lines[k][5]))
        for file, ranges in sorted(records.items()):
            ordered_ = sorted(ranges)
            for k in range(0, len(ordered_), 256):
                rows = [_capture(raw) for raw in store.ranges(f"warc/{file}", ordered_[k : k + 256])]
                yield from table_of(_CAPTURE, rows).to_batches()

    def run(batches):
        store, waiting = _Store(path), []
        for batch in batches:
            waiting += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(waiting) >= each:
                yield from captures(store, waiting[:each])
                waiting = waiting[each:]
        if waiting:
            yield from captures(store, waiting)

    return ordered.mapInArrow(run, CAPTURE)


def wanted_keys(rows: DataFrame, url_col: str = "url", id_col: str | None = None) -> DataFrame:
    """What lookup() takes, for the urls of rows: the captures of a row's page where id_col is given, else all of its url's."""
    page = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), *batch.columns[1:]], ["key", "page_id", "any_page"])

    return rows.select(F.col(url_col).alias("key"), page.alias("page_id"), F.lit(id_col is None).alias("any_page")).distinct().mapInArrow(run, "key string, page_id long, any_page boolean")


def _fields(data: bytes) -> dict[str, str]:
    head = data[: data.index(b"\r\n\r\n")]
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _capture(raw: bytes) -> tuple:
    fields, body = parse(raw)
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = _page(fields["WARC-Refers-To"]) if revisit else None
    url = json.loads(fields["X-Page-Url"])
    return _page(fields["WARC-Record-ID"]), int(fields["X-Payload-Bytes"]), digest, fields["WARC-Type"], refers, url, body, revisit or digest32(body) == digest, url_key(url)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT body, max(page_id) AS head FROM p GROUP BY body)
SELECT page_id, strlen(body) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha1(body), 1 + 5 * (i // 4), 5))::INT >> (5 * (3 - i % 4))) % 32, 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < head THEN head END AS refers_to
FROM p JOIN h USING (body)
"""
