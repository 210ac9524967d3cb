"""WARC archives with a two-level capture index.

Pages are written as WARC records, each a gzip member of its own, one archive file per input partition. Pages whose
payloads are equal are written once; the others become revisit records that refer to it. The index sorts captures by
a key of the reversed host and the path, so that a site's captures lie together: it is written in ranges of keys, each
a file of compressed blocks of lines and a file with its sparse directory, the blocks' first keys and places. A lookup
finds the range among the ranges' first keys, the block in its directory and the line in the block, each by bisection,
and reads only that directory, that block and the record. The list of ranges has a row for each task that wrote some, and goes to all tasks;
directories and blocks are read where they are needed. Pages are looked up in the order of their keys, on all executors.

Only digests and places are dealt to find equal payloads; which page a page refers to is looked up by place, so
that no payload is shuffled.

Files have names of their own for every task attempt and only those in the materialised manifest are read, so tasks
that run again leave nothing wrong. Files go through Arrow's file systems to the shared folder.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlume.llm.common import free_name, located, looked_up, materialize, remove, scratch

MIN_BYTES = 0
BLOCK_LINES = 3_000
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("3f2a7a0e-58c4-5d1b-9a52-8f2f6b0c9d11")
_CRLF = b"\r\n"
_MANIFEST = "page_id long, url string, key string, record_type string, digest string, file string, offset long, length long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Sort key with the host reversed: ``https://m.a.example.com:80/x?q`` gives ``com,example,a,m)/x?q``."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){path.lower()}"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, not compressed. A revisit keeps the HTTP head, with the length of the whole payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    names = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_uri(page_id)}>"), ("WARC-Date", date)]
    if url is not None:
        names.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    names.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        names += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_uri(refers_to)}>"), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        names.append(("X-Page", str(page_id)))
    names += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in names)]).encode("utf-8", "surrogatepass")
    return lines + _CRLF * 2 + block + _CRLF * 2


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record; names are in lower case."""

    def headers(raw: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in raw.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        return {k.lower(): v.strip() for k, _, v in pairs}

    head, _, rest = record.partition(_CRLF * 2)
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    own = headers(head)
    block = rest[: int(own["content-length"])]
    if len(block) != int(own["content-length"]) or rest[len(block) :] != _CRLF * 2:
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(_CRLF * 2)
    return own, headers(http), payload


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, date: str = DATE,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives; gives the manifest: one row per record with its key, file, offset and length."""
    own = (F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    if located(pages) is None:
        pages, _ = materialize(pages.select(F.col(id_col), F.col(url_col), F.col(html_col)), "pages")
    sums, sums_at = materialize(located(pages, own[0], F.sha1(own[2]).alias("sum"), F.length(own[2]).alias("size")).where(F.col("size") >= min_bytes).drop("size"), "sums")
    many, many_at = materialize(sums.groupBy("sum").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select("sum", "refers_to"), "payloads")
    places = sums.join(many, "sum").where("not page_id <=> refers_to").select("file", "pos", "refers_to")
    as_ = free_name(pages, "found")
    found = looked_up(pages, places, ("refers_to",), as_)
    todo = (found if found is not None else pages).select(*own, (F.col(as_)["refers_to"] if found is not None else F.lit(None).cast("long")).alias("refers_to"))
    remove(pages.sparkSession, sums_at, many_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        name, out, offset = None, None, 0
        try:
            for b in batches:
                rows: list[tuple] = []
                for page_id, url, payload, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                    if out is None:
                        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(name, compression=None)
                    payload = payload.as_py()
                    digest = sha1_base32(payload)
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = z.compress(build_record(page_id, url, payload, digest, refers, date)) + z.flush()
                    out.write(member)
                    rows.append((page_id, url, url_key(url), "response" if refers is None else "revisit", digest, name.rpartition("/")[2], offset, len(member)))
                    offset += len(member)
                cols = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (0, 6, 7) else pa.string()) for k, c in enumerate(cols)], [c.split()[0] for c in _MANIFEST.split(", ")])
        finally:
            if out is not None:
                out.close()

    manifest, _ = materialize(todo.mapInArrow(run, _MANIFEST), "manifest")
    return manifest


def write_index(manifest: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts captures into ranges of compressed blocks; gives the list of ranges (key, page_id, file, blocks), a row for each task with captures."""
    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "file", "offset"]  # captures of one very common URL are split, too
    names = ["key", "page_id", "file", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        name, out, at = f"{uuid.uuid4().hex}", None, 0
        lines: list[str] = []
        first: tuple = ()
        blocks: list[list] = []

        def close() -> None:
            nonlocal out, at, lines
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}.idx", compression=None)
            raw = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
            out.write(raw)
            blocks.append([*first, at, len(raw)])
            at, lines = at + len(raw), []

        try:
            for b in batches:
                for row in zip(*(b.column(k).to_pylist() for k in range(8))):
                    page_id, url, key, kind, digest, file, offset, length = row
                    if not lines:
                        first = (key, page_id)
                    lines.append(f"{json.dumps(key)}\t{json.dumps([page_id, url, kind, digest, file, offset, length])}")
                    if len(lines) >= block_lines:
                        close()
            if lines:
                close()
        finally:
            if out is not None:
                out.close()
        if blocks:
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(blocks).encode()))
            row = (*blocks[0][:2], name, len(blocks))
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k in (0, 2) else pa.int64()) for k, v in enumerate(row)], names)

    ranged = manifest.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranges, _ = materialize(ranged.mapInArrow(run, "key string, page_id long, file string, blocks long"), "ranges")
    return ranges


def read_range(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def _order(key: str, page_id: int | None) -> tuple:
    return key, page_id is not None, page_id or 0


class CaptureIndex:
    """Lookups by bisection: in the list of ranges, in a range's directory, in a block. Keeps the directories and blocks read last."""

    def __init__(self, folder: str, ranges: list[tuple]) -> None:
        self.folder = folder
        self.fs, self.base = open_fs(folder)
        self.ranges = sorted((_order(r[0], r[1]), r[2]) for r in ranges)
        self.reads = 0  # of blocks
        self._directory = functools.lru_cache(8)(self._read_directory)
        self._block = functools.lru_cache(8)(self._read_block)

    def _read_directory(self, name: str) -> list[tuple]:
        with self.fs.open_input_file(f"{self.base}/{name}.dir") as f:
            return [(_order(k, i), at, n) for k, i, at, n in json.loads(zlib.decompress(f.read()))]

    def _read_block(self, name: str, offset: int, length: int) -> list[tuple]:
        """The lines (order, [page_id, url, record_type, digest, file, offset, length]) of one block."""
        self.reads += 1
        raw = zlib.decompress(read_range(self.fs, f"{self.base}/{name}.idx", offset, length)).decode("utf-8", "surrogatepass")
        pairs = (line.partition("\t") for line in raw.split("\n"))
        lines = ((json.loads(k), json.loads(v)) for k, _, v in pairs)
        return [(_order(k, v[0]), v) for k, v in lines]

    def _between(self, lo: tuple, hi: tuple) -> Iterator[list]:
        """The lines from lo to hi, both included."""
        first = itemgetter(0)
        r = max(0, bisect.bisect_left(self.ranges, lo, key=first) - 1)
        while r < len(self.ranges) and self.ranges[r][0] <= hi:
            name = self.ranges[r][1]
            blocks = self._directory(name)
            b = max(0, bisect.bisect_left(blocks, lo, key=first) - 1)
            while b < len(blocks) and blocks[b][0] <= hi:
                lines = self._block(name, *blocks[b][1:])
                yield from (v for _, v in lines[bisect.bisect_left(lines, lo, key=first) : bisect.bisect_right(lines, hi, key=first)])
                b += 1
            r += 1

    def find(self, key: str, page_id: int | None) -> list[list]:
        """The index lines of the captures of a page under a key."""
        own = _order(key, page_id)
        return list(self._between(own, own))

    def lookup(self, url: str) -> list[list]:
        """The index lines of all captures of a URL."""
        key = url_key(url)
        return list(self._between((key, False, -1), (key, True, 1 << 64)))

    def fetch(self, line: list) -> tuple[dict[str, str], dict[str, str], bytes]:
        """The record of an index line: one range read of its archive."""
        return parse_record(zlib.decompress(read_range(self.fs, f"{self.base}/{line[4]}", *line[5:7]), 31))


def captures(requests: DataFrame, folder: str, ranges: DataFrame) -> DataFrame:
    """(file, offset, length) of all captures of the pages in requests(key, page_id), each looked up in the index once."""
    spark = requests.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = [tuple(r) for r in ranges.select("key", "page_id", "file").collect()]  # a row for each task that wrote a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = CaptureIndex(folder, listed), None
        for b in batches:
            rows = []
            for own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own != last:
                    rows += [v[4:7] for v in index.find(*own)]
                    last = own
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k else pa.string()) for k in range(3)], ["file", "offset", "length"])

    dealt = requests.select("key", "page_id").repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return dealt.mapInArrow(run, "file string, offset long, length long")


def read_archives(lines: DataFrame, folder: str) -> DataFrame:
    """One row (page_id, payload_bytes, payload_digest, record_type, refers_to, url) per record that the lines name."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = 64 << 20  # archives are read in pieces of about this size, so that a large one is dealt, too
    piece = F.floor(F.col("offset") / chunk)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        name, f = None, None
        try:
            for b in batches:
                rows = []
                for file, offset, length in zip(*(b.column(k).to_pylist() for k in range(3))):
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f = file, fs.open_input_file(f"{base}/{file}")
                    f.seek(offset)
                    own, http, payload = parse_record(zlib.decompress(f.read(length), 31))
                    digest = own["warc-payload-digest"].removeprefix("sha1:")
                    if own["warc-type"] == "response" and (sha1_base32(payload) != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"the payload of {own['warc-record-id']} differs from its digest")
                    page, refers = own.get("x-page"), own.get("x-refers-to-page")
                    rows.append((page and int(page), int(http["content-length"]), digest, own["warc-type"], refers and int(refers), own.get("warc-target-uri")))
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (0, 1, 4) else pa.string()) for k, c in enumerate(cols)], names)
        finally:
            if f is not None:
                f.close()

    dealt = lines.withColumn("piece", piece).repartition(n, "file", "piece").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, **columns) -> DataFrame:
    """Writes pages to archives and an index in the shared folder, then looks every page up in the index and reads its captures back.

    One row (page_id, payload_bytes, payload_digest, record_type, refers_to, url) per page. A null html is an empty
    payload; pages without a URL have no target header and sort first. Of equal payloads of at least min_bytes the
    smallest page_id is the response; should it repeat, each of its rows is a response. A null page_id is never the
    smallest; payloads with no id at all are responses. An empty table gives no rows; other columns are ignored.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, min_bytes, **columns)
    return read_archives(captures(manifest, folder, write_index(manifest, folder)), folder)
