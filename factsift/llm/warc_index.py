"""WARC archives with a two-level capture index (operator 3).

Writing: every page is one record in its own gzip member. Of records with equal
payloads the one of smallest page_id is a ``response``, the others are
``revisit`` records that name it and carry no payload.

Index, two levels: captures are sorted by reversed-host URL key (``com,example)/path
page``) over range partitions; each partition writes one file of compressed
blocks of ``BLOCK_LINES`` lines and, behind them, a sparse directory with each
block's first key and place. A manifest has each file's first key.

Reading: lookups are sorted like the index. A lookup binary-searches the
manifest for the file, the file's directory for the block, the block for the
line, and reads the record's byte range from the archive. Only one block and
one directory are held at a time.

Null html is an empty payload. A null url has the empty key; a null page_id is
written as ``-`` and is never the one referred to unless all pages of that
payload lack one (then all are responses). Rows with equal page_id and payload
are captures of their own, of the same type. Empty tables give no files and no
rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift.llm import common

BLOCK_LINES = 1_000
FILE_BYTES = 256 << 20
LEAST_BYTES = 0            # smaller payloads are never revisits
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + page)}>"


def url_key(url: str | None, page: str) -> str:
    """Reversed host, then path and query, then the page: the sort key."""
    if not url:
        return f" {page}"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
        port = parts.port
    except ValueError:
        return f"{quote(url, safe=':/?&=%,;@+')} {page}"
    if host.startswith("www."):
        host = host[4:]
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    path = quote(parts.path or "/", safe="/%:@&=+$,;~!*'()")
    query = "?" + quote(parts.query, safe="/%:@&=+$,;~!*'()?") if parts.query else ""
    return f"{key}){path}{query} {page}"


def build_record(page: str, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """One WARC record, gzipped on its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"Page-ID: {page}"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    data = zlib.decompress(member, wbits=31)
    cut = data.index(b"\r\n\r\n")
    version, *lines = data[:cut].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines)
    block = data[cut + 4:cut + 4 + int(warc["Content-Length"])]
    cut = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])
    return warc, http, block[cut + 4:]


# ---- writing --------------------------------------------------------------------
CAPTURES = "key string, page string, uri string, at long, length long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; the stored captures ``(key, page, uri, at, length)``."""
    common.prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # one small row per payload; the pages of a frequent payload are combined
    # before the shuffle here, and the join below can be split
    first = (rows.where(F.octet_length("html") >= LEAST_BYTES).groupBy("sha")
             .agg(F.min("page_id").alias("first")))
    typed = rows.join(first, "sha", "left").select(
        "page_id", "url", "html",
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        task, no, out, at = TaskContext.get(), 0, None, 0
        found: list[tuple] = []
        for b in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    uri = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{no}.warc.gz"
                    fs, path = common.open_fs(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, at, no = fs.open_output_stream(path, compression=None), 0, no + 1
                name = "-" if page is None else str(page)
                payload = html.encode()
                record = build_record(name, url, payload, digest(payload), None if refers is None else str(refers))
                out.write(record)
                found.append((url_key(url, name), name, uri, at, len(record)))
                at += len(record)
        if out is not None:
            out.close()
        for lo in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found[lo:lo + 10_000])],
                                             names=["key", "page", "uri", "at", "length"])

    return common.store(typed.mapInArrow(write, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str) -> list[dict]:
    """Write the sorted index; the manifest ``uri, size, first, last``, one row a file."""
    spark = captures.sparkSession

    def write(batches):
        task, lines, out, at = TaskContext.get(), [], None, 0
        directory: list[list] = []
        uri = f"{folder}/index-{task.partitionId():06d}-{task.taskAttemptId()}.cdx"
        first = last = None

        def flush():
            nonlocal at, lines
            block = gzip.compress("\n".join(lines).encode(), compresslevel=4, mtime=0)
            directory.append([lines[0].split("\t", 1)[0], at, len(block)])
            out.write(block)
            at += len(block)
            lines = []

        for b in batches:
            for key, page, place, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs, path = common.open_fs(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, first = fs.open_output_stream(path, compression=None), key
                last = key
                lines.append(f"{key}\t{json.dumps([page, place, offset, length])}")
                if len(lines) >= BLOCK_LINES:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        footer = gzip.compress(json.dumps(directory).encode(), compresslevel=4, mtime=0)
        out.write(footer + struct.pack("<Q", len(footer)))
        out.close()
        yield pa.RecordBatch.from_pylist([{"uri": uri, "size": at + len(footer) + 8, "first": first, "last": last}])

    ordered = (captures.repartitionByRange(common.shuffle_partitions(spark), "key", "uri", "at")
               .sortWithinPartitions("key", "uri", "at"))
    manifest = common.store(ordered.mapInArrow(write, "uri string, size long, first string, last string"), "index-manifest")
    # one row per index file, as many as partitions
    return [r.asDict() for r in manifest.orderBy("first", "last", "uri").collect()]


# ---- reading --------------------------------------------------------------------
@lru_cache(maxsize=2)
def _directory(uri: str, size: int) -> list[list]:
    fs, path = common.open_fs(uri)
    with fs.open_input_file(path) as f:
        (n,) = struct.unpack("<Q", f.read_at(8, size - 8))
        return json.loads(gzip.decompress(f.read_at(n, size - 8 - n)))


@lru_cache(maxsize=2)
def _block(uri: str, at: int, length: int) -> tuple[list[str], list[str]]:
    fs, path = common.open_fs(uri)
    with fs.open_input_file(path) as f:
        lines = gzip.decompress(f.read_at(length, at)).decode().split("\n")
    return [x.split("\t", 1)[0] for x in lines], lines


def lookup(manifest: list[dict], key: str):
    """All captures of a key: ``[page, uri, at, length]`` each."""
    firsts = [m["first"] for m in manifest]
    k = max(0, bisect.bisect_left(firsts, key) - 1)
    while k < len(manifest) and manifest[k]["first"] <= key:
        if manifest[k]["last"] >= key:
            directory = _directory(manifest[k]["uri"], manifest[k]["size"])
            d = max(0, bisect.bisect_left(directory, key, key=lambda x: x[0]) - 1)
            while d < len(directory) and directory[d][0] <= key:
                keys, lines = _block(manifest[k]["uri"], directory[d][1], directory[d][2])
                i = bisect.bisect_left(keys, key)
                while i < len(keys) and keys[i] == key:
                    yield json.loads(lines[i].split("\t", 1)[1])
                    i += 1
                d += 1
        k += 1


class Archives:
    """Range reads from archive files; a few stay open."""

    def __init__(self):
        self.open: dict[str, object] = {}

    def read(self, uri: str, at: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            fs, path = common.open_fs(uri)
            self.open[uri] = fs.open_input_file(path)
        return self.open[uri].read_at(length, at)


CAPTURED = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(wanted: DataFrame, manifest: list[dict]) -> DataFrame:
    """The records of the pages in ``wanted(page_id, url)``, through the index."""
    spark = wanted.sparkSession
    common.prepare(spark)

    def keys(batches):
        for b in batches:
            pages = ["-" if p is None else str(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([url_key(u, p) for u, p in zip(b.column(1).to_pylist(), pages)], type=pa.string())], names=["key"])

    def read(batches):
        archives = Archives()
        for b in batches:
            out = []
            for key in b.column(0).to_pylist():
                for page, uri, at, length in lookup(manifest, key):
                    warc, http, payload = parse_record(archives.read(uri, at, length))
                    stated = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = warc["WARC-Type"]
                    if warc["Page-ID"] != page or kind == "response" and digest(payload) != stated:
                        raise ValueError(f"{uri}: the record at {at} is not the one indexed")
                    refers = warc.get("Refers-To-Page-ID")
                    out.append((None if page == "-" else int(page), warc.get("WARC-Target-URI"),
                                int(http["Content-Length"]) if kind == "revisit" else len(payload),
                                stated, kind, None if refers is None else int(refers)))
            if out:
                columns = list(zip(*out))
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, types)],
                    names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    requests = (wanted.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(keys, "key string")
                .distinct().repartitionByRange(common.shuffle_partitions(spark), "key").sortWithinPartitions("key"))
    return requests.mapInArrow(read, CAPTURED)


def archive(pages: DataFrame) -> tuple[str, list[dict]]:
    """Write archives and index of ``pages`` to a fresh shared folder: folder, manifest."""
    folder = common.shared_uri(pages.sparkSession, "warc")
    return folder, write_index(write_archives(pages, folder), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every page's record, read back through the index."""
    pages = common.table(spark, sf_dir, "pages")
    _, manifest = archive(pages)
    return read_captures(pages, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
