"""WARC archives of web pages and a two-level capture index over them.

Records are gzip members of their own, so each can be read by its byte range. The
index sorts the captures by reversed-host URL key into compressed blocks; a
sparse directory holds each block's first and last key and byte range. A lookup
bisects the directory, reads one block, and then only the records it names.

Archives are written by the executors through pyarrow's file systems, under names
that no other attempt of the task uses. What counts is only what the committed
index rows name, so a lost executor leaves at most unnamed files.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, broadcast_if_bounded, table

#: Payloads of at least this many bytes are stored once.
MIN_SHARED_BYTES = 100
#: Bytes after which a writer begins its next archive.
ARCHIVE_BYTES = 256 << 20
#: Compressed bytes of records that are read at once.
READ_BYTES = 2 << 20
#: Captures in a block of the index.
BLOCK_LINES = 1000
#: Rows that are broadcast at most: of the revisits, and of the directory in one round of lookups.
REVISIT_ROWS = 200_000
DIRECTORY_ROWS = 200_000

CAPTURES = "key string, file string, offset long, length long, page_id long"
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines int"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def url_key(url: str | None) -> str:
    """The key ``org,example,www)/path?query``; the host in lower case and reversed, no fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return (url or "").strip()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, uncompressed; a revisit when it refers to a page."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {clean}")
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of one uncompressed record; a revisit has no payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"digest mismatch in {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": int(fields["X-Payload-Bytes"]), "payload_digest": digest, "payload": None if revisit else payload}


def with_referrals(pages: DataFrame, scratch: Scratch, min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """``pages`` with ``digest`` and ``refers_to``, the smallest page of an equal payload.

    Payloads shorter than ``min_bytes`` and rows without an id are never revisits.
    Only ids and digests are grouped and joined; the payloads stay where they are
    unless the revisits are too many to broadcast.
    """
    full = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.withColumn("digest", F.sha2(full, 256))
    large = pages.where(F.octet_length(full) >= min_bytes).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.join(first, "digest").where("page_id <> first").distinct()
    revisits = scratch.keep(revisits.select("page_id", "digest", F.col("first").alias("refers_to")), "revisits")
    return pages.join(broadcast_if_bounded(revisits, REVISIT_ROWS), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, scratch: Scratch, name: str = "archives") -> DataFrame:
    """Write a record for each row of ``pages``; returns the captures."""
    base = scratch.path(name)

    def written(batches):
        fs, root = FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        out = path = None
        at = 0
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if out is None:
                    path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                data = gzip.compress(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"]), 6, mtime=0)
                out.write(data)
                rows.append((url_key(r["url"]), path.rpartition("/")[2], at, len(data), r["page_id"]))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "file", "offset", "length", "page_id"), x)) for x in rows], schema=pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64())]))
        if out is not None:
            out.close()

    return scratch.keep(pages.mapInArrow(written, CAPTURES), f"{name}-captures")


def write_index(captures: DataFrame, scratch: Scratch, name: str = "index", lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures by key into compressed blocks; returns the block directory."""
    base = scratch.path(name)
    order = ["key", "file", "offset"]

    def written(batches):
        fs, root = FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        path, at, held, found = f"{root}/{uuid.uuid4().hex}.idx", 0, [], []
        out = None

        def block():
            nonlocal at, out
            out = out or fs.open_output_stream(path, compression=None)
            data = zlib.compress("\n".join(json.dumps([r["key"], r["file"], r["offset"], r["length"], r["page_id"]]) for r in held).encode())
            out.write(data)
            found.append({"first_key": held[0]["key"], "last_key": held[-1]["key"], "file": path.rpartition("/")[2], "offset": at, "length": len(data), "lines": len(held)})
            at += len(data)
            held.clear()

        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                if len(held) == lines:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int32())]))

    ordered = captures.repartitionByRange(*order, "page_id").sortWithinPartitions(*order)
    return scratch.keep(ordered.mapInArrow(written, DIRECTORY), f"{name}-directory")


class Reader:
    """Range reads from the files of one folder."""

    def __init__(self, base: str):
        self.fs, self.root = FileSystem.from_uri(base)
        self.name = self.file = None

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
        return self.file.read_at(length, offset)


def block_lines(reader: Reader, name: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(reader.range(name, offset, length)).decode().split("\n")]


def _records(fields: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(fields, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))


def by_bytes(lines: list[list]):
    """Captures in parts of at most 100 records, or of few bytes."""
    part, size = [], 0
    for x in lines:
        if part and (len(part) == 100 or size + x[3] > READ_BYTES):
            yield part
            part, size = [], 0
        part.append(x)
        size += x[3]
    if part:
        yield part


def read_archives(directory: DataFrame, scratch: Scratch, name: str = "archives", index: str = "index") -> DataFrame:
    """All records, block by block of the index; a block's records are read in file order."""
    base, index_base = scratch.path(name), scratch.path(index)

    def read(batches):
        archives, blocks = Reader(base), Reader(index_base)
        for b in batches:
            for r in b.to_pylist():
                lines = sorted(block_lines(blocks, r["file"], r["offset"], r["length"]), key=lambda x: x[1:4])
                for part in by_bytes(lines):
                    yield _records([parsed(gzip.decompress(archives.range(*x[1:4]))) for x in part])

    # a number of its own, as a block is a short row that stands for many records
    n = max(1, min(directory.count(), 4 * int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return directory.repartition(n, F.xxhash64("file", "offset")).mapInArrow(read, RECORDS)


def located(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """For each row of ``keys (key)`` the blocks that can hold it, by bisection of the directory.

    The directory is broadcast in slices of bounded size, one round for each.
    """
    spark = keys.sparkSession
    slices = [directory]
    if not bounded(directory, DIRECTORY_ROWS):
        n = -(-directory.count() // DIRECTORY_ROWS)
        slices = directory.randomSplit([1.0] * n, seed=1)
    found = None
    for part in slices:
        blocks = spark.sparkContext.broadcast(sorted(map(tuple, part.collect())))

        def bisected(batches, blocks=blocks):
            lasts = [x[1] for x in blocks.value]
            for b in batches:
                hits = []
                for key in b.column(0).to_pylist():
                    at = bisect.bisect_left(lasts, key)
                    while at < len(lasts) and blocks.value[at][0] <= key:
                        hits.append((key, *blocks.value[at][2:5]))
                        at += 1
                columns = list(zip(*hits)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])

        rows = keys.mapInArrow(bisected, "key string, file string, offset long, length long")
        found = rows if found is None else found.unionAll(rows)
    return found


def lookup(urls: DataFrame, directory: DataFrame, scratch: Scratch, name: str = "archives", index: str = "index", nulls: bool = False) -> DataFrame:
    """The records of the captures whose key is that of a row of ``urls (url)``, each once.

    The directory is bisected on the executors; then each block found is read once,
    and of its records those of the keys looked up, in file order. Unknown URLs find
    nothing, and nulls neither, unless ``nulls``: then they find the records without URL.
    """
    base, index_base = scratch.path(name), scratch.path(index)
    wanted = (urls if nulls else urls.where("url IS NOT NULL")).select("url").distinct()

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    def read(batches):
        archives, blocks = Reader(base), Reader(index_base)
        block, keys = None, set()

        def records():
            lines = sorted((x for x in block_lines(blocks, *block) if x[0] in keys), key=lambda x: x[1:4])
            for part in by_bytes(lines):
                yield _records([parsed(gzip.decompress(archives.range(*x[1:4]))) for x in part])

        for b in batches:
            for key, *at in zip(*(c.to_pylist() for c in b.columns)):
                if at != block:
                    if block is not None:
                        yield from records()
                    block, keys = at, set()
                keys.add(key)
        if block is not None:
            yield from records()

    found = located(wanted.mapInArrow(keyed, "key string").distinct(), directory)
    # a number of its own, as a key is a short row that stands for many records
    n = max(1, min(directory.count(), 4 * int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = found.repartition(n, F.xxhash64("file", "offset")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, RECORDS)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Archive every row of ``pages`` and read the archives back by looking up the pages' URLs.

    A null html is an empty payload. Rows that repeat a page are records each.
    """
    scratch = Scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    captures = write_archives(with_referrals(pages, scratch), scratch)
    directory = write_index(captures, scratch)
    return lookup(pages, directory, scratch, nulls=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when f.first is null or f.first = d.page_id then 'response' else 'revisit' end as record_type,
  case when f.first <> d.page_id then f.first end as refers_to
from d left join f on f.payload_digest = d.payload_digest and d.payload_bytes >= 100
"""
