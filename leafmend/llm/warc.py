"""WARC archives with a two-level capture index.

Pages become WARC 1.1 records, each its own gzip member, in archive files. The
index sorts all captures by reversed-host key into shards; a shard is a file of
compressed blocks of index lines with a sparse directory, one line a block, at
its end. A look-up finds its shards by their first keys, searches the shard's
directory by halves, reads the blocks it names and then only the records' bytes.

Files lie in the shared folder and are read and written through pyarrow's file
systems, so a range is a range on a disk or in a store. A file counts only if a
table that Spark's committer has written names it: what a lost or repeated task
leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, kept, new_path

#: Payloads from this many bytes on are kept once; an archive is closed beyond ARCHIVE bytes.
LEAST, ARCHIVE = 100, 1 << 30
#: Index lines a block, and captures a shard when there are enough of them.
BLOCK, SHARD = 512, 1_000_000
#: Bytes of records that a task reads back.
PART = 128 << 20
#: Ranges closer than GAP are read at once, up to READ bytes.
GAP, READ = 1 << 16, 8 << 20
#: Records carry no fetch time here, so all have the same.
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "key string, page_id long, url string, file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: Column) -> Column:
    """The reversed-host key of a URL: `com,example)/path?query`.

    The host is lower-cased and reversed, its leading www, user and default
    port dropped; scheme and fragment play no part. White space and control
    characters in what follows are percent-encoded as a space. No host: the
    whole text after `)`. Null: the empty key.
    """
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^(?i)[a-z][a-z0-9+.-]*:", "")
    host = F.regexp_extract(rest, r"^//(?:[^/?@]*@)?([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r":(80|443)?$", ""), r"^www\d*\.", "")
    host, port = F.regexp_replace(host, r":\d+$", ""), F.regexp_extract(host, r":\d+$", 0)
    path = F.regexp_replace(F.regexp_replace(rest, r"^//[^/?]*", ""), r"[\x00-\x20\x7F]", "%20")
    reversed_host = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port)
    return F.when(url.isNull(), F.lit("")).otherwise(F.concat(F.regexp_replace(reversed_host, r"[\x00-\x20\x7F]", "%20"), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path)))


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path on it."""
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same for the same page, URL and payload, so that writing again changes nothing."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(json.dumps([page_id, url, digest]).encode()).hexdigest()[:32])}>"


def header_url(url: str) -> str:
    """A URL that fits in a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: tuple[int | None, str | None] | None) -> bytes:
    """One WARC record, uncompressed: a response with its payload, or (first given) a revisit that names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {header_url(url or '')}"] * (url is not None) + [f"X-Page-ID: {page_id}"] * (page_id is not None)
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if first:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(*first, digest)}", f"X-Refers-To-Page-ID: {first[0]}"]
        head += [f"WARC-Refers-To-Target-URI: {header_url(first[1] or '')}"] * (first[1] is not None)
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers with lower-case names, HTTP head, payload) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit its bytes")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def told_apart(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, bytes, digest, first): first is the page that a revisit refers to, null for a response.

    Of equal payloads (by SHA-256) of at least LEAST bytes the row with the
    smallest page_id is the response; rows that repeat that id are too. A null
    page_id is never the smallest: it refers to the smallest id there is, and
    is a response where there is none. Only digests that occur twice are
    joined; a digest of any number of rows is one row on the other side.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    long_ = rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    twice = long_.where("n > 1 AND first IS NOT NULL").select("digest", "first")
    out = rows.join(twice, "digest", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    return out.select("page_id", "url", "payload", "bytes", "digest", F.when(F.col("first").isNotNull(), first).alias("first"))


def write_archives(pages: DataFrame, folder: str, archive: int = ARCHIVE) -> None:
    """Write a record for every row of pages to archive files below folder, and the table of captures beside them.

    pages: page_id, url and html, other columns ignored; a null html is an
    empty payload. An empty table writes no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = place(folder)
        out, name, at, rows = None, None, 0, []

        def closed() -> pa.RecordBatch:
            nonlocal rows
            columns = list(zip(*rows, strict=True))
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "url", "file", "offset", "length"])

        try:
            for b in batches:
                for key, page_id, url, payload, size, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        system.create_dir(f"{path}/archives", recursive=True)
                        name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = deflate.compress(record(page_id, url, payload, size, digest, (first["page_id"], first["url"]) if first else None)) + deflate.flush()
                    out.write(member)
                    rows.append((key, page_id, url, name, at, len(member)))
                    at += len(member)
                    if at >= archive:
                        out.close()
                        out = None
                if rows:
                    yield closed()
        finally:
            if out is not None:
                out.close()

    named = told_apart(pages).select(url_key(F.col("url")).alias("key"), "page_id", "url", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "bytes", "digest", "first")
    named.mapInArrow(run, CAPTURES).write.parquet(f"{folder}/captures")


def build_index(spark: SparkSession, folder: str, block: int = BLOCK, shard: int = SHARD) -> None:
    """Sort the captures of folder into index shards; the table of shards has each one's file, first and last key.

    Shards are ranges of (key, file, offset), so captures of one URL may fill
    many. Their number follows the captures', at least one. The table of shards,
    a row for each, is one file: look-ups hold it whole anyway, and a file for
    each shard would cost more than its row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = place(folder)
        name, out, at, directory, lines, first, last, n = f"index/{uuid.uuid4().hex}.cdx", None, 0, [], [], None, None, 0

        def flushed() -> None:
            nonlocal at, lines
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(packed)
            directory.append((lines[0][0], at, len(packed), len(lines)))
            at, lines = at + len(packed), []

        for b in batches:
            for entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    system.create_dir(f"{path}/index", recursive=True)
                    out, first = system.open_output_stream(f"{path}/{name}", compression=None), entry[0]
                lines.append(entry)
                last, n = entry[0], n + 1
                if len(lines) == block:
                    flushed()
        if out is None:
            return
        if lines:
            flushed()
        packed = zlib.compress(json.dumps(directory).encode())
        out.write(packed + len(packed).to_bytes(8, "little"))
        out.close()
        values = (name, first, last, n, at + len(packed) + 8)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if i < 3 else pa.int64()) for i, v in enumerate(values)], names=["shard", "first", "last", "captures", "bytes"])

    captures = spark.read.schema(CAPTURES).parquet(f"{folder}/captures")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // shard))
    order = ["key", "file", "offset"]
    sorted_ = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_.mapInArrow(run, SHARDS).repartition(1).write.parquet(f"{folder}/shards")


SHARDS = "shard string, first string, last string, captures long, bytes long"


class Shard:
    """One shard's directory, and blocks of lines by its halves."""

    def __init__(self, folder: str, name: str, size: int):
        system, path = place(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        tail = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.file.read_at(tail, size - 8 - tail)))
        self.firsts = [d[0].encode() for d in self.directory]
        self.read = 0  # blocks so far
        self.held: tuple[int, list] | None = None

    def block(self, i: int) -> list:
        if self.held is None or self.held[0] != i:
            _, at, size, _ = self.directory[i]
            self.held = i, [json.loads(x) for x in zlib.decompress(self.file.read_at(size, at)).split(b"\n")]
            self.read += 1
        return self.held[1]

    def captures(self, key: str) -> Iterator[list]:
        """The lines of a key: the first block that may hold it is the one before the first that begins with it."""
        k = key.encode()
        for i in range(max(0, bisect_left(self.firsts, k) - 1), bisect_right(self.firsts, k)):
            lines = self.block(i)
            firsts = [x[0].encode() for x in lines]
            yield from lines[bisect_left(firsts, k) : bisect_right(firsts, k)]


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The captures (CAPTURES) of the distinct values of keys' column key; nulls and unknown keys have none.

    The table of shards, a row for each of up to SHARD captures, is what a task
    holds to choose shards; a key that fills several is looked up in each, so
    no task reads more of one key than its shard has.
    """
    shards = sorted(((r["first"].encode(), r["last"].encode(), r["shard"], r["bytes"]) for r in spark.read.schema(SHARDS).parquet(f"{folder}/shards").collect()))
    firsts, lasts = [s[0] for s in shards], [s[1] for s in shards]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for key in b.column(0).to_pylist():
                k = key.encode()
                found += [(key, i) for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], names=["key", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for b in batches:
            rows = []
            for key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != at:
                    at, shard = i, Shard(folder, shards[i][2], shards[i][3])
                rows += shard.captures(key)
                if len(rows) >= 10_000:
                    yield _captured(rows)
                    rows = []
            yield _captured(rows)

    places = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct().mapInArrow(chosen, "key string, shard long")
    return places.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(read, CAPTURES)


def _captured(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "page_id", "url", "file", "offset", "length"])


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) at the captures' places, their digests checked; a revisit's payload is null, its size and digest those of the full one.

    Captures are dealt to ranges of (file, offset) by the records' bytes, so
    that neighbours in an archive are read at once; captures is read twice.
    payloads=False leaves the payload null.
    """
    whole = captures.agg(F.sum("length")).first()[0] or 0
    parts = max(-(-whole // PART), min(whole // (PART >> 6) + 1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = place(folder)
        name, file = None, None
        for b in batches:
            urls, files, offsets, lengths = (b.column(i).to_pylist() for i in range(4))
            i = 0
            while i < len(files):
                j, end = i + 1, offsets[i] + lengths[i]
                while j < len(files) and files[j] == files[i] and 0 <= offsets[j] - end <= GAP and offsets[j] + lengths[j] - offsets[i] <= READ:
                    end, j = offsets[j] + lengths[j], j + 1
                if files[i] != name:
                    if file is not None:
                        file.close()
                    name, file = files[i], system.open_input_file(f"{path}/{files[i]}")
                raw = memoryview(file.read_at(end - offsets[i], offsets[i]))
                rows = []
                for k in range(i, j):
                    at = offsets[k] - offsets[i]
                    rows.append(_row(urls[k], bytes(raw[at : at + lengths[k]]), payloads))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROW_TYPES, strict=True)], names=ROW_NAMES)
                i = j
        if file is not None:
            file.close()

    dealt = captures.select("url", "file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORDS)


ROW_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
ROW_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())


def _row(url: str | None, member: bytes, payloads: bool) -> tuple:
    head, http, payload = parsed(member)
    number = lambda name: int(head[name]) if name in head else None
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return number("x-page-id"), url, size, digest, "revisit", number("x-refers-to-page-id"), None
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} isn't what was written")
    return number("x-page-id"), url, len(payload), digest, "response", None, payload if payloads else None


def digest(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, read back from new archives through their index.

    A row for each row of pages, repeated ones too. The archives are deleted
    once the rows are read.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(pages, folder)
    build_index(spark, folder)
    found = lookup(spark, folder, pages.select(url_key(F.col("url").cast("string")).alias("key"))).persist(StorageLevel.DISK_ONLY)  # else the ranges' sample would look all up again
    out = kept(read_records(found, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    found.unpersist()
    dropped(spark, folder)
    return out


#: The same in DuckDB's SQL, without archives.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes::BIGINT AS payload_bytes, d.payload_digest,
  CASE WHEN f.first IS NULL OR f.first IS NOT DISTINCT FROM d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first IS DISTINCT FROM d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
