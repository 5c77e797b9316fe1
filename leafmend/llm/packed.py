"""Token-id output: fixed-width bit packing with block offsets.

A token file is a stretch of documents in ascending doc_id order. Each row of
the table of files is one file's image and its index: ids stand in the fewest
bits that hold the vocabulary, most significant bit first, in blocks of BLOCK
ids that start on byte boundaries, so block i starts at i * BLOCK * bits / 8
and any range of ids is unpacked with numpy from its blocks alone. Images are
written by Spark's own writer, which commits whole tasks and reaches any file
system, so a lost executor leaves no half-written file.

Texts are encoded where they are read; only ids travel. A pass over ids and
sizes of documents finds the bounds of the parts beforehand, so the exchange
needs no sample of the encoded rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, kept, new_path
from .tokens import default_path, encoder

#: Ids of a block, and ids after which a file is closed; a longer document still is whole.
BLOCK, FILE = 1 << 12, 1 << 18
#: Bytes of text of a part: LARGE_PART at most, SMALL_PART at least where the session's shuffle partitions allow.
LARGE_PART, SMALL_PART = 1 << 27, 1 << 22
#: Ranges that bounds are cut at, for each part, and ranges in all, above which a range is a part.
FINE, RANGES = 8, 1 << 14
#: Stands for a null doc_id in the order.
FIRST = -(2**63)
#: Images are large rows: the writer looks at its size after each few of them, not after 100.
WRITER = {"compression": "none", "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 4, "parquet.block.size.row.check.max": 8, "parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 8}
MAGIC = np.frombuffer(b"LMTOK2\0\0", "<u8")[0]
FILE_SCHEMA = "part int, file int, first_doc long, last_doc long, n_docs long, n_ids long, image binary"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as fixed-width numbers of so many bits, most significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), BLOCK):
        x = ids[i : i + BLOCK].astype(np.uint32)
        out.append(np.packbits((x[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32) & 1).astype(np.uint8)).tobytes())
    return b"".join(out)


def unpack(packed: bytes, bits: int, count: int) -> np.ndarray:
    """The inverse of pack, for a run of whole blocks."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f">u{bits // 8}", count).astype(np.uint32)
    width, out = BLOCK * bits // 8, []
    for i in range(0, count, BLOCK):
        n = min(BLOCK, count - i)
        b = np.unpackbits(np.frombuffer(packed, np.uint8, -(-n * bits // 8), i // BLOCK * width), count=n * bits)
        out.append(b.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def image(doc_ids: list[int | None], runs: list[np.ndarray], bits: int) -> bytes:
    """One file: eight header numbers, doc ids, which of them are given (bits), document offsets, block byte offsets, packed ids."""
    offsets = np.cumsum([0, *map(len, runs)]).astype("<i8")
    n = int(offsets[-1])
    body = pack(np.concatenate(runs), bits)
    blocks = (np.arange(-(-n // BLOCK), dtype=np.int64) * (BLOCK * bits // 8)).astype("<i8")
    head = np.array([MAGIC, 2, bits, BLOCK, len(doc_ids), n, len(blocks), len(body)], "<i8")
    given = np.packbits([d is not None for d in doc_ids]).tobytes()
    given += b"\0" * (-len(given) % 8)
    return b"".join([head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), given, offsets.tobytes(), blocks.tobytes(), body])


class TokenFile:
    """A file's image, read without copying; ids(start, stop) unpacks only the blocks it needs."""

    def __init__(self, raw: bytes):
        magic, version, self.bits, self.block, docs, self.n_ids, blocks, size = (int(x) for x in np.frombuffer(raw, "<i8", 8))
        if magic != MAGIC or version != 2:
            raise ValueError("not a token file")
        at, wide = 64, -(-docs // 64) * 8
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.given = np.unpackbits(np.frombuffer(raw, np.uint8, wide, at := at + 8 * docs), count=docs).astype(bool)
        self.offsets = np.frombuffer(raw, "<i8", docs + 1, at := at + wide)
        self.blocks = np.frombuffer(raw, "<i8", blocks, at := at + 8 * (docs + 1))
        self.body = memoryview(raw)[at + 8 * blocks :]
        if len(self.body) != size:
            raise ValueError("a token file is cut short")

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        end = int(self.blocks[last + 1]) if last + 1 < len(self.blocks) else len(self.body)
        count = min(self.n_ids, (last + 1) * self.block) - first * self.block
        return unpack(self.body[int(self.blocks[first]) : end], self.bits, count)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.offsets[i]), int(self.offsets[i + 1]))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, at, tie, text): at orders the documents, tie spreads and orders those of one id."""
    id_, row = F.col("doc_id").cast("long"), F.xxhash64(F.monotonically_increasing_id())
    return docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(FIRST)).alias("at"), row.alias("tie"), F.col("text").cast("string").cast("binary").alias("text"))


def bounds(rows: DataFrame) -> list[tuple[int, int]]:
    """The first (at, tie) of each part but the first, parts of about equal bytes.

    Ranges of the keys, without the texts, are summed; the driver gets one row
    for each of at most max(RANGES, parts) ranges.
    """
    sized = rows.select("at", "tie", (F.octet_length(F.coalesce("text", F.lit(b""))) + F.lit(16)).cast("long").alias("bytes"))
    whole = sized.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    parts = max(1, whole // LARGE_PART, min(whole // SMALL_PART, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranges = sized.repartitionByRange(max(parts, min(FINE * parts, RANGES)), "at", "tie").groupBy(F.spark_partition_id().alias("range"))
    summed = ranges.agg(F.min(F.struct("at", "tie")).alias("first"), F.sum("bytes").alias("bytes")).orderBy("range").collect()
    out, total = [], 0
    for r in summed:
        if total >= whole / parts * (len(out) + 1):
            out.append((r["first"]["at"], r["first"]["tie"]))
        total += r["bytes"]
    return out


def part_of(at: np.ndarray, tie: np.ndarray, firsts: list[tuple[int, int]]) -> np.ndarray:
    """How many of the ascending firsts are at or before each (at, tie)."""
    ids, ties = (np.array(x, np.int64) for x in zip(*firsts, strict=True)) if firsts else (np.zeros(0, np.int64),) * 2
    low, high = np.searchsorted(ids, at, "left"), np.searchsorted(ids, at, "right")
    for i in np.flatnonzero(low < high):  # ids at which a part begins
        low[i] += np.searchsorted(ties[low[i] : high[i]], tie[i], "right")
    return low.astype(np.int32)


def write(docs: DataFrame, path: str, end: int = 1, vocabulary: str | None = None) -> None:
    """Write every row's ids with the end id after them to token files below path, in ascending doc_id order.

    docs: doc_id and text, other columns ignored. A null text counts as empty
    and keeps its end id; rows with equal doc_id stand next to each other,
    those without one first, and may be dealt to several parts; an empty table
    writes no file.
    """
    vocabulary = vocabulary or default_path()
    rows = _keyed(docs)
    firsts = bounds(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            at, tie = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            part = part_of(at, tie, firsts)
            for i in range(0, b.num_rows, 1000):
                c = b.slice(i, 1000)
                ids = pa.array([e.raw(x.as_buffer() if x.is_valid else None, end) for x in c.column(3)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part[i : i + 1000]), *c.columns[:3], ids], names=["part", "doc_id", "at", "tie", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, n = encoder(vocabulary), None, 0
        bits = bits_for(max(e.vocabulary, end + 1))
        doc_ids: list[int | None] = []
        runs: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            values = [part, n, doc_ids[0], doc_ids[-1], len(doc_ids), held, image(doc_ids, runs, bits)]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["part", "file", "first_doc", "last_doc", "n_docs", "n_ids", "image"])

        for b in batches:
            for p, doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if doc_ids and (p != part or held >= FILE):
                    yield out()
                    doc_ids, runs, held, n = [], [], 0, n + 1 if p == part else 0
                part = p
                doc_ids.append(doc_id)
                runs.append(np.frombuffer(raw.as_py(), e.dtype))
                held += len(runs[-1])
        if doc_ids:
            yield out()

    encoded = rows.mapInArrow(encode, "part int, doc_id long, at long, tie long, ids binary")
    dealt = encoded.repartitionById(len(firsts) + 1, "part").sortWithinPartitions("part", "at", "tie").select("part", "doc_id", "ids")
    dealt.mapInArrow(assemble, FILE_SCHEMA).write.options(**WRITER).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below path, from their ids.

    start counts the ids of all documents before it: totals of the parts,
    summed, then of the files within a part, then of the documents in a file.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    index = files.select("part", "file", "n_ids")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ahead"))  # a row for each LARGE_PART of text, or for each of few parts
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = index.join(F.broadcast(parts), "part").select("part", "file", (F.col("ahead") + F.sum("n_ids").over(within) - F.col("n_ids")).alias("file_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                f = TokenFile(raw.as_buffer())
                every = memoryview(f.ids(0, f.n_ids).astype("<u4")).cast("B")
                at = (4 * f.offsets).tolist()
                crc = [zlib.crc32(every[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
                k = len(crc)
                columns = [np.full(k, part, np.int32), np.full(k, n, np.int32), pa.array(f.doc_ids, mask=~f.given), f.offsets[:-1], np.diff(f.offsets), np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "file", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = files.select("part", "file", "image").mapInArrow(run, "part int, file int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "file"]).select("doc_id", (F.col("file_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, end: int = 1, vocabulary: str | None = None) -> DataFrame:
    """write() to a new folder in the shared place, then read() of it; the folder is deleted once it is read."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, end, vocabulary)
    out = kept(read(spark, path))
    dropped(spark, path)
    return out
