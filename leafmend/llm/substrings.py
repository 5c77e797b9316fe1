"""Substring dedup: fixed-block anchors.

Each distinct text's non-overlapping blocks of 25 words are indexed, and every
rolling 25-word window of every text probes them. A repeat of 50 words or more
always covers a whole block of either text, so a window that hits a block with
a second occurrence anchors it. Around the anchors all 50-word windows are
compared by 96-bit hashes; those that start in a document of a smaller id are repeats,
and their union is the maximal exact repeats of 50 words and up.

Windows travel packed: one binary row for each bucket of hashes and chunk of
texts, with 24 hash bits, the document and the place of each window; a row is
whole by itself, so a task that runs again needs no other. A false hit costs a
few 50-word hashes and is dropped by them. Buckets follow the corpus' size, so
hits stay as rare in a large one. Where there are too many buckets for a chunk
to fill rows of them, rows are dealt to groups of buckets first, and each group
packs its windows anew into rows of its buckets.

A text is told apart by its doc_id and, where ids are null or stand for several
texts, by its hash as well (its variant); only doc_ids decide what is smaller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept

SPAN, ANCHOR = 50, 25
#: Bytes of text for each bucket of windows, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 20, 256
#: Words of texts whose windows are packed together, and the most buckets that such a chunk is dealt to at once.
CHUNK, DEALT = 1 << 20, 1 << 15
#: Stands for a null doc_id: no document has a larger one.
NO_ID = 2**63 - 1
#: A text of fewer bytes has no SPAN words.
SHORT = 2 * SPAN - 1
#: Ids of several texts that are broadcast (8 bytes each); more are joined by an exchange.
FEW_IDS = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """word -> 64-bit hash; emptied when full."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _hashed(words: list[bytes], memo: _Words) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int, m: np.uint64) -> np.ndarray:
    """Hashes of all windows of so many words, from prefix sums of a polynomial mod 2^64."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    n = len(h)
    inverse = np.uint64(pow(int(m), -1, 1 << 64))
    power, back = np.full(n, m), np.full(n, inverse)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power, out=total[1:])
    return _mixed((total[width:] - total[:-width]) * back[: n - width + 1])


def _tasks(spark: SparkSession, characters: int) -> int:
    """Tasks for the texts: about 16 MB each, no fewer than the session's shuffle partitions."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), characters >> 24))


def _with_variant(rows: DataFrame) -> DataFrame:
    """rows (id, given, h, ...) with variant: 0, or the text's hash h where the id is null or stands for several texts."""
    many = kept(rows.where("given").groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("id"))
    n = many.count()
    own = F.when(F.col("h") == 0, F.lit(1).cast("long")).otherwise(F.col("h"))
    if not n:
        return rows.withColumn("variant", F.when(F.col("given"), F.lit(0).cast("long")).otherwise(own))
    flagged = many.withColumn("several", F.lit(True))
    joined = rows.join(F.broadcast(flagged) if n <= FEW_IDS else flagged, "id", "left")
    return joined.withColumn("variant", F.when(F.col("given") & F.col("several").isNull(), F.lit(0).cast("long")).otherwise(own)).drop("several")


def _later(rows: DataFrame) -> DataFrame:
    """(id, variant, later) of the texts that also are a smaller document's as a whole."""
    named = rows.select("id", "variant", F.sha2("text", 256).alias("sha"))
    least = named.groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    least = kept(least)  # so that both sides of the join are exchanged and a group of copies can be split
    return named.join(least, "sha").where("id > least").select("id", "variant").distinct().withColumn("later", F.lit(True))


_ZSTD = pa.Codec("zstd", 1)


def _planes(x: np.ndarray) -> bytes:
    """Numbers from 0 as bytes: two of each, low ones first, and the large ones in full."""
    x = x.astype(np.int64).view(np.uint64)  # a distance may wrap
    wide = x[x >= 0xFFFF].astype("<i8")
    two = np.minimum(x, 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2)
    return b"".join([np.array([len(wide)], "<i8").tobytes(), wide.tobytes(), two.T.tobytes()])


def _numbers(raw: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    """The inverse of _planes for n numbers, and what is left."""
    wide = int(np.frombuffer(raw, "<i8", 1)[0])
    at = 8 + 8 * wide
    x = np.frombuffer(raw, np.uint8, 2 * n, at).reshape(2, n).T.copy().view("<u2")[:, 0].astype(np.int64)
    x[x == 0xFFFF] = np.frombuffer(raw, "<i8", wide, 8)
    return x, raw[at + 2 * n :]


def _owned(doc: np.ndarray, variant: np.ndarray, place: np.ndarray, extra: np.ndarray) -> bytes:
    """Entries in ascending order of doc, packed by themselves: where each stands, then extra, one column of bytes after another."""
    told = np.flatnonzero(variant)
    low = _planes(np.diff(doc, prepend=doc[:1])) + _planes(place)
    small = _ZSTD.compress(low, asbytes=True)
    head = np.array([len(doc), doc[0], len(low), len(small), len(told)], "<i8")
    return b"".join([head.tobytes(), told.astype("<i8").tobytes(), variant[told].astype("<i8").tobytes(), small, np.ascontiguousarray(extra.T).tobytes()])


def _owners(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(docs, variants, places, extra) of what _owned packed."""
    n, first, size, small, told = (int(x) for x in np.frombuffer(raw, "<i8", 5))
    variant = np.zeros(n, np.int64)
    variant[np.frombuffer(raw, "<i8", told, 40)] = np.frombuffer(raw, "<i8", told, 40 + 8 * told)
    view = memoryview(raw)[40 + 16 * told :]
    step, rest = _numbers(memoryview(_ZSTD.decompress(view[:small], size, asbytes=True)), n)
    extra = np.frombuffer(view[small:], np.uint8)
    return first + np.cumsum(step), variant, _numbers(rest, n)[0].astype(np.int32), extra.reshape(len(extra) // n, n).T


class _Chunk:
    """Entries that are packed together, in order of their documents."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, doc, variant, *arrays: np.ndarray) -> None:
        """doc and variant: of all entries, or one for each."""
        n = len(arrays[0])
        self.parts.append((np.broadcast_to(np.int64(doc), n), np.broadcast_to(np.int64(variant), n), *arrays))
        self.size += n

    def columns(self) -> tuple[np.ndarray, ...]:
        """doc and variant of each entry, and the arrays that were added."""
        whole = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        order = np.argsort(whole[0], kind="stable")
        return tuple(x[order] for x in whole)


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)]


PACKED = "bucket int, payload binary"


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])


def _by_bucket(which: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, ascending entries of which in it)."""
    b = bucket[which]
    order = np.argsort(b.astype(np.uint16) if len(b) and b.max() < 1 << 16 else b, kind="stable")
    cut = _runs(b[order]) if len(order) else [0]
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        yield int(b[order[s]]), which[order[s:e]]


class _Plan:
    """How buckets are dealt: at once, or by groups of `inner` buckets whose numbers travel in two more bytes."""

    def __init__(self, buckets: int, dealt: int):
        self.buckets = buckets
        self.inner = 1 if buckets <= dealt else -(-buckets // dealt)
        if self.inner > 1 << 16:
            raise ValueError("too many buckets for two rounds; raise BUCKET_BYTES")

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(24)) % np.uint64(self.buckets)).astype(np.int64)

    def rows(self, bucket: np.ndarray, sent: np.ndarray, doc, variant, place, extra, first: bool) -> Iterator[tuple[int, bytes]]:
        """Packed rows of the sent entries, by bucket, or in a first round of two by group."""
        if first and self.inner > 1:
            extra = np.concatenate([(bucket % self.inner).astype("<u2").view(np.uint8).reshape(-1, 2), extra], axis=1)
            bucket = bucket // self.inner
        for b, x in _by_bucket(np.flatnonzero(sent), bucket):
            yield b, _owned(doc[x], variant[x], place[x], extra[x])


def _passed(doc: np.ndarray, variant: np.ndarray, place: np.ndarray, mark: int) -> list[tuple[int, bytes]]:
    """The row, of a bucket below 0, of entries that are settled already."""
    if not len(doc):
        return []
    return [(-1 - mark % (1 << 20), _owned(doc, variant, place, np.zeros((len(doc), 0), np.uint8)))]


def _settled_windows(plan: _Plan, first: bool):
    """A chunk's (doc, variant, bucket, extra, place) to packed rows. extra: 24 hash bits and whether a block.

    A window that a chunk itself shows to be a block with another occurrence is
    an anchor already: its places pass by (bucket below 0) and one of them
    stands for all among the windows, so no bucket gathers a window's places
    from all documents.
    """

    def packed(chunk: _Chunk) -> pa.RecordBatch:
        doc, variant, bucket, extra, place = chunk.columns()
        wide = np.zeros((len(doc), 4), np.uint8)
        wide[:, :3] = extra[:, :3]
        low, block = wide.view("<u4")[:, 0], extra[:, 3] > 0
        key = bucket << 24 | low
        order = np.argsort(key, kind="stable")
        cut = _runs(key[order])
        own = (np.diff(cut) > 1) & (np.add.reduceat(block[order].astype(np.int64), cut[:-1]) > 0)
        known = np.zeros(len(doc), bool)
        known[order[np.repeat(own, np.diff(cut))]] = True
        stand = order[cut[:-1][own]]
        sent, extra = ~known, extra.copy()
        sent[stand], extra[stand, 3] = True, 1
        rows = _passed(doc[known], variant[known], place[known], int(key[0]))
        return _rows([*rows, *plan.rows(bucket, sent, doc, variant, place, extra, first)])

    return packed


def _windows(plan: _Plan):
    """(id, variant, text, later, ...) to packed rows: every 25-word window of the first document of each distinct text."""
    packed = _settled_windows(plan, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, chunk = _Words(), _Chunk()
        for batch in batches:
            ids, variants, later = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for doc, variant, text, skip in zip(ids, variants, batch.column(2), later, strict=True):
                words = text.as_py().split() if not skip else ()
                if len(words) >= SPAN:
                    h = rolling(_hashed(words, memo), ANCHOR, _M1)
                    place = np.arange(len(h))
                    extra = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4].copy()
                    extra[:, 3] = place % ANCHOR == 0
                    chunk.add(doc, variant, plan.bucket(h), extra, place)
                    if chunk.size >= CHUNK:
                        yield packed(chunk)
                        chunk = _Chunk()
        if chunk.size:
            yield packed(chunk)

    return run


def _again(plan: _Plan, settled):
    """Rows of groups, sorted by group, to rows of their buckets, packed anew; settled ones pass."""
    packed = settled(plan, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk = None, _Chunk()
        for batch in batches:
            for group, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if group < 0:
                    yield _rows([(group, payload.as_py())])
                    continue
                if chunk.size and (group != at or chunk.size >= CHUNK):
                    yield packed(chunk)
                    chunk = _Chunk()
                at = group
                doc, variant, place, extra = _owners(payload.as_py())
                bucket = group * plan.inner + np.ascontiguousarray(extra[:, :2]).view("<u2")[:, 0].astype(np.int64)
                chunk.add(doc, variant, bucket, extra[:, 2:], place)
        if chunk.size:
            yield packed(chunk)

    return run


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Payloads of each bucket together, from rows sorted by bucket; those below 0 one by one."""
    at, held = None, []
    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket < 0:
                yield bucket, [payload.as_py()]
                continue
            if bucket != at and held:
                yield at, held
                held = []
            at = bucket
            held.append(payload.as_py())
    if held:
        yield at, held


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by bucket to (id, variant, place): windows that equal an indexed block and occur twice or more."""
    seen = np.zeros(1 << 24, np.uint8)  # 1: a window, 2: another, 4: a block
    for bucket, rows in _buckets_of(batches):
        found = []
        if bucket < 0:
            found.append(_owners(rows[0])[:3])
        else:
            got = []
            for payload in rows:
                doc, variant, place, extra = _owners(payload)
                wide = np.zeros((len(doc), 4), np.uint8)
                wide[:, :3] = extra[:, :3]
                low = wide.view("<u4")[:, 0]
                value, count = np.unique(low, return_counts=True)
                seen[value[(count > 1) | (seen[value] & 1 > 0)]] |= 2
                seen[value] |= 1
                seen[low[extra[:, 3] > 0]] |= 4
                got.append((doc, variant, place, low))
            for doc, variant, place, low in got:
                hit = seen[low] & 6 == 6
                if hit.any():
                    found.append((doc[hit], variant[hit], place[hit]))
            for *_, low in got:
                seen[low] = 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["id", "variant", "place"])


def _settled_spans(plan: _Plan, first: bool):
    """A chunk's (doc, variant, bucket, extra, place) to packed rows. extra: 96 hash bits.

    Of a window's places in a chunk only those of the smallest document travel
    by its hash; the later ones are repeats for certain and pass by.
    """

    def packed(chunk: _Chunk) -> pa.RecordBatch:
        doc, variant, bucket, extra, place = chunk.columns()
        later = _after_first(doc, extra)
        rows = _passed(doc[later], variant[later], place[later], int(bucket[0]))
        return _rows([*rows, *plan.rows(bucket, ~later, doc, variant, place, extra, first)])

    return packed


def _after_first(doc: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Whether an entry's document is larger than the smallest one of an equal 96-bit hash."""
    whole = np.ascontiguousarray(extra)
    one, two = np.ascontiguousarray(whole[:, :8]).view("<u8")[:, 0], np.ascontiguousarray(whole[:, 8:12]).view("<u4")[:, 0]
    order = np.lexsort((doc, two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    later = np.zeros(len(doc), bool)
    later[order] = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return later


def _spans(plan: _Plan):
    """(id, variant, text, places, ...) to packed rows: the 50-word windows around anchors."""
    packed = _settled_spans(plan, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, chunk = _Words(), _Chunk()
        for batch in batches:
            ids, variants = (batch.column(i).to_pylist() for i in (0, 1))
            for doc, variant, text, places in zip(ids, variants, batch.column(2), batch.column(3), strict=True):
                if not places.is_valid:
                    continue
                h = _hashed(text.as_py().split(), memo)
                n = len(h) - SPAN + 1
                near = np.zeros(n + 1, np.int64)
                p = np.asarray(places.values)
                np.add.at(near, np.maximum(0, p - (SPAN - ANCHOR)), 1)
                np.add.at(near, np.minimum(n, p + 1), -1)
                start = np.flatnonzero(np.cumsum(near)[:n] > 0)
                if not len(start):
                    continue
                one, two = rolling(h, SPAN, _M1)[start], rolling(_mixed(h ^ _M2), SPAN, _M2)[start]
                extra = np.concatenate([one.astype("<u8").view(np.uint8).reshape(-1, 8), (two >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
                chunk.add(doc, variant, plan.bucket(one), extra, start)
                if chunk.size >= CHUNK:
                    yield packed(chunk)
                    chunk = _Chunk()
        if chunk.size:
            yield packed(chunk)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by bucket to (id, variant, start): windows that also start in a smaller document."""
    for bucket, rows in _buckets_of(batches):
        got = [_owners(payload) for payload in rows]
        doc, variant, start, extra = (np.concatenate(x) for x in zip(*got, strict=True))
        if bucket >= 0:
            later = _after_first(doc, extra)
            doc, variant, start = doc[later], variant[later], start[later]
        if len(doc):
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(variant), pa.array(start)], names=["id", "variant", "start"])


def _routed(packed: DataFrame, plan: _Plan, settled) -> DataFrame:
    """Packed rows brought together by bucket, by way of groups where there are many buckets."""
    by_bucket = packed.repartition("bucket").sortWithinPartitions("bucket")
    if plan.inner == 1:
        return by_bucket
    return by_bucket.mapInArrow(_again(plan, settled), PACKED).repartition("bucket").sortWithinPartitions("bucket")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, later, starts, ...) to the digest and the text that is left."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "clean_text"]
    for batch in batches:
        out = []
        for doc_id, raw, later, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
            words = raw.as_py().split()
            n = len(words)
            gone = np.zeros(n + 1, np.int64)
            if later and n >= SPAN:
                gone[0], gone[n] = 1, -1
            elif starts.values is not None and len(starts.values):
                s = np.asarray(starts.values)
                s = s[s + SPAN <= n]
                np.add.at(gone, s, 1)
                np.add.at(gone, s + SPAN, -1)
            covered = np.cumsum(gone)[:n] > 0
            left = b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c) if covered.any() else b" ".join(words)
            out.append((doc_id, n, int(covered.sum()), hashlib.sha256(left).hexdigest(), left))
        if out:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            arrays[-1] = arrays[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def without_repeats(docs: DataFrame, dealt: int = DEALT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, clean_text), one row for each row of docs.

    docs: doc_id and text, other columns ignored. Each word covered by 50
    consecutive words that also start in a document with a smaller doc_id is
    removed; repeats are judged on the input. A null text has no words. Texts
    of under 50 words lose nothing. Rows of equal doc_id are one document to
    each other (no smaller id) but each is cut by its own places; a null doc_id
    counts as the largest long, so rows without one don't cut each other.
    An empty table gives no rows. Only the first document of each distinct text
    is searched: its copies are covered by it whole.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw)
    whole = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    plan = _Plan(int(max(LEAST_BUCKETS, whole // bucket_bytes)), dealt)
    long_ = rows.where(F.octet_length("text") >= SHORT)
    named = _with_variant(long_.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("doc_id").isNotNull().alias("given"), F.xxhash64("text").alias("h"), "text"))
    # One exchange of the texts serves three joins: left joins leave it as it is, so Spark reuses it. All take
    # the same columns of it, doc_id too, or each would be pruned to an exchange of its own.
    key = ["id", "variant"]
    texts = named.select("doc_id", *key, "text").repartition(_tasks(docs.sparkSession, whole), *key)
    later = kept(_later(named))
    windows = texts.join(later, key, "left").select(*key, "text", "later", "doc_id").mapInArrow(_windows(plan), PACKED)
    anchors = _routed(windows, plan, _settled_windows).mapInArrow(_anchors, "id long, variant long, place int")
    anchors = anchors.groupBy(*key).agg(F.collect_list("place").alias("places"))
    spans = texts.join(anchors, key, "left").select(*key, "text", "places", "doc_id").mapInArrow(_spans(plan), PACKED)
    gone = _routed(spans, plan, _settled_spans).mapInArrow(_repeats, "id long, variant long, start int")
    gone = gone.groupBy(*key).agg(F.collect_list("start").alias("starts"))
    out = texts.join(later, key, "left").join(gone, key, "left").select("doc_id", "text", "later", "starts", *key)
    short = rows.where(F.octet_length("text") < SHORT).select("doc_id", "text", F.lit(False).alias("later"), F.lit(None).cast("array<int>").alias("starts"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, clean_text string"
    return out.mapInArrow(_cut, schema).unionByName(short.mapInArrow(_cut, schema))


def digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).drop("clean_text")
