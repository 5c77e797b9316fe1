"""SimHash near-duplicates: Golay-code fuzzy hashing of 64-bit fingerprints.

The binary Golay code [23,12,7] is perfect: every 23-bit word lies within
distance 3 of exactly one codeword. A word at distance 3 lies at distance 4
from five more. Taking the indices of all codewords within distance 4 gives
one key (distance 0 to 2) or six (distance 3), and two words that differ in at
most two bits always share a key.

A fingerprint is cut into segments of 21, 21 and 22 bits. Two fingerprints
that differ in at most four bits have segment errors that fall in one of two
cases:

* some segment has no error and another has at most two: the first exact and
  the Golay key of the second make the key (six ordered choices);
* every segment has at least one error, so none has more than two: in each of
  the first two segments one of three 7-bit blocks is exact, and the Golay key
  of the third holds (nine choices).

So every link is found; candidates are compared by all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, kept

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Sampled key counts; a bucket expected to exceed HOT distinct fingerprints is compared in blocks.
HOT, SAMPLE = 20_000, 16
#: Keys of such buckets that are broadcast (16 bytes each); more are joined by an exchange.
FEW_KEYS = 1 << 18
#: Fixed value: the generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the Golay code.
GENERATOR = 0b110001110101


def fingerprint_of(text: bytes | None) -> int:
    """The 64-bit SimHash of a UTF-8 text: lower-case A-Z, words, 4-word shingles, XXH64.

    Fewer words than a shingle: the whole sequence is one. No word: 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        digests = [xxhash.xxh64_digest(b" ".join(words), SEED)]
    else:
        one, join = xxhash.xxh64_digest, b" ".join
        digests = [one(join(s), SEED) for s in zip(words, words[1:], words[2:], words[3:])]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(digests), 1 << 15):
        bits = np.unpackbits(np.frombuffer(b"".join(digests[i : i + (1 << 15)]), np.uint8))
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each row's whole text; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint_of(x) for x in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By 11-bit syndrome: the nearest error pattern, key differences (six), how many of them hold."""

    def rest(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    code = [(m << 11) | rest(m << 11) for m in range(4096)]
    sevens = [c for c in code if c.bit_count() == 7]
    error, diff, count = np.zeros(2048, np.int64), np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    bit = [1 << i for i in range(23)]
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                e = bit[i] | bit[j] | bit[k]
                s = rest(e)
                error[s] = e
                if e.bit_count() == 3:
                    diff[s, 1:] = [c >> 11 for c in sevens if c & e == e]
                    count[s] = 6
    return error, diff, count


@lru_cache(1)
def _syndromes() -> np.ndarray:
    """The remainders of each byte at each of three places, for a table look-up."""
    out = np.zeros((3, 256), np.int64)
    for place in range(3):
        for b in range(256):
            x = b << (8 * place)
            for k in range(22, 10, -1):
                if x >> k & 1:
                    x ^= GENERATOR << (k - 11)
            out[place, b] = x & 2047
    return out


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: the 12-bit indices of all codewords within distance 4 of 23-bit words."""
    error, diff, count = golay()
    t = _syndromes()
    s = t[0, words & 255] ^ t[1, words >> 8 & 255] ^ t[2, words >> 16 & 255]
    near = (words ^ error[s]) >> 11
    n = count[s]
    row = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, near[row] ^ diff[s[row], nth]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of unsigned fingerprints; those within MOST_BITS bits share one at least."""
    x = fps.astype(np.uint64)
    seg = [(x & np.uint64((1 << 21) - 1)).astype(np.int64), (x >> np.uint64(21) & np.uint64((1 << 21) - 1)).astype(np.int64), (x >> np.uint64(42)).astype(np.int64)]
    near = [golay_keys(s) for s in seg]
    rows, keys, tag = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                row, key = near[j]
                rows.append(row)
                keys.append((tag << 34) | (seg[i][row] << 12) | key)
                tag += 1
    row, key = near[2]
    for i in range(3):
        for j in range(3):
            exact = (seg[0][row] >> (7 * i) & 127) << 7 | (seg[1][row] >> (7 * j) & 127)
            rows.append(row)
            keys.append((tag << 34) | (exact << 12) | key)
            tag += 1
    return np.concatenate(rows), np.concatenate(keys)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of fp to rows (key, fp)."""
    for b in batches:
        every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(every), 2048):
            fps = every[at : at + 2048]
            row, key = keys_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64))], names=["key", "fp"])


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of at most MOST_BITS bits connect among fingerprints, no more than there are fingerprints.

    Breadth first: each taken fingerprint is compared with those not yet reached.
    """
    a, b = [], []
    left = np.unique(fps)
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            linked = np.bitwise_count(left ^ x) <= MOST_BITS
            if linked.any():
                found = left[linked]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
                left = left[~linked]
    none = np.zeros(0, np.uint64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def linked_runs(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within runs of equal group numbers; small runs by shifted comparison, others by forest()."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    length = np.diff(np.r_[start, len(group)])
    small = np.repeat(length <= 8, length)
    g, f = group[small], fp[small]
    for d in range(1, 8):
        if len(g) <= d:
            break
        hit = (g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= MOST_BITS)
        a.append(f[:-d][hit])
        b.append(f[d:][hit])
    for s, n in zip(start[length > 8], length[length > 8], strict=True):
        x, y = forest(fp[s : s + n])
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, fp) sorted by key and part to distinct edges (a, b)."""

    def out(key: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        x, y = linked_runs(group, fp.view(np.uint64))
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else None
        if pair is None:
            return None
        pair = pair[pair[:, 0] != pair[:, 1]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        last = (key == key[-1]) & (part == part[-1])
        cut = len(key) if not last.any() else int(np.argmax(last))
        if cut == 0 and held and held[-1][0][-1] == key[0] and held[-1][1][-1] == part[0]:
            held.append([key, part, fp])
            continue
        held.append([x[:cut] for x in (key, part, fp)])
        got = out(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if got is not None:
            yield got
        held = [[x[cut:] for x in (key, part, fp)]]
    if held:
        got = out(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if got is not None:
            yield got


def links(fps: DataFrame, hot: int = HOT, few: int = FEW_KEYS) -> DataFrame:
    """(a, b): enough links among distinct fingerprints (column fp) to connect all that links connect.

    A key's bucket expected to hold over hot fingerprints (by a 1 in SAMPLE
    hash sample of them) is dealt out in blocks that meet in pairs, so no task
    holds it whole and no link is lost; the sample decides only how work is
    dealt. Fingerprints are distinct here, so exact copies never fill a bucket.
    """
    sampled = fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).mapInArrow(_emit, "key long, fp long")
    large = sampled.groupBy("key").agg((F.count("*") * SAMPLE).alias("n")).where(F.col("n") > hot)
    large = kept(large.select("key", (F.ceil(F.col("n") / hot) + 1).alias("blocks")))
    n, dealt = large.count(), fps.mapInArrow(_emit, "key long, fp long")
    if n:
        dealt = dealt.join(F.broadcast(large) if n <= few else large, "key", "left")
        own, blocks = F.pmod(F.xxhash64("fp"), F.col("blocks")), F.col("blocks")
        meets = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: 1 + F.least(own, other) * blocks + F.greatest(own, other))
        dealt = dealt.select("key", F.explode(F.when(blocks.isNull(), F.array(F.lit(0).cast("long"))).otherwise(meets)).alias("part"), "fp")
    else:
        dealt = dealt.select("key", F.lit(0).cast("long").alias("part"), "fp")
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, hot: int = HOT, few: int = FEW_KEYS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    docs: doc_id and text, other columns ignored. Null and word-free texts have
    fingerprint 0 and link like any other; repeated rows stay rows and share a
    component; an empty table gives no rows. component_id is the smallest
    doc_id that links of at most four differing bits reach; a null doc_id is
    never the smallest, so a component is null only where all its ids are. Rows are collapsed
    to distinct fingerprints first, so the group of copies of one text is one
    row in the search.
    """
    rows = kept(fingerprints(docs))
    least = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(least.select("fp"), hot, few))
    named = least.join(root, least.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = kept(named)
    top = kept(named.groupBy("root").agg(F.min("least").alias("component_id")))
    table = kept(named.join(top, "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(table, "fp").select("doc_id", hexed, "component_id")
