"""Best-fit packing: bound-certified repacking.

Pieces are dealt to buckets and each bucket is packed by best-fit decreasing.
Dual feasible functions give a lower bound of a bucket's sequences; a bucket
that meets it is certified optimal. The others give their emptiest sequences
to a common pool, which is dealt out and packed anew; a pool's packing is taken
only where it needs fewer sequences than the ones given.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept
from .tokens import default_path, encoder

SIZE, BUCKET, ROUNDS = 2048, 8192, 3
#: Share of a bucket's sequences, the emptiest, that it gives to the pool, and the least number.
GIVE, LEAST = 0.05, 8


def pieces(docs: DataFrame, size: int = SIZE, end: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each whole text's ids with the end id, cut only beyond size."""
    vocabulary = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            if not b.num_rows:
                continue
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = e.ids(text.as_py(), end).astype("<u4")
                out += [(doc_id, k, at, len(cut := ids[at : at + size]), zlib.crc32(cut.tobytes())) for k, at in enumerate(range(0, len(ids), size))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The sequence of each length, taken in the given order, into the fullest sequence that has room.

    Sequences stand by their room; a bit set of rooms in use finds the least that is enough.
    """
    room: list[list[int]] = [[] for _ in range(size + 1)]
    used, n, out = 0, 0, np.empty(len(lengths), np.int64)
    for i, x in enumerate(lengths.tolist()):
        if fits := used >> x:
            r = x + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                used &= ~(1 << r)
        else:
            r, k, n = size, n, n + 1
        out[i] = k
        room[r - x].append(k)
        used |= 1 << (r - x)
    return out


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The largest of the bounds by dual feasible functions: thresholds up to half a sequence, and rounding functions for k up to 20."""
    if not len(lengths):
        return 0
    x = lengths.astype(np.int64)
    best = -(-int(x.sum()) // size)
    count = np.bincount(x, minlength=size + 1)
    many, total = np.cumsum(count), np.cumsum(count * np.arange(size + 1))
    half = size // 2
    for a in np.unique(np.r_[0, x[x <= half]]).tolist():
        # Above size - a: a sequence each. Below a: nothing. The rest by their size.
        alone = many[size] - many[size - a]
        rest = total[size - a] - (total[a - 1] if a else 0)
        best = max(best, int(alone) + -(-int(rest) // size))
        # Above half: at least one each; what else they leave room for.
        middle = many[size - a] - many[half]
        free = int(middle) * size - int(total[size - a] - total[half])
        low = int(total[half] - (total[a - 1] if a else 0))
        best = max(best, int(alone + middle) + max(0, -(-(low - free) // size)))
    for k in range(1, 21):
        scaled = (k + 1) * x
        whole = scaled % size == 0
        value = np.where(whole, x * k, scaled // size * size).sum()  # times k
        best = max(best, -(-int(value) // (k * size)))
    return best


def _packed(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """Rows with sequence and offset by best-fit decreasing; ties in an order of their own."""
    rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
    rows["seq"] = best_fit(rows["length"].to_numpy(), size)
    rows["offset"] = rows.groupby("seq")["length"].cumsum() - rows["length"]
    return rows


def packed(docs: DataFrame, size: int = SIZE, end: int = 0, vocabulary: str | None = None, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified), one row for each piece of each row of docs.

    docs: doc_id and text, other columns ignored. A null text is empty and is
    packed as its end id alone; rows with equal or null doc_id are packed as
    rows of their own; an empty table gives no rows. offset is gapless from 0 in each
    sequence. Buckets hold about bucket pieces whatever the table's size.
    certified tells whether a piece's bucket, or the pool that it was moved to,
    takes no more sequences than its lower bound; sequences that a bucket
    without a certificate keeps have none.
    """
    rows = kept(pieces(docs, size, end, vocabulary).withColumn("row", F.monotonically_increasing_id()))
    short = rows.where(F.col("length") < size)
    buckets = max(1, -(-short.count() // bucket))
    dealt = short.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("long").alias("bucket"))

    columns = ["row", "length", "seq", "offset", "given", "certified"]

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _packed(pdf, size)
        used = int(out["seq"].max()) + 1
        out["given"], out["certified"] = False, used <= lower_bound(out["length"].to_numpy(), size)
        if not out["certified"].iloc[0]:
            fill = out.groupby("seq")["length"].sum().sort_values(kind="stable")
            give = fill.index[: max(LEAST, int(used * GIVE))]
            out["given"] = out["seq"].isin(give)
        return out.assign(seq=key[0] * 2**20 + out["seq"])[columns]

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, was = _packed(pdf.drop(columns=["seq", "offset"]), size), pdf["seq"].nunique()
        used = int(out["seq"].max()) + 1
        fine = min(used, was) <= lower_bound(out["length"].to_numpy(), size)
        if used < was:
            return out.assign(seq=key[0] * 2**20 + out["seq"], given=True, certified=fine)[columns]
        return pdf.assign(given=True, certified=fine)[columns]

    schema = "row long, length long, seq long, offset long, given boolean, certified boolean"
    state = kept(dealt.groupBy("bucket").applyInPandas(first, schema))
    done = state.where("not given")
    pool = state.where("given")
    for k in range(1, rounds + 1):
        n = pool.count()
        if n == 0:
            break
        pools = max(1, -(-n // bucket))
        if pools == 1 and k > 1:
            break
        # Whole sequences move together, so that taking none of a pool's gains leaves them as they were.
        home = F.pmod(F.xxhash64("seq", F.lit(k)), F.lit(pools)) + k * 2**36
        pool = kept(pool.withColumn("bucket", home).groupBy("bucket").applyInPandas(again, schema))
    done = done.unionByName(pool).select("row", F.col("seq").alias("sequence_id"), "offset", "certified")
    full = rows.where(F.col("length") >= size).select(*rows.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    out = rows.where(F.col("length") < size).join(done, "row").select(*rows.columns, "sequence_id", "offset", "certified")
    return out.unionByName(full).drop("row")
