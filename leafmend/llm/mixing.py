"""Mixing sources to target weights: pivotal dependent rounding.

Each source's target divided by its size is the copies each of its documents
should have: a whole number of copies and a fraction. Fractions are rounded in
pairs: words move at random from one document to the other, the expected words
of both kept, until one of the two fractions is 0 or 1. A source is dealt to
buckets; each leaves one fraction and a reserve of documents of all sizes that
it hasn't touched. These meet in a tree of fixed fan-in. At a source's root the
largest open document is rounded and the rest, all smaller, take up what that
moved, in shares that keep every document's expectation; so the words missed
shrink to those of a small document. Only a source too small for that, whose
miss stays above NEAR of its words, is settled by turning a few documents over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, kept, prefixed

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Rows of a bucket, children of a node, untouched documents that a bucket passes on, documents that a root rounds one by one.
BUCKET, FAN_IN, RESERVE, ROOT = 20_000, 64, 64, 1024
#: Sources whose table is broadcast (some 50 bytes each); more are joined by an exchange.
SMALL = 100_000
#: Share of a source's rounded words that it may miss before documents are turned over.
NEAR = 1e-3
EDGE = 1e-9


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, rank, source_size, n, target) of the sources in rows (source, size).

    Sources by code point, null last, weigh weights in turn and share so much
    of all sizes. A target stops at most times its source's size and what is
    over is shared again by weight, until none is above: sources fill up in
    order of most * size / weight, so the level of the rest follows from prefix
    sums, which are taken over ranges of sources. n counts rows with words. One
    row a source; a source without words has target 0.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    by = by.withColumn("absent", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    by = prefixed(by, ["absent", "source"], ["one"]).withColumnRenamed("before_one", "rank").drop("one", "absent")
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    by = kept(prefixed(by.withColumn("fill", F.col("cap") / F.col("w")), ["fill", "rank"], ["cap", "w"]))
    every = by.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    left = F.lit(share * (every["size"] or 0)) - F.col("before_cap")
    level = left / (F.lit(every["w"] or 0.0) - F.col("before_w"))
    top = by.select(F.max(F.when(level * F.col("w") <= F.col("cap"), level))).first()[0]
    target = F.col("cap") if top is None else F.least(F.col("cap"), F.lit(top) * F.col("w"))
    return by.select("source", "rank", "source_size", "n", target.cast("double").alias("target"))


def _chance(a: int, b: int, seed: int) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{a}:{b}".encode(), digest_size=7).digest(), "big") / (1 << 56)


def _is_open(p: np.ndarray | float) -> np.ndarray | bool:
    return (p > EDGE) & (p < 1 - EDGE)


def pivot(ids: list[int], sizes: list[float], p: list[float], seed: int) -> list[float]:
    """Round fractions in pairs, keeping the expected words; at most one stays between 0 and 1."""
    p, held = list(p), -1
    for i in range(len(p)):
        if not _is_open(p[i]):
            p[i] = float(round(p[i]))
            continue
        if held < 0:
            held = i
            continue
        a, b, j = p[held] * sizes[held], p[i] * sizes[i], held
        up = min(sizes[j] - a, b)
        down = min(a, sizes[i] - b)
        move = up if _chance(ids[j], ids[i], seed) * (up + down) < down else -down
        p[j], p[i] = (a + move) / sizes[j], (b - move) / sizes[i]
        open_j, open_i = _is_open(p[j]), _is_open(p[i])
        for k, still in ((j, open_j), (i, open_i)):
            if not still:
                p[k] = float(round(p[k]))
        held = i if open_i else j if open_j else -1
    return p


def absorbed(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Round fractions from the largest document on, the smaller ones taking up the words that each moves.

    Rows stand by size, largest first. Each of the rest takes a share set by
    how far it is from 0 and 1, the same for either turn of the coin, so its
    expectation stays. Where the rest can't take up a document's words, what is
    open is left to pivot().
    """
    p = p.copy()
    for i in range(len(p)):
        if not _is_open(p[i]):
            p[i] = round(p[i])
            continue
        room = np.minimum(p[i + 1 :], 1 - p[i + 1 :])
        whole, a = float(room @ sizes[i + 1 :]), p[i] * sizes[i]
        if whole < max(a, sizes[i] - a):
            break
        up = _chance(int(ids[i]), -2, seed) < p[i]
        p[i + 1 :] = np.clip(p[i + 1 :] + (a - sizes[i] if up else a) * room / whole, 0, 1)
        p[i] = float(up)
    return p


def _settle(p: np.ndarray, sizes: np.ndarray, k: int, miss: float, most: int = 8) -> None:
    """Turn a few rounded documents other than k over so that the words missed (over, if above 0) shrink."""
    for _ in range(most):
        turn = (p == (1.0 if miss > 0 else 0.0)) & (sizes < 2 * abs(miss))
        turn[k] = False
        if not turn.any():
            return
        j = int(np.where(turn, np.abs(sizes - abs(miss)), np.inf).argmin())
        miss += sizes[j] if miss < 0 else -sizes[j]
        p[j] = 1 - p[j]


def rounded(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: int, root: bool) -> np.ndarray:
    """One source's fractions in one bucket, rows by size, largest first; at the root all come out as 0 or 1."""
    n, p, words = len(p), p.astype(np.float64), float(p @ sizes)
    spare = np.zeros(n, bool)
    spare[np.unique(np.linspace(0, n - 1, min(n, ROOT if root else RESERVE)).astype(np.int64))] = True
    p[~spare] = pivot(ids[~spare].tolist(), sizes[~spare].tolist(), p[~spare].tolist(), seed)
    if not root:
        return p
    left = np.flatnonzero(_is_open(p))
    p[left] = absorbed(ids[left], sizes[left], p[left], seed)
    left = np.flatnonzero(_is_open(p))
    p[left] = pivot(ids[left].tolist(), sizes[left].tolist(), p[left].tolist(), seed + 1)
    for k in np.flatnonzero(_is_open(p)):
        up = float(_chance(int(ids[k]), -1, seed) < p[k])
        miss, p[k] = (up - p[k]) * sizes[k], up
        if abs(miss) > NEAR * words:
            _settle(p, sizes, k, miss)
    return p


COLUMNS = "row long, tie long, rank long, size long, p double, salt long, salts long"


def _rounder(seed: int):
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "salt", "size", "tie", "row"], ascending=[True, True, False, True, True], kind="stable").reset_index(drop=True)
        p, ids, sizes = pdf["p"].to_numpy(np.float64).copy(), pdf["tie"].to_numpy(np.int64), pdf["size"].to_numpy(np.float64)
        group = pdf[["rank", "salt"]].to_numpy()
        edges = np.r_[np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)]), len(pdf)]
        root = pdf["salts"].to_numpy() == 1
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            p[s:e] = rounded(ids[s:e], sizes[s:e], p[s:e], seed, bool(root[s]))
        return pdf.assign(p=p)[names]

    return run


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, bucket: int = BUCKET, row: Column | None = None) -> DataFrame:
    """(doc_id, row, size, source_size, target, copies, taken), one row for each row of docs.

    docs: doc_id, text, source; other columns ignored. A null text has no
    words, a null source is a source of its own. Documents without words are
    never copied. Repeated rows are rows of their own; an empty table gives no
    rows. Rows are dealt out by a hash of doc_id and text, so a source of any
    size is spread, and so are rows without a doc_id; chances come from the
    same hash, so reruns agree. row: a long that tells the rows of docs apart;
    by default they are numbered as Spark reads them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    number = (F.monotonically_increasing_id() if row is None else row).alias("row")
    rows = kept(docs.select(number, F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("tie")))
    table = kept(targets(rows, weights, share, most))
    if table.count() <= SMALL:
        table = F.broadcast(table)
    copies = F.when(F.col("size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    joined = rows.join(table, rows.source.eqNullSafe(table.source)).drop("source").withColumn("c", copies)
    joined = joined.withColumn("base", F.floor(F.col("c") + EDGE)).withColumn("p", F.greatest(F.lit(0.0), F.col("c") - F.col("base")))
    salts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / bucket))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    level = joined.where(F.col("p") > EDGE).withColumn("salts", salts).withColumn("salt", F.pmod("tie", "salts")).select(*names)
    done, depth, n = [], 0, rows.count()
    while n:
        lane = F.pmod(F.xxhash64("rank", "salt"), F.lit(-(-n // bucket))).alias("lane")
        level = kept(level.groupBy(lane).applyInPandas(_rounder(seed + depth), COLUMNS))
        done.append(level.where("p = 0 or p = 1").select("row", "p"))
        level = level.where("p > 0 and p < 1").withColumn("salt", F.floor(F.col("salt") / FAN_IN)).withColumn("salts", F.ceil(F.col("salts") / FAN_IN))
        n, depth = level.count(), depth + 1
    out = joined.select("row", "doc_id", "size", "source_size", "target", "base")
    settled = done[0] if done else level.select("row", "p")
    for x in done[1:]:
        settled = settled.unionByName(x)
    total = (F.col("base") + F.coalesce("p", F.lit(0.0))).cast("long")
    return out.join(settled, "row", "left").select("doc_id", "row", "size", "source_size", "target", total.alias("copies"), (F.col("size") * total).alias("taken"))
