"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Vectors of one label and dimension are assigned to the cell of their nearest
centroid, of sqrt(n) / 4 cells or a few more for n vectors. Two unit vectors with cosine c are
sqrt(2-2c) apart, so a vector whose distance to the plane between its own cell
and another is larger than that can have no partner beyond the plane; it visits
the other cell as a guest otherwise. Each ordered pair is therefore met exactly
once: in the cell of its second vector.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, kept

COSINE = 0.98
#: Cells are the square root of a label's vectors over THIN, 2 at least: where labels are dense a vector visits most cells, so fewer are cheaper to visit and as dear to compare.
THIN = 4
#: k-means is fitted on a hash sample of about so many vectors for each cell, in so many rounds.
SAMPLE, ROUNDS = 8, 8
#: Vectors that are assigned by one copy of their label's centroids.
SLICE = 50_000
#: Vectors of a cell that are held at once while the others stream past.
BLOCK = 2048
DOUBT = 1e-12


def parsed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, key, vec): vec is the double vector's bytes, key its 128-bit digest.

    label, key and vec are null where a vector links with nothing: label null,
    vector null, empty or zero, a null, infinite or NaN component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, key, vec = [], [], []
            for x, y in zip(b.column(1), b.column(2), strict=True):
                v = y.values
                good = x.is_valid and v is not None and len(v) and not v.null_count
                a = v.to_numpy(zero_copy_only=False).astype(np.float64) if good else None
                if a is None or not np.isfinite(a).all() or not a.any():
                    label.append(None), key.append(None), vec.append(None)
                else:
                    raw = (a + 0.0).tobytes()
                    label.append(x.as_py()), key.append(hashlib.blake2b(raw, digest_size=16).digest()), vec.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.int64()), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "label", "key", "vec"])

    wanted = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return wanted.mapInArrow(run, "vec_id long, label long, key binary, vec binary")


def unit(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.float64)
    x = x / np.abs(x).max()
    return x / math.sqrt(float(x @ x))


def fit(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit centroids of unit vectors; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        total = np.zeros_like(c)
        for i in range(0, len(x), BLOCK):
            np.add.at(total, (x[i : i + BLOCK] @ c.T).argmax(1), x[i : i + BLOCK])
        size = np.linalg.norm(total, axis=1)
        c[size > 1e-9] = total[size > 1e-9] / size[size > 1e-9, None]
    return np.unique(c, axis=0)


def sizes(classes: DataFrame) -> DataFrame:
    """(label, dim, n, cells): the classes of each label and dimension, and how many cells they get."""
    groups = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    return groups.withColumn("cells", F.greatest(F.lit(2), F.ceil(F.sqrt("n") / THIN)).cast("long"))


def centroids(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, dim, j, vec): the centroids of each label and dimension, one task fitting one of them.

    Fitted on a hash sample of about SAMPLE vectors a cell, so on SAMPLE *
    cells vectors (a documented bound): some 63,000 of a billion. They
    decide where work is done only; no link depends on them.
    """
    sampled = classes.select("label", "dim", "vec", F.pmod(F.xxhash64("key"), F.lit(1 << 40)).alias("h")).join(groups, ["label", "dim"])
    sampled = sampled.where(F.col("h") * F.col("n") < F.lit(float(SAMPLE << 40)) * F.col("cells")).select("label", "dim", "cells", "h", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            label, dim, cells = at
            c = fit(np.stack([unit(v) for v in held]), cells)
            k = len(c)
            return pa.RecordBatch.from_arrays([pa.array([label] * k, pa.int64()), pa.array([dim] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([v.tobytes() for v in c], pa.binary())], names=["label", "dim", "j", "vec"])

        for b in batches:
            for label, dim, cells, vec in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if (label, dim, cells) != at:
                    if held:
                        yield out()
                    at, held = (label, dim, cells), []
                held.append(vec)
        if held:
            yield out()

    dealt = sampled.repartition("label", "dim").sortWithinPartitions("label", "dim", "h", "vec")
    return dealt.mapInArrow(run, "label long, dim int, j int, vec binary")


def assigned(classes: DataFrame, groups: DataFrame, middles: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, cls, n, vec, own, guest): each unit vector with its own cell and the others that a partner may lie in.

    A label's centroids go to each slice of SLICE of its vectors, ahead of
    them, so a label of any size is spread and no task holds more than the
    centroids of one label and a batch.
    """
    reach = math.sqrt(2 - 2 * cosine) + 1e-9
    slices = groups.select("label", "dim", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    rows = classes.join(slices, ["label", "dim"]).select("label", "dim", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("role"), "cls", "n", "vec")
    copies = middles.join(slices, ["label", "dim"]).select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"), F.col("j").cast("long").alias("cls"), F.lit(0).cast("long").alias("n"), "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, c = None, [], None
        for b in batches:
            marks = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            vec = b.column(6).to_pylist()
            i = 0
            while i < len(marks):
                j = i
                while j < len(marks) and j - i < BLOCK and marks[j] == marks[i]:
                    j += 1
                if marks[i][:3] != at:
                    at, held, c = marks[i][:3], [], None
                if marks[i][3] == 0:
                    held += [np.frombuffer(v, np.float64) for v in vec[i:j]]
                else:
                    if c is None:
                        c = np.stack(held)
                    x = np.stack([unit(v) for v in vec[i:j]])
                    p = x @ c.T
                    own = p.argmax(1)
                    apart = np.sqrt(np.maximum(2 - 2 * (c[own] @ c.T), 0))
                    near = (p.max(1)[:, None] - p) <= reach * apart + 1e-12
                    near |= apart < 1e-5  # too near each other for their plane to tell
                    near[np.arange(len(x)), own] = False
                    rows, cells = np.nonzero(near)
                    guests = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(x) + 1)).astype(np.int32)), pa.array(cells.astype(np.int32)))
                    columns = [b.column(k).slice(i, j - i) for k in (0, 1, 4, 5)] + [pa.array([v.tobytes() for v in x], pa.binary()), pa.array(own.astype(np.int32)), guests]
                    yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "cls", "n", "vec", "own", "guest"])
                i = j

    dealt = rows.unionByName(copies).repartition("label", "dim", "slice").sortWithinPartitions("label", "dim", "slice", "role", "cls")
    return dealt.mapInArrow(run, "label long, dim int, cls long, n long, vec binary, own int, guest array<int>")


def _products(cosine: float):
    """Rows sorted by (cell, block, target first) to (a, b, n): b null gives links of a, n null an edge."""
    names = ["a", "b", "n"]

    def linked(q: np.ndarray, t: np.ndarray) -> np.ndarray:
        s = q @ t.T
        hit = s >= cosine
        for i, j in zip(*np.nonzero(np.abs(s - cosine) < DOUBT), strict=True):  # as summed either way round
            hit[i, j] = math.fsum(q[i] * t[j]) >= cosine
        return hit

    def forest(hit: np.ndarray) -> np.ndarray:
        """The first member of each target's local component."""
        root, done = np.arange(len(hit)), np.zeros(len(hit), bool)
        for i in range(len(hit)):
            if not done[i]:
                todo = [i]
                done[i] = True
                while todo:
                    new = hit[todo.pop()] & ~done
                    done |= new
                    root[new] = i
                    todo.extend(np.flatnonzero(new))
        return root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, target, ids, weights, root = None, [], None, None, None, None
        for batch in batches:
            cell, block = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            role, cls, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            vec = batch.column(5).to_pylist()
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            w: list[np.ndarray] = []
            i = 0
            while i < len(cell):
                here = (cell[i], block[i])
                j = i
                while j < len(cell) and (cell[j], block[j]) == here and role[j] == role[i]:
                    j += 1
                if here != at:
                    at, held, target = here, [], None
                if role[i] == 0:
                    held.append((cls[i:j], n[i:j], [np.frombuffer(v, np.float64) for v in vec[i:j]]))
                elif held:
                    if target is None:
                        ids, weights = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                        target = np.stack([v for h in held for v in h[2]])
                        root = forest(linked(target, target))
                        c = root != np.arange(len(root))
                        a.append(ids[c]), b.append(ids[root[c]]), w.append(np.full(c.sum(), -1))
                    for k in range(i, j, BLOCK):
                        e = min(j, k + BLOCK)
                        hit = linked(np.stack([np.frombuffer(v, np.float64) for v in vec[k:e]]), target)
                        hit &= cls[k:e, None] != ids[None, :]
                        q = np.flatnonzero(hit.any(1))
                        if len(q):
                            a.append(cls[k:e][q]), b.append(np.full(len(q), -1)), w.append(hit[q] @ weights)
                            x, y = np.nonzero(hit[q])
                            pair = np.unique(np.stack([q[x], root[y]], 1), axis=0)
                            a.append(cls[k:e][pair[:, 0]]), b.append(ids[pair[:, 1]]), w.append(np.full(len(pair), -1))
                i = j
            if a:
                x, y, z = np.concatenate(a), np.concatenate(b).astype(np.int64), np.concatenate(w).astype(np.int64)
                count = z >= 0
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y, mask=count), pa.array(z, mask=~count)], names=names)

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    vectors: vec_id, embedding, label; other columns are ignored. Only rows of
    one label and dimension are compared. Rows that link with nothing (null
    label; null, empty or zero vector; null or non-finite component) get 0
    links, themselves as component, and are kept. Equal vectors are collapsed
    to one class with a count first, so a group of copies of any size is one
    row in the search; classes are told apart by a number of their own. An
    empty table gives no rows. A repeated vec_id counts as another vector; a
    null vec_id links like any other and is never the smallest, so a component
    (and kept) is null only where all its ids are. Cells over block vectors are
    held block by block while all others of the cell stream past, so no task
    holds a whole cell.
    """
    base = kept(parsed(vectors))
    classes = base.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("vec").alias("vec"))
    classes = kept(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", (F.length("vec") / 8).cast("int")))
    groups = kept(sizes(classes))
    placed = kept(assigned(classes, groups, centroids(classes, groups), cosine))
    cell = ["label", "dim", "cell"]
    blocks = placed.groupBy("label", "dim", F.col("own").alias("cell")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    visits = F.explode(F.concat(F.array("own"), "guest")).alias("cell")
    name = F.concat_ws(":", *cell).alias("cell")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    targets = placed.withColumnRenamed("own", "cell").join(blocks, cell).select(name, own.alias("block"), F.lit(0).alias("role"), "cls", "n", "vec")
    passing = placed.select("label", "dim", visits, "cls", "n", "vec").join(blocks, cell)
    passing = passing.select(name, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "cls", "n", "vec")
    dealt = targets.unionByName(passing).repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
    found = kept(dealt.mapInArrow(_products(cosine), "a long, b long, n long"))
    counts = found.where("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("linked"))
    root = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    table = classes.select("label", "key", "cls", "n", "least").join(counts, "cls", "left").join(root, "cls", "left")
    links = F.col("n") - 1 + F.coalesce("linked", F.lit(0))
    table = kept(table.select("label", "key", links.alias("links"), F.coalesce("root", "cls").alias("root"), "least"))
    least = table.groupBy("root").agg(F.min("least").alias("least"))
    table = table.drop("least").join(least, "root")
    out = base.select("vec_id", "label", "key").join(table, ["label", "key"], "left")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


#: The same in DuckDB's SQL, by brute force.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM v JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
