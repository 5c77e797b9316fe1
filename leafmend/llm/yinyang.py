"""Centroid clustering by Yinyang's bounds, over exact integers.

Centroids are put in groups once. A vector keeps an upper bound of its distance
to its own centroid and, for each group, a lower bound of the distance to any
other centroid of the group. When centroids have moved, the bounds move with
them; a vector whose upper bound stays below all lower bounds keeps its cluster
unseen, other vectors look at the groups whose bound isn't above it, exactly.
Rows stay where they are: what crosses the network is centroids and sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept, new_path

#: Up to this size of a component, sums of 64 squares are exact in doubles; others are counted in Python's integers.
EXACT = 1 << 20
#: Places of a sum row behind the components: rows moved in less those moved out, and the distances.
LIMB = 10**18
LONGEST = (1 << 63) - 1
STATE = "vec_id long, vec binary, cluster int, distance long, upper double, lower binary, place int, limb int, value long, kind int"


def whole(raw: list[float], scale: int) -> list[int]:
    """floor(scale * x) of each component, whatever its size."""
    return [math.floor(scale * x) if abs(x) < 1e15 else scale * int(x) for x in raw]


def eligible(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors with exactly size components, none null or non-finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where((F.size("embedding") == size) & finite)


def starts(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k rows with the smallest SHA-256 of `seed:vec_id`, as integers; rows without an id are none.

    Only rows below a bound on the hash are sorted, so that not every task
    sends k rows; the bound is raised until k are below it. Rows of one id come
    in the order of their components.
    """
    hashed = rows.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    n = hashed.count()
    share = min(1.0, (4 * k + 16) / max(1, n))
    while True:
        below = hashed if share >= 1 else hashed.where(F.col("h") < f"{int(share * 16**12):012x}")
        found = below.orderBy("h", "embedding").limit(k).collect()
        if len(found) == k or share >= 1:
            return [whole(r["embedding"], scale) for r in found]
        share *= 8


def grouped(centroids: list[list[int]], groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids alone."""
    x = np.array(centroids, np.float64).reshape(len(centroids), -1)
    middle = x[:: max(1, -(-len(x) // max(1, groups)))].copy()
    own = np.zeros(len(x), np.int64)
    for _ in range(5):
        own = ((x[:, None, :] - middle[None]) ** 2).sum(-1).argmin(1)
        for g in range(len(middle)):
            if (own == g).any():
                middle[g] = x[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


class Pass:
    """One assignment: what a task needs of the centroids."""

    def __init__(self, centroids: list[list[int]], group: np.ndarray, before: list[list[int]] | None):
        self.exact = centroids
        small = [all(abs(x) <= EXACT for c in y for x in c) for y in (centroids, before or [])]
        self.small = small[0]  # else all rows are looked at in Python's integers
        self.c = np.array(centroids if self.small else [[0] * len(c) for c in centroids], np.float64)
        self.norm = (self.c * self.c).sum(1)
        self.group = group
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max()) + 1)]
        self.drift = np.zeros(len(centroids))
        if before and all(small):  # beside a large centroid no row has bounds that could move
            self.drift = np.array([math.dist(a, b) * (1 + 1e-12) for a, b in zip(centroids, before, strict=True)])
        self.group_drift = np.array([self.drift[m].max() for m in self.members])

    def squares(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of every row of x to the centroids of which; each step is an exact integer below 2**53."""
        c = self.c[which]
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + self.norm[which][None, :]

    def nearest(self, v: list[int]) -> list[int]:
        """Squared distances of a vector of any size, in Python's integers."""
        return [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in self.exact]

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, lower bound of each group) of every row."""
        d = self.squares(x, np.arange(len(self.c)))
        own = d.argmin(1)
        best = d[np.arange(len(x)), own].copy()
        d[np.arange(len(x)), own] = np.inf
        lower = np.stack([np.sqrt(d[:, m].min(1)) for m in self.members], 1)
        return own, best, lower

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper bound, lower bounds) where bounds are known, and how many distances it took.

        First all groups at once by the bound as it stands, then by the exact
        distance, then group by group. Ties are never filtered. In the last
        pass upper is the exact squared distance of every row.
        """
        slack = 1 + 1e-9
        upper = (upper + self.drift[own]) * slack
        lower = np.maximum((lower - self.group_drift[None, :]) / slack, 0)
        open_ = np.arange(len(x)) if last else np.flatnonzero(lower.min(1) <= upper)
        diff = x[open_] - self.c[own[open_]]
        best = (diff * diff).sum(1)
        scanned = len(open_)
        was, was_best, now = own[open_], best.copy(), own[open_]
        bound = np.sqrt(best) * slack
        scans = []
        for g, m in enumerate(self.members):
            at = np.flatnonzero(lower[open_, g] <= bound)
            if not len(at):
                continue
            d = self.squares(x[open_[at]], m)
            scanned += d.size
            scans.append((g, m, at, d))
            first = d.argmin(1)  # members are ascending: of equal ones the smallest
            near, number = d[np.arange(len(at)), first], m[first]
            better = (near < best[at]) | ((near == best[at]) & (number < now[at]))
            now[at[better]], best[at[better]] = number[better], near[better]
        for g, m, at, d in scans:  # a row's own centroid is left out of its group's bound
            d = np.where(m[None, :] == now[at][:, None], np.inf, d)
            lower[open_[at], g] = np.sqrt(d.min(1))
        left = np.flatnonzero(now != was)  # the centroid a row left counts for its group from now on
        g = self.group[was[left]]
        lower[open_[left], g] = np.minimum(lower[open_[left], g], np.sqrt(was_best[left]))
        own, upper = own.copy(), upper.copy()
        own[open_], upper[open_] = now, best if last else np.sqrt(best)
        return own, upper, lower, scanned


def limbs(total: int) -> list[tuple[int, int]]:
    """An integer as (limb, value) in base 10**18, one sign for all, zeros left out."""
    sign, total, out, i = (-1 if total < 0 else 1), abs(total), [], 0
    while total:
        total, low = divmod(total, LIMB)
        if low:
            out.append((i, sign * low))
        i += 1
    return out


def _run(p: Pass, size: int, scale: int, last: bool, fresh: bool):
    """Rows to rows with new bounds (kind 0), then what they change in the sums (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(p.c)
        sums: dict[tuple[int, int], int] = {}
        scanned = 0

        def add(cluster: int, place: int, value: int) -> None:
            if value:
                sums[cluster, place] = sums.get((cluster, place), 0) + value

        def moved(x: np.ndarray, to: np.ndarray, sign: int) -> None:
            hot = np.zeros((k, len(x)))
            hot[to, np.arange(len(x))] = 1.0
            total, n = hot @ x, np.bincount(to, minlength=k)
            for c in np.flatnonzero(n):
                add(int(c), size, sign * int(n[c]))
                for i in np.flatnonzero(total[c]):
                    add(int(c), int(i), sign * int(total[c, i]))

        for b in batches:
            if not b.num_rows:
                continue
            if fresh:
                raw = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                vec = [r.tobytes() for r in raw.reshape(-1, size)]
            else:
                vec = b.column("vec").to_pylist()
                raw = np.frombuffer(b"".join(vec), np.float64)
            with np.errstate(over="ignore"):
                x = np.floor(scale * raw).reshape(-1, size)
            fast = (np.abs(x) <= EXACT).all(1) if p.small else np.zeros(len(x), bool)
            own = np.full(len(x), -1) if fresh else b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            lower = np.zeros((len(x), len(p.members))) if fresh else np.frombuffer(b"".join(b.column("lower").to_pylist()), np.float64).reshape(len(x), -1).copy()
            upper = np.zeros(len(x)) if fresh else b.column("upper").to_numpy(zero_copy_only=False).copy()
            was, far = own.copy(), [0] * len(x)
            r = np.flatnonzero(fast)
            if len(r):
                if fresh:
                    own[r], best, lower[r] = p.first(x[r])
                    scanned += len(r) * k
                    upper[r] = best if last else np.sqrt(best)
                else:
                    own[r], upper[r], lower[r], n = p.again(x[r], own[r], upper[r], lower[r], last)
                    scanned += n
                if last:
                    for i, d in zip(r.tolist(), upper[r].astype(np.int64).tolist(), strict=True):
                        far[i] = d
                change = r[own[r] != was[r]]
                if len(change):
                    moved(x[change], own[change], 1)
                    if not fresh:
                        moved(x[change], was[change], -1)
            for i in np.flatnonzero(~fast).tolist():  # bounds of no use: looked at exactly each time
                v = whole(np.frombuffer(vec[i], np.float64).tolist(), scale)
                d = p.nearest(v)
                own[i], far[i] = d.index(min(d)), min(d)
                scanned += k
                upper[i], lower[i] = 1e300, 0.0
                for to, sign in ((int(own[i]), 1), (int(was[i]), -1)):
                    if to >= 0 and own[i] != was[i]:
                        add(to, size, sign)
                        for j, y in enumerate(v):
                            add(to, j, sign * y)
            if last:
                by: dict[int, int] = {}
                for c, d in zip(own.tolist(), far, strict=True):
                    by[c] = by.get(c, 0) + d
                for c, d in by.items():
                    add(c, size + 1, d)
            n = len(x)
            state = [b.column("vec_id"), pa.array(vec, pa.binary()), pa.array(own.astype(np.int32)), pa.array([min(d, LONGEST) for d in far], pa.int64()), pa.array(upper), pa.array([y.tobytes() for y in lower], pa.binary())]
            state += [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32))]
            yield pa.RecordBatch.from_arrays(state, names=NAMES)
        add(0, size + 2, scanned)
        rows = [(c, i, limb, value) for (c, i), total in sums.items() for limb, value in limbs(total)]
        n = len(rows)
        c, i, limb, value = (pa.array([r[j] for r in rows], pa.int64() if j == 3 else pa.int32()) for j in range(4))
        null = lambda t: pa.nulls(n, t)
        yield pa.RecordBatch.from_arrays([null(pa.int64()), null(pa.binary()), c, null(pa.int64()), null(pa.float64()), null(pa.binary()), i, limb, value, pa.array(np.ones(n, np.int32))], names=NAMES)

    return run


NAMES = [x.split()[0] for x in STATE.split(", ")]


def clustered(vectors: DataFrame, k: int = 16, size: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1, groups: int | None = None) -> tuple[DataFrame, list[int]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors that are kept, and the distances looked at in each pass.

    vectors: vec_id and embedding; other columns are ignored. Kept are vectors
    of exactly size components, none null or non-finite; each component x
    becomes floor(scale * x). k starts are the kept vectors of the smallest
    SHA-256 of `seed:vec_id`; there are fewer where fewer vectors have an id,
    and no rows where none has. A null vec_id takes part as any vector but is
    no start; equal vec_ids are several vectors. Ties go to the smaller
    centroid. Components of any size are counted exactly; distances and
    inertias beyond a long are given as the largest long.

    groups (a quarter of k by default) is how many groups the centroids form.
    The driver and each task hold k centroids of size numbers, nothing that
    grows with the rows; a pass writes the rows with their bounds to the shared
    folder, with the sums beside them, and deletes the pass before.
    """
    spark = vectors.sparkSession
    rows = eligible(vectors, size)
    centroids = starts(rows, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), []
    group = grouped(centroids, groups or max(1, len(centroids) // 4))
    path, before, sums, looked, inertia = None, None, {}, [], {}
    for n in range(rounds + 1):
        now = new_path(spark, "yinyang")
        run = _run(Pass(centroids, group, before), size, scale, n == rounds, path is None)
        given = spark.read.parquet(f"{path}/kind=0").select("vec_id", "vec", "cluster", "upper", "lower") if path else rows
        given.mapInArrow(run, STATE).write.partitionBy("kind").parquet(now)
        if path:
            dropped(spark, path)
        path, inertia = now, {}
        read = spark.read.schema(STATE).parquet(path).where("kind = 1")  # none where nothing has moved
        for r in read.groupBy("cluster", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            what = r["cluster"], r["place"]
            (sums if r["place"] <= size else inertia)[what] = (sums if r["place"] <= size else inertia).get(what, 0) + int(r["value"]) * LIMB ** r["limb"]
        looked.append(inertia.pop((0, size + 2), 0))
        before = centroids
        if n < rounds:
            centroids = [[sums.get((c, i), 0) // sums[c, size] for i in range(size)] if sums.get((c, size)) else old for c, old in enumerate(centroids)]
    every = min(LONGEST, sum(inertia.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, min(LONGEST, inertia.get((c, size + 1), 0)), every, h) for c, h in enumerate(names)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = kept(spark.read.parquet(f"{path}/kind=0").select("vec_id", "cluster", "distance"))
    dropped(spark, path)
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), looked  # k facts


def _sql() -> str:
    assign = """
a{n} AS (SELECT r AS row, vec_id, q, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
  SELECT v.r, v.vec_id, v.q, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS d FROM v, c{n} c) GROUP BY ALL)"""
    move = """
s{n} AS (SELECT cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) AS t(i) GROUP BY cluster, i),
m{n} AS (SELECT cluster, list((CASE WHEN s < 0 AND s % n <> 0 THEN (s - s % n) // n - 1 ELSE s // n END)::BIGINT ORDER BY i) AS q FROM s{n} GROUP BY cluster),
c{next} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m ON m.cluster = c.c)"""
    steps = ",".join(assign.format(n=n) + "," + move.format(n=n, next=n + 1) for n in range(3))
    return f"""WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1)::INT AS c, q FROM v WHERE vec_id IS NOT NULL QUALIFY c < 16),{steps},{assign.format(n=3)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a3 JOIN c3 c ON c.c = a3.cluster"""


#: The same in DuckDB's SQL, every vector against every centroid.
SQL = _sql()
