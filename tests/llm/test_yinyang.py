"""Centroid clustering against brute force in Python's integers."""

import hashlib
import math

import numpy as np
from pyspark.sql import types as T

from leafmend.llm import yinyang

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType()), T.StructField("kind", T.IntegerType())])


def brute(rows, k, size, scale, rounds, seed=1):
    good = [(i, [math.floor(scale * x) if abs(x) < 1e15 else scale * int(x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)][:k]
    if not c:
        return []

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in good]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(good, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in good]
    cap = (1 << 63) - 1
    inertia = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    return [(i, o, min(d, cap), min(inertia[o], cap), min(sum(inertia.values()), cap), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in out]


def checked(spark, rows, k=5, size=4, scale=64, rounds=3, groups=None):
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], SCHEMA).repartition(3)
    out, looked = yinyang.clustered(df, k, size, scale, rounds, groups=groups)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute(rows, k, size, scale, rounds), key=key)
    return looked


def test_random_clusters_and_any_number_of_groups(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 3, (9, 4))
    rows = [(int(i), (middles[i % 9] + rng.normal(0, 0.3, 4)).tolist()) for i in range(300)]
    for k, groups in ((5, None), (12, 1), (12, 12), (1, None)):
        looked = checked(spark, rows, k=k, groups=groups)
        assert len(looked) == 4 and looked[0] == 300 * k
    assert checked(spark, rows, k=30, rounds=8)[5] < 300 * 30 / 3  # bounds spare most distances once centroids settle


def test_ties_repeats_and_equal_vectors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3), 0.0, 0.0]) for i in range(27)]
    checked(spark, grid, k=7, rounds=5)
    checked(spark, [(4, [1.0] * 4)] * 6 + [(None, [1.0] * 4), (None, [2.0] * 4)], k=3)
    checked(spark, [(1, [0.0] * 4), (1, [1.0, 0.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0, 0.0]), (2, [9.0, 0.0, 0.0, 0.0])], k=3)


def test_odd_vectors_are_left_out_and_large_ones_exact(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 0.0, 0.0]), (5, [nan, 0.0, 0.0, 0.0]), (6, [inf, 0.0, 0.0, 0.0]), (7, [0.0] * 5)]
    small = [(10 + i, [i / 7, -i / 3, 0.01 * i, -1e-320]) for i in range(20)]
    checked(spark, odd + small)
    large = [(40 + i, [1e6 * i, -3e9 * i, 1e300 if i == 5 else 2.0, 0.0]) for i in range(8)]
    checked(spark, odd + small + large)
    checked(spark, odd + [(None, [1.0] * 4)])
    checked(spark, odd)
    checked(spark, [])


def test_few_are_sorted_for_the_starts(spark):
    rows = spark.range(5000).selectExpr("id AS vec_id", "array(CAST(id AS DOUBLE)) AS embedding")
    want = sorted(range(5000), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:16]
    assert yinyang.starts(rows, 16, 1, 1) == [[i] for i in want]
