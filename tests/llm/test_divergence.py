"""Source divergence against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from leafmend.llm import divergence

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("term", T.StringType()), ("n", T.LongType()), ("g", T.LongType()))])
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    counts, have, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(terms)
        total[lang or ""].update(terms)
        have[lang or ""].update(set(terms))
    out = []
    for (lang, source), mine in counts.items():
        kept = [t for t, n in have[lang].items() if n >= least]

        def p(c, kept=kept):
            whole = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // whole for t in kept}

        a, q = p(mine), p(total[lang])
        pairs = []
        for (other, item), theirs in counts.items():
            if other == lang and item != source:
                b = p(theirs)
                pairs.append((item, sum((a[t] - b[t]) ** 2 // b[t] for t in kept)))
        terms = [(t, (a[t] - q[t]) ** 2 // q[t]) for t in kept if mine[t] and a[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, i) for i, (item, v) in enumerate(ranked[: top if part == "term" else None], 1)]
    return Counter(out)


def checked(spark, rows, **how):
    df = spark.createDataFrame([(i, *r, "clash", 5, 6) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    out = divergence.audited(df, **how)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, out.collect())) == brute(rows, how.get("least", 3), how.get("top", 200))


def corpus(n=120, sources=7, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100)] + ["Größe", "GRÖSSE", "한글", "ÀB"]
    pick = lambda s: " ".join(np.array(words)[(rng.zipf(1.3, int(rng.integers(1, 40))) * (s + 1)) % len(words)])
    return [(pick(s := int(rng.zipf(1.5)) % sources), ["en", "de"][int(rng.integers(2))], f"s{s}") for _ in range(n)]


def test_random_sources_over_blocks_and_waves(spark, monkeypatch):
    rows = corpus()
    checked(spark, rows)
    monkeypatch.setattr(divergence, "EACH", 0)
    checked(spark, rows, entries=7, wave=2, top=5)
    checked(spark, corpus(60, 4, seed=2), entries=3, wave=1, least=1)


def test_odd_rows(spark):
    rows = [(None, "en", "a"), ("", "en", "b"), ("x-Y_z 12 x\x00y é", None, None), ("x y", "", ""), ("X é", None, ""), ("only here", "fr", "one"), ("only here", "fr", "one"), ("only here", "fr", "one")]
    rows += [("tie tied", "es", s) for s in "abcd"] + [("12 34 !?", "es", "none")] + [("rare", "it", "p"), ("words", "it", "q"), ("kept", "it", None)]
    rows += [("long text " * 50_000, "pt", "big"), ("long text", "pt", "small"), ("long text other", "pt", "small")]
    checked(spark, rows)
    checked(spark, rows, least=1, top=1)
    checked(spark, [])
    checked(spark, [(None, None, None)])


def test_each_pair_meets_once(spark):
    from pyspark.sql import functions as F

    for seats in (2, 4, 8, 20):
        df = spark.range(seats).selectExpr("id AS g").crossJoin(spark.range(seats - 1).selectExpr("id AS r"))
        got = [(x.g, x.o) for x in df.withColumn("o", divergence._opponent(F.col("g"), F.col("r"), F.lit(seats))).collect()]
        assert Counter(got) == Counter((i, j) for i in range(seats) for j in range(seats) if i != j)


def test_counts_of_any_size_are_exact():
    n = np.array([0, 5, 10**13, (1 << 62) // 10**9 - 1], np.int64)
    whole = int(n.sum()) + 4
    assert divergence.shares(n, whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in n.tolist()]
    assert divergence.shares(n[:2], 9).tolist() == [1 + 10**9 // 9, 1 + 6 * 10**9 // 9]


def test_kept_terms_and_their_totals(spark):
    rows = [(1, "a b c d e a", "en", "s", "", 0, 0), (2, "a f g", "en", "t", "", 0, 0)]
    got = {(r.source, r.term): (r.n, r.total, r.first) for r in divergence.counted(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == {("s", "a"): (2, 3, True), ("t", "a"): (1, 3, False), ("s", ""): (0, 0, True), ("t", ""): (0, 0, False)}


@pytest.mark.parametrize("ids, n", [([], []), ([0], [3]), ([1, 5, 65_535], [9, 1, 10**12])])
def test_vectors_survive_the_way(ids, n):
    a, b = divergence.loosened(divergence.squeezed(np.array(ids, np.int64), np.array(n, np.int64)))
    assert a.tolist() == ids and b.tolist() == n
