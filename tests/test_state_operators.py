"""Budgets, refreshed views, nested paths and rules in order by values worked out by hand, by restarts and by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from leafmend.operators import firstrule, paths, views
from leafmend.streaming import budget

SCHEMA = "budget long, seq long, moment double, kind string, call string, amount double"


def test_a_ledger_by_hand():
    b = budget.Ledger({"book": (10.0, 2.0), "account": (None, 5.0)}, call_cap=6.0)
    assert b.step("reserve", "a", 7.0, 0) == (False, "call", 0.0, 0)
    assert b.step("reserve", "a", 5.0, 0) == (True, None, 0.0, 5.0)
    assert b.step("reserve", "b", 3.5, 1) == (False, "book", 0.0, 5.0)  # 10 - 2 - 5 = 3 left
    assert b.step("reserve", "b", 3.0, 1) == (True, None, 0.0, 8.0)
    assert b.step("reserve", "a", 5.0, 2) == (True, None, 0.0, 8.0)  # its own reservation is freed first
    assert b.step("settle", "b", 1.0, 3) == (None, None, 1.0, 5.0)
    assert b.step("settle", "a", None, 3) == (None, None, 6.0, 0)  # not known: the worst case
    assert b.step("settle", "z", None, 3) == (None, None, 6.0, 0) and b.step("settle", "z", 0.5, 3) == (None, None, 6.5, 0)
    assert b.step("reserve", "c", 1.5, 4) == (True, None, 6.5, 1.5)
    assert b.step("release", "c", None, 5) == (None, None, 6.5, 0)
    assert b.step("reserve", "d", 1.5, 10) == (True, None, 6.5, 1.5)
    assert b.step("reserve", "e", 0.1, 10 + budget.TIMEOUT) == (False, "book", 8.0, 0)  # d never came back
    assert b.step("reserve", "f", None, 10 + budget.TIMEOUT) == (None, None, 8.0, 0)


def requests(n=400, budgets=7, seed=2):
    r, rows, now = random.Random(seed), [], 0.0
    for i in range(n):
        now += r.choice([1, 60, 900, 4000])
        kind = r.choice(["reserve", "reserve", "settle", "release"])
        rows.append((r.randrange(budgets), i, now, kind, str(r.randrange(4)), r.choice([None, 5.0, 20.0, 40.0, 200.0]) if kind != "release" else None))
    return rows


def by_loop(rows, limits, cap):
    ledgers, out = {}, set()
    for b, seq, now, kind, call, amount in sorted(rows, key=lambda x: x[1]):
        out.add((b, seq, *ledgers.setdefault(b, budget.Ledger(limits, cap)).step(kind, call, amount, now)))
    return out


LIMITS, CAP = {"book": (120.0, 0.0), "account": (200.0, 30.0)}, 100.0


def test_a_table_and_a_stream_that_is_broken_off_agree(spark, tmp_path):
    rows = requests()
    want = by_loop(rows, LIMITS, CAP)
    assert {x[3] for x in want} == {None, "call", "book"} | ({"account"} & {x[3] for x in want})
    table = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in budget.decided(table, LIMITS, CAP).collect()} == want
    # Three files that come one after another; the stream is begun anew for each, from its checkpoint.
    source, out, marks = (f"file://{tmp_path}/{x}" for x in ("in", "out", "marks"))
    for part in range(3):
        some = [r for r in rows if r[1] * 3 // len(rows) == part]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # a second run finds nothing new and adds nothing
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            got = budget.drained(spark, budget.streamed(stream, LIMITS, CAP), out, marks).collect()
        assert len(got) == sum(r[1] * 3 // len(rows) <= part for r in rows)
    assert {tuple(r) for r in got} == want


def test_a_view_builds_only_what_changed(spark, tmp_path):
    built = []

    def build(rows):
        built.append({r.k for r in rows.select("k").distinct().collect()})
        return rows.where("v IS NOT NULL").groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("n"))

    rows = [(k, i, (k * 7 + i) % 11 if (k + i) % 5 else None) for k in range(300) for i in range(3)] + [(999, 0, None)]
    frame = lambda x: spark.createDataFrame(x, "k long, i long, v long")
    path, full = f"file://{tmp_path}/view", lambda x: sorted(map(tuple, build(frame(x)).collect()))
    assert views.refresh(frame(rows), ["k"], build, path) == (301, 301, 0, views.PARTS)
    assert sorted(map(tuple, views.read(spark, path).collect())) == full(rows)
    built.clear()
    assert views.refresh(frame(rows).repartition(5), ["k"], build, path) == (301, 0, 0, 0) and not built
    new = [(k, i, 100) if (k, i) in {(5, 1), (17, 2), (250, 0)} else (k, i, v) for k, i, v in rows if k != 40] + [(5000, 1, 1), (7, 0, 0), (7, 0, 0)]
    done = views.refresh(frame(new), ["k"], build, path)
    assert done[:3] == (301, 5, 1) and done.parts <= 6 and built[-1] == {5, 17, 250, 5000, 7}
    assert sorted(map(tuple, views.read(spark, path).collect())) == full(new)
    assert views.refresh(frame([]), ["k"], build, path)[:3] == (0, 0, 301) and views.read(spark, path).count() == 0


def test_fingerprints_see_nulls_and_repeats(spark):
    frames = [[(1, "a", None), (1, None, "a")], [(1, None, "a"), (1, "a", None)], [(1, "a", None), (1, "a", None)], [(1, "a", None)], [(1, "a", None)] * 3]
    marks = [views.fingerprints(spark.createDataFrame(f, "k long, x string, y string"), ["k"]).first()["_mark"] for f in frames]
    assert marks[0] == marks[1] and len(set(marks)) == 4


def test_paths_inside_one_another(spark):
    given = ["a", "a/b", "a/b/c", "a/bc", "b", "a/b/c/d/e", "", "/", "x//y", "x/", "x", None, "a/b"] + [f"hub/{i}" for i in range(200)] + ["hub"]
    df = spark.createDataFrame([(p, "clash") for p in given], "path string, _holder2 string").repartition(4)
    names = {p for p in given if p is not None}
    within = {p: sorted((q for q in names if p.startswith(q + "/")), key=len) for p in names}
    got = {r.path: (r.nearest, r.above, r.below) for r in paths.related(df, "path").collect()}
    assert got == {p: (within[p][-1] if within[p] else None, len(within[p]), sum(p in w for w in within.values())) for p in names}
    pairs = paths.inside(df.select("path").distinct(), "path", df, "path", salts=3).collect()
    assert {(r.path, r.path_holder) for r in pairs} == {(p, q) for p in names for q in [*within[p], p]}
    assert paths.related(df.where("false"), "path").count() == 0


def rules_frame(spark, rules):
    return spark.createDataFrame(rules, "rank long, code string, scope string, word string, pattern string")


def test_the_order_of_rules_decides(spark):
    texts = spark.createDataFrame([(1, "en", "The token: abc expired"), (2, "de", "token abc"), (3, "en", "nothing"), (4, "en", None), (5, None, "Token token: x"), (6, "en", ""), (7, "en", "tokens: abc")], "id long, lang string, text string")
    a, b, c, d = (("leak", None, "token", "token: "), ("mention", "en", "token", None), ("any", None, None, "abc"), ("rest", "en", None, None))

    def first(order):
        rules = rules_frame(spark, [(i, *r) for i, r in enumerate(order, 1)])
        return {r.id: r.code for r in firstrule.first_rules(texts, "id", "lang", "text", rules).collect()}

    assert first([a, b, c, d]) == {1: "leak", 2: "any", 3: "rest", 4: None, 5: "leak", 6: "rest", 7: "any"}
    assert first([d, c, b, a]) == {1: "rest", 2: "any", 3: "rest", 4: None, 5: "leak", 6: "rest", 7: "rest"}
    assert first([c, a, b]) == {1: "any", 2: "any", 3: None, 4: None, 5: "leak", 6: None, 7: "any"}
    assert set(first([]).values()) == {None}


def test_very_many_rules_with_words(spark):
    rules = rules_frame(spark, [(i, f"c{i}", None, f"w{i}", None if i % 3 else f"w{i} w") for i in range(1, 20_001)])
    texts = spark.createDataFrame([(1, "en", "w19999 W500 w9 other"), (2, "en", "w9 w3 w1 w"), (3, "en", "w3 x")], "id long, lang string, text string")
    got = {r.id: (r["rank"], r.code) for r in firstrule.first_rules(texts, "id", "lang", "text", rules).collect()}
    assert got == {1: (500, "c500"), 2: (1, "c1"), 3: (None, None)}
    too_many = rules_frame(spark, [(i, "c", None, None, "x") for i in range(firstrule.OPEN + 1)])
    with pytest.raises(ValueError, match="without a word"):
        firstrule.first_rules(texts, "id", "lang", "text", too_many)
