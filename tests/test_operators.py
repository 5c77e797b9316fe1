"""Operators against brute force and cases worked out by hand."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from leafmend.functions import forms, words
from leafmend.operators import bands, grid, order, trees, validate, workorder
from leafmend.operators.groups import by_group
from leafmend.streaming import outcomes


def heaviest(first, weight):
    """Every run tried: the heaviest, whose entries from the last back are the earliest."""
    best = None
    for k in range(1, len(first) + 1):
        for c in combinations(range(len(first)), k):
            if all(first[a] <= first[b] for a, b in zip(c, c[1:], strict=False)):
                key = (-sum(weight[i] for i in c), c[::-1])
                best = min(best or key, key)
    return set(best[1]) if best else set()


def test_backbone_is_heaviest():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(0, 9)
        first, weight = [rng.randint(1, 6) for _ in range(n)], [rng.randint(1, 4) for _ in range(n)]
        assert order.backbone(first, weight) == heaviest(first, weight), (first, weight)


ENTRY = "book string, pos int, parent string, first int, last int, skip boolean"


def test_out_of_order(spark):
    rows = [("b", 0, None, 1, 10, False), ("b", 1, None, 21, 30, None), ("b", 2, None, 11, 20, False), ("b", 3, None, 31, 40, False), ("b", 4, None, None, None, False), ("b", 5, None, 2, 2, True)]
    out = order.out_of_order(spark.createDataFrame(rows, ENTRY)).collect()
    assert [(r.pos, r.prev, r.next) for r in out] == [(2, 30, 31)]
    assert order.out_of_order(spark.createDataFrame([], ENTRY)).count() == 0
    folio = [("b", 0, "p", 6, 6, False), ("b", 1, "p", 2, 23, False), ("b", 2, "p", 24, 40, False)]
    assert [r.pos for r in order.out_of_order(spark.createDataFrame(folio, ENTRY)).collect()] == [0]


def test_read_late(spark):
    rows = [("b", 0, "p", 1, 20, False), ("b", 1, "p", 9, 9, False), ("b", 2, "p", 21, 30, False), ("b", 3, "p", 22, 22, False)]
    got = {r.pos: r.after for r in order.read_late(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == {1: 20, 3: 30}  # both in order, eleven and eight pages before what was read


def test_by_group_streams_groups_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).selectExpr("CASE WHEN id < 200 THEN NULL WHEN id < 400 THEN 1 ELSE id % 23 END AS k", "id")
        got = by_group(df, ["k"], ["id"], ["id"], lambda x: [[len(x)] * len(x), list(range(len(x)))], "n bigint, place bigint")
        want = {r.k: r.n for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()}
        rows = got.collect()
        assert len(rows) == 500 and all(r.n == want[r.k] for r in rows)
        assert sorted(r.id for r in rows if r.k is None and r.place == r.id) == list(range(200))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_language_parts(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, 9, None]), rng.choice([0, 1, -1]), a := rng.randint(-1, 30), a + rng.randint(-1, 6), rng.choice(["en", "xx", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "pos int, page int, mcid int, first int, last int, lang string")
    got = {r.pos: r.why for r in validate.language_parts(df, 2, spark.createDataFrame([("en",), ("en",)], "lang string")).collect()}
    kept, want = {}, {}
    for pos, page, mcid, a, b, lang in rows:
        if page not in (1, 2):
            want[pos] = "page not in the book"
        elif mcid < 0:
            want[pos] = "run (MCID) not a whole number"
        elif not 0 <= a <= b:
            want[pos] = "character indexes not in order"
        elif lang != "en":
            want[pos] = "language tag not allowed"
        elif any(a <= y and b >= x for x, y in kept.get((page, mcid), [])):
            want[pos] = "overlaps another part in the same run"
        else:
            want[pos] = None
            kept.setdefault((page, mcid), []).append((a, b))
    assert got == want


def test_fitting_skips_and_goes_on(spark):
    rows = [("a", 1, 5.0, 10.0), ("a", 2, 6.0, 10.0), ("a", 3, None, 10.0), ("a", 4, 5.0, 10.0), ("b", 1, 99.0, None)]
    out = validate.fitting(spark.createDataFrame(rows, "k string, o int, c double, room double"), ["k"], "o", "c", "room")
    assert {(r.k, r.kept, r.left_out) for r in out.collect()} == {("a", 2, 1), ("b", 1, 0)}


def test_spots_fill_free_columns():
    rng = random.Random(7)
    for _ in range(100):
        cells = sorted((rng.randint(0, 4), rng.randint(0, 3), rng.randint(0, 3)) for _ in range(12))
        taken, last, col = set(), None, 0
        for (r, wide, high), (c0, c1, r1) in zip(cells, grid.spots(cells), strict=True):
            col = 0 if r != last else col
            col = next(c for c in range(col, 99) if (r, c) not in taken)
            assert (c0, c1, r1) == (col, col + max(1, wide), r + max(1, high))
            taken |= {(y, x) for y in range(r, r1) for x in range(c0, c1)}
            last, col = r, c1


def test_headers_of_two_levels_and_groups(spark):
    cells = [
        (1, 0, 0, 1, 2, False), (1, 0, 1, 2, 1, False), (1, 1, 0, 1, 1, False), (1, 1, 1, 1, 1, False), (1, 2, 0, 3, 1, False),
        (1, 3, 0, 1, 1, False), (1, 3, 1, 1, 1, False), (1, 3, 2, 1, 1, True), (2, 0, 0, 1, 1, False), (2, 1, 0, 1, 1, False),
    ]
    df = spark.createDataFrame(cells, "tbl int, r int, i int, colspan int, rowspan int, empty boolean")
    read = spark.createDataFrame([(1, 0, 0, 2, 1, [2], None), (2, None, None, 1, 0, None, None)], "tbl int, title_rows int, note_rows int, header_rows int, header_cols int, group_rows array<int>, repeat_rows array<int>")
    got = {(x.tbl, x.r, x.i): (x.th, x.scope, [tuple(h) for h in x.headers]) for x in grid.headed(df, read).collect()}
    assert got[1, 0, 0] == (True, "Both", []) and got[1, 0, 1] == (True, "Column", []) and got[1, 2, 0] == (True, "Column", [])
    assert got[1, 3, 0] == (True, "Row", [])
    assert got[1, 3, 1] == (False, None, [(0, 1), (1, 0), (3, 0), (2, 0)])
    assert got[1, 3, 2] == (False, None, []) and got[2, 1, 0] == (False, None, [])


def test_band_join(spark):
    rng = random.Random(11)
    a = [(i, rng.choice("xy"), rng.choice([None, float("nan"), float("inf"), rng.uniform(-9, 9)])) for i in range(60)]
    b = [(i, rng.choice("xy"), rng.choice([None, rng.uniform(-9, 9)])) for i in range(60)]
    got = bands.band_join(spark.createDataFrame(a, "a int, k string, x double"), spark.createDataFrame(b, "b int, k string, y double"), ["k"], "x", "y", 1.5)
    near = lambda x, y: x is not None and y is not None and abs(x - y) <= 1.5
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((p, q) for p, k, x in a for q, m, y in b if k == m and near(x, y))


def test_forms(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("r")).first().r
    for word, want in [("iii", False), ("antiing", True), ("a;b", True), ("koreatimeshawaii.com", False), ("Hawai‘i", True), ("don't", False), ("", False), (None, False)]:
        assert one(forms.suspect, word) is want, word
    for label, want in [("•", True), ("(iv)", True), (" 12 .", True), ("Note", False), ("", False), (None, False), ("a", False)]:
        assert one(forms.list_marker, label) is want, label
    assert one(forms.core, "'āina,") == "āina"
    assert one(forms.iso, "2026-02-30 06:19") == (2026, 2, 30, 6, 19) and one(forms.iso, "2026-11-15Z").hour is None
    assert one(forms.iso, "2026-13-01") is None and one(forms.iso, "soon") is None and one(forms.iso, None) is None


def test_verdict(spark):
    rows = [("ja-Latn", None, ["ja"], "script"), ("zh", None, ["zh", "yue"], "right"), ("yue", None, ["zh"], "wrong"), ("fr", "low", ["fr"], "unsure"), (None, None, ["fr"], "untagged")]
    df = spark.createDataFrame(rows, "lang string, conf string, accept array<string>, want string")
    got = df.select("want", forms.verdict(F.col("lang"), F.col("conf"), F.lit(None).cast("string"), F.lit(True), F.col("accept")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def plain_cost(a, b):
    a, b = words.bare(a), words.bare(b)
    row = [float(j) for j in range(len(b) + 1)]
    table = {(0, j): row[j] for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        p = 0.25 if x in words.JUNK else 1.0
        table[i, 0] = table[i - 1, 0] + p
        for j, y in enumerate(b, 1):
            table[i, j] = min(table[i - 1, j] + p, table[i, j - 1] + 1, table[i - 1, j - 1] + (0 if x == y else p))
    return table[len(a), len(b)]


def test_words(spark):
    rng = random.Random(13)
    for _ in range(200):
        a, b = ("".join(rng.choice("abil;ñt") for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert words.edit_cost(a, b) == pytest.approx(plain_cost(a, b))
    cases = [("Molokai", "Molokaʻi", None), ("a", "sea", "too different"), ("th", "the", "too different"), ("p0", "pō", None), ("x", "x", "same"), ("x", "x y", "not one word"), ("abcdef", "uvwxyz", "too different")]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    assert all(r.want == r.got for r in df.select("want", words.reading_refusal("a", "b").alias("got")).collect())
    df = spark.createDataFrame([("Ab c", "abC", "é"), (None, "x", None)], "a string, b string, c string")
    got = df.select(words.same_form("a", "b").alias("s"), words.skeleton("c").alias("k"), words.character_error_rate("a", "b").alias("e")).collect()
    assert (got[0].s, got[0].k, got[1].s, got[1].k, got[1].e) == (True, "e", None, None, None)
    pair = spark.createDataFrame([(["Molokai", "is", "fax"], ["Molokaʻi", "is", "far", "off"]), (None, ["x"])], "a array<string>, b array<string>")
    got = [r.x.asDict(True) for r in pair.select(words.aligned("a", "b").alias("x")).collect()]
    assert (got[0]["paired"], got[0]["changed"], got[0]["unpaired"], got[0]["changes"]) == (2, 1, 1, [{"place": 0, "word": "Molokaʻi"}])
    assert got[1]["paired"] == 0


def fold(events):
    state = None
    for why in events:
        if state in outcomes.REFUSALS and why in ("saved", "not_run") or why == "saved" and state in outcomes.ENDED:
            continue
        state = why
    return state


def test_outcomes_over_tables_and_streams(spark, tmp_path):
    rng = random.Random(17)
    kinds = ["saved", "not_run", "done", "error", "cap", "declined"]
    rows = [(k, i, rng.choice(kinds)) for k in range(80) for i in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "k int, seq int, why string")
    want = {k: fold([w for kk, _, w in rows if kk == k]) for k in range(80)}
    state = lambda s: outcomes.outcome(s, ["k"], "seq", "why")
    assert {r.k: r.outcome for r in state(df).collect()} == want
    folder = str(tmp_path / "in")
    df.repartition(5).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    assert {r.k: r.outcome for r in outcomes.drained(spark, stream, state).collect()} == want
    last = outcomes.latest(df, ["k"], "seq")
    assert last.columns == df.columns and {r.k: r.seq for r in last.collect()} == {k: max(s for kk, s, _ in rows if kk == k) for k in range(80)}


def test_inherited(spark):
    rng = random.Random(19)
    rows = [(i, None if i < 3 else rng.randint(max(0, i - 3), i - 1), rng.choice([None, None, f"v{i}"])) for i in range(90)]
    rows += [(200, 201, "x"), (201, 200, None), (300, 999, None), (5, rows[5][1], rows[5][2])]
    by = {n: (p, v) for n, p, v in rows}

    def climb(n, steps=0):
        p, v = by[n]
        if steps > 100:
            return None, v
        if p not in by:
            return 0, v
        d, above = climb(p, steps + 1)
        return None if d is None else d + 1, v if v is not None else above

    got = {r.n: (r.depth, r.inherited) for r in trees.inherited(spark.createDataFrame(rows, "n int, p int, v string"), "n", "p", "v").collect()}
    want = {n: climb(n) for n in by if n not in (200, 201)}
    assert {n: x for n, x in got.items() if n not in (200, 201)} == want
    assert got[200][0] is None and got[201] == (None, "x")
    assert trees.inherited(spark.createDataFrame([], "n int, p int, v string"), "n", "p", "v").count() == 0


def test_work_order(spark):
    make = spark.createDataFrame
    whys = lambda df, key: {r[key]: r.why for r in df.collect()}
    got = whys(workorder.rolemap(make([("a", "P"), ("b", "Figure"), ("c", "P"), (None, "P"), ("d", None)], "style string, target string"), make([("a",), ("b",), ("d",), ("a",)], "s string")), "style")
    assert got == {"a": None, "b": "target not allowed", "c": "unknown style", None: "unknown style", "d": "target not allowed"}
    got = whys(workorder.retypes(make([(1, "Figure"), (2, "Table"), (3, "P")], "obj int, type string"), make([(1,), (2,)], "o int")), "obj")
    assert got == {1: None, 2: "type not allowed", 3: "unknown obj"}
    objects = make([(i,) for i in range(1, 6)], "o int")
    got = whys(workorder.alts(make([(1, "a"), (2, " \n"), (3, "a"), (4, "a"), (9, "a")], "obj int, alt string"), objects, make([(1,), (2,), (4,)], "o int"), make([(4,)], "o int")), "obj")
    assert (got[1], got[2], got[3], got[9]) == (None, "not a figure or empty alt", "not a figure or empty alt", "unknown obj") and got[4].startswith("its image was not sent")
    items = make([(1, "Molokaʻi"), (2, "x"), (3, "is"), (4, " "), (5, "a b"), (6, "uvwxyz"), (7, "a" * 81), (8, "x"), (9, None)], "id int, reads string")
    scanned = make([(1, "Molokai"), (3, "is"), (4, "is"), (5, "is"), (6, "abcdef"), (7, "a"), (8, "y"), (9, "z")], "id int, text string")
    got = whys(workorder.word_readings(items, scanned, make([(i,) for i in (1, 3, 4, 5, 6, 7, 9)], "id int")), "id")
    far = "too different from the OCR text to be a misreading of it"
    assert got == {1: None, 2: "unknown id", 3: "same as the OCR text", 4: "empty", 5: "not one word", 6: far, 7: "not one word", 8: "its word sheet was not sent", 9: "empty"}
    got = whys(workorder.page_readings(make([(1, 2, " "), (2, 2, "a"), (3, 2, "b"), (4, 9, "c"), (5, None, "c"), (6, 1, "d")], "pos int, page int, text string"), 5), "pos")
    assert got == {1: "empty", 2: None, 3: "the same page twice", 4: "bad page", 5: "bad page", 6: None}
    out = workorder.deferral_pages(make([("a", [1, 9, None]), ("b", [2]), ("c", [0]), ("d", None)], "what string, pages array<int>"), 5)
    cut = "not PDF page numbers in range"
    assert {r.what: (r.pages, r.why) for r in out.collect()} == {"a": ([1], cut), "b": ([2], None), "c": (None, cut), "d": (None, None)}
