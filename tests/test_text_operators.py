"""Syllables, readings, places, gaps and levels by values worked out by hand and by brute force."""

import random
import re
import time
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from leafmend import catalog
from leafmend.functions import syllables
from leafmend.operators import nearest, ranges, readings, text_queries
from leafmend.plans.dialect import Spark
from leafmend.sources import shared

HAN = "[㐀-鿿]"


def test_syllables_by_hand(spark):
    ja, zh, both = ("nihon", "kyoto", "n", "shippei", "kanbun"), ("zhongguo", "qianyan", "guanshiyin", "er", "nong"), ("fujo", "pusa", "hojo", "kegare")
    neither = ("", "mappq", "annals", "7", "zh", "ko to", "the")
    rows = spark.createDataFrame([(w,) for w in (*ja, *zh, *both, *neither, "NIHON", None, "lüe", "lüan", "é")], "w string")
    out = {r.w: r for r in rows.select("w", *(syllables.spelled(F.col("w"), s).alias(n) for n, s in (("ja", syllables.japanese()), ("zh", syllables.pinyin()), ("zhu", syllables.pinyin(True)))), syllables.romanized(F.col("w")).alias("r")).collect()}
    for w in (x for x in out if x):
        assert (out[w].ja, out[w].zh, out[w].zhu) == tuple(bool(re.match(p, w.lower())) for p in (syllables.JAPANESE, syllables.PINYIN, syllables.PINYIN_U)), w
    assert all(out[w].ja for w in (*ja[:3], *both, "NIHON")) and not any(out[w].r for w in neither) and all(out[w].zh for w in zh)
    assert out[None].ja is None and out["lüe"].zhu and not out["lüe"].ja and out["é"].r and not out["é"].ja


def test_syllables_take_linear_time(spark):
    """Words that a backtracking expression would not finish: every syllable may end in several places, the last letter fits none."""
    took = []
    for n in (50_000, 100_000):
        df = spark.createDataFrame([("nangang" * (n // 7) + "x",), ("n" * n + "q",), ("iao" * (n // 3) + "b",)], "w string").repartition(1).cache()
        df.count()
        began = time.time()
        assert [r[0] for r in df.select(syllables.spelled(F.col("w"), syllables.pinyin())).collect()] == [False] * 3
        took.append(time.time() - began)
    assert took[1] < 60


def test_marks_go_from_letters():
    assert dict(zip(*syllables.marked(), strict=True))["ū"] == "u" and dict(zip(*syllables.marked(True), strict=True))["ǚ"] == "ü"


def said(spark, texts, toned=False, listed=("the", "again", "later", "and", "fan", "in", "appear", "is", "called")):
    docs = spark.createDataFrame([(i, b, t) for i, (b, t) in enumerate(texts)], "doc_id long, book string, text string")
    docs = docs.select("doc_id", "book", F.split("text", " ").alias("pieces"))
    places = readings.around(docs, lambda x: x.rlike(HAN))
    books = docs.select("book").distinct().withColumn("toned", F.lit(toned))
    return readings.beside(places, spark.createDataFrame([(w,) for w in listed], "word string"), books)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("appear in the Wakan rōeishū: 扶桑豈無影乎 Is", []),  # a colon introduces
        ("called Kūkai ; 空海", []),
        ("(Kūkai 空海 )", [("ja", "Kūkai")]),
        ("youguan gailiang” 全國生產", [("zh", "gailiang")]),  # youguan has a Japanese shape too
        ("Bunka. Tokyo: Kōdansha. 自然と文化", []),
        ("the fan (fujō 不浄 ). later", [("ja", "fujō")]),
        ("Kūkai , 空海", [("ja", "Kūkai")]),  # punctuation alone between
        ("soju 소주 su 酥", []),  # a reading two pieces away is the entry's before; su is too short
        ("the 東 とうきょう tokyo", [("ja", "とうきょう")]),
        ("the 東 zhongguo", []),  # a romanization after is the next entry's
        ("a b c zhongwen zhongwen zhongwen zhongwen 中", [("zh", "zhongwen")] * 3),
        ("中", []),
        ("the 中 again", []),
    ],
)
def test_what_stands_beside(spark, text, want):
    (row,) = said(spark, [("b", text)]).collect()
    assert [(r["r"], r["core"]) for r in row.readings] == want


def test_evidence_of_forms(spark):
    texts = [("b", "the fan (fujō 不浄 ). later fujō 不浄 again"), ("c", "the fan (fujō 不浄 ). later the 不浄 again"), ("d", "(fujō 不浄 ) and (zhongwen 不浄 )"), (None, "the 不浄 again"), ("e", None), ("f", "")]
    got = {r.book: r for r in readings.evidence(said(spark, texts), F.regexp_replace("piece", "[^㐀-鿿]", "")).collect()}
    facts = {b: (r.places, r.with_one, r.none, r.mixed, r.langs, r.lang, r.reading, r.decided) for b, r in got.items()}
    assert facts == {
        "b": (2, 2, 0, 0, "ja", "ja", "fujō", True), "c": (2, 1, 1, 0, "ja", "ja", "fujō", False),
        "d": (2, 2, 0, 0, "ja,zh", None, "fujō", False), None: (1, 0, 1, 0, "", None, None, False),
    }


def test_subjects_and_tones_change_readings(spark):
    assert [r.subject for r in said(spark, [("k", "소주 소주 소주 酒 소주 x (fujō 不浄")]).collect()] == ["korea"] * 2
    (korean,) = [r for r in readings.evidence(said(spark, [("k", "소주 소주 소주 酒 소주 x (fujō 不浄")]), F.col("piece")).collect() if r.form == "不浄"]
    assert (korean.none, korean.with_one) == (1, 0)  # Hepburn in a book on Korea is no reading
    assert said(spark, [("t", "dōu 都")], toned=True).collect()[0].readings == [] and said(spark, [("t", "dōu 都")]).collect()[0].readings[0]["r"] == "ja"


def test_places_are_not_gathered_from_their_pieces(spark):
    plan = said(spark, [("b", "the fan (fujō 不浄 ). later a b fujō jōdo ; 不浄 again"), ("c", "zhongwen , 中 とうきょう")])
    assert "collect_list" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {(r.book, r.at): [x["core"] for x in r.readings] for r in plan.collect()} == {("b", 3): ["fujō"], ("b", 11): [], ("c", 2): ["zhongwen"]}


def test_places_are_taken_by_native_functions_once(spark, monkeypatch):
    """No function over a text's pieces runs as an interpreted lambda, and a text is cut once for its places, once for the words listed."""
    plans, kept = {}, readings.stored
    for module in (readings, text_queries):
        monkeypatch.setattr(module, "stored", lambda df, what, *p: (plans.update({what: df._jdf.queryExecution().executedPlan().toString()}), kept(df, what, *p))[1])
    out = catalog.queries()["readings_beside"](spark, "/root/testdata/sf0.001")
    assert "lambdafunction" not in plans["around"] and plans["around"].count("regexp_extract_all") == 1
    assert "lambdafunction" not in plans["near-pieces"]
    assert spark.conf.get("spark.sql.optimizer.excludedRules", None) is None
    assert out.count() > 0


def test_mute_pieces_prove_nothing(spark):
    """Runs of pinyin's syllables are never told to be none, whatever letters meet; pieces of other letters are never mute."""
    plain, mute = re.compile(readings.NO_PINYIN), re.compile(readings.MUTE.removeprefix("(?i)"), re.IGNORECASE)
    every = sorted(set(syllables.pinyin(True)))
    assert not [a for a in every if plain.search(a) or plain.search(a + a)]
    ends, starts = {a[-2:] for a in every}, {a[:2] for a in every}
    assert not [(a, b) for a in ends for b in starts if plain.search(a + b + "a")]
    assert not [p for p in ("zhongwen", "Gailiang,", "seoul", "Kōdansha", "ŏ", "不浄", "とう", "소주", "zhong-guo", "er,", "tang.") if len(p) > 4 and mute.search(p)]
    assert all(mute.search(p) for p in ("the", "words", "English.", "text,", "la"))
    words = spark.createDataFrame([(w,) for w in ("zhongwen", "words", "Words,", "people", "long")], "w string")
    assert [r.m for r in words.select(F.col("w").rlike(readings.MUTE).alias("m")).collect()] == [False, True, True, False, False]


ENGLISH = "the word and here an long standing infor mation information oppor opportunities tunities a rule keg are rite sutra is we make home rejoin old practices".split()


def places(spark, *texts):
    spark.createDataFrame([(i, r, line) for i, t in enumerate(texts) for r, line in enumerate(t.split("\n"))], "doc_id long, run int, line string").createOrReplaceTempView("given_runs")
    spark.createDataFrame([(w,) for w in ENGLISH], "word string").createOrReplaceTempView("given_words")
    found = text_queries.found_places(spark, "runs AS (SELECT * FROM given_runs), wordlist AS (SELECT * FROM given_words)")
    return [(r.doc_id, r.run, r.w0, r.w1, r.form, r.classes, r.half, r.whole) for r in found.orderBy("doc_id", "run", "w0").collect()]


def test_places_words_and_halves(spark):
    got = places(spark, "The word mappō and onryō here.\nAn oppor-\ntunities word.\nThe ʻāina mōʻī word.", "A long-\nstanding rule, and infor-\nmation here.", "The sutra qianyan guanshi-\nyin pusa here.\nA keg-\nare rite.", "")
    assert got == [
        (0, 0, 2, 2, "mappō", "hawaiian", False, False), (0, 0, 4, 4, "onryō", "marks", False, False), (0, 3, 1, 2, "ʻāina mōʻī", "hawaiian", False, False),
        (2, 0, 2, 3, "qianyan guanshiyin", "unknown", False, False), (2, 1, 0, 0, "qianyan guanshiyin", "unknown", True, False), (2, 1, 1, 1, "pusa", "unknown", False, False),
        (2, 2, 1, 1, "kegare", "unknown", False, False), (2, 3, 0, 0, "kegare", "unknown", True, False),
    ]


def test_words_of_places_are_exchanged_once_and_deleted(spark):
    from leafmend import catalog

    found = catalog.queries()["candidate_places"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # phrases by text; not words, and not once for each join
    kept = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    assert not any("place-words" in f.getPath().getName() for f in kept.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(kept))


def test_words_of_place_forms_never_move(spark, monkeypatch):
    """Words stay in their buckets though rare forms' classes are looked up, and are deleted."""
    plans, bucketed = {}, text_queries.bucketed
    monkeypatch.setattr(text_queries, "FREQUENT", 100)
    monkeypatch.setattr(text_queries, "bucketed", lambda df, what, *keys: (plans.update({what: df._jdf.queryExecution().executedPlan().toString()}), bucketed(df, what, *keys))[1])
    want = spark.createDataFrame(catalog.queries()["candidate_places"](spark, "/root/testdata/sf0.001").collect())
    forms = catalog.queries()["place_forms"](spark, "/root/testdata/sf0.001")
    moved = [line for line in plans["place-items"].splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert moved and all("REPARTITION_BY_NUM" in line for line in moved)  # rare forms' classes and rejoined halves
    got = {(r.form, r.grp): (r.places, r.documents, r.classes) for r in forms.collect()}
    assert sum(n for n, _, _ in got.values()) == want.count()
    assert Counter(k[0] for k, (_, n, _) in got.items() for _ in range(n)) == Counter(r.form for r in want.select("doc_id", "form", text_queries._group(F.col("classes")).alias("grp")).distinct().collect())
    kept = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    left = [f.getPath().getName() for f in kept.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(kept)]
    assert not any("place-words" in f for f in left)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_rare_words_meet_their_classes_by_merge(spark, monkeypatch):
    """A hash table of a bucket's rare words could not go to disk; frequent words meet no table but the broadcast one."""
    plans, bucketed = {}, text_queries.bucketed
    monkeypatch.setattr(text_queries, "FREQUENT", 100)
    monkeypatch.setattr(text_queries, "bucketed", lambda df, what, *keys: (plans.update({what: df._jdf.queryExecution().executedPlan().toString()}), bucketed(df, what, *keys))[1])
    rare = {tuple(r) for r in catalog.queries()["place_forms"](spark, "/root/testdata/sf0.001").drop("id").collect()}
    assert "ShuffledHashJoin" not in plans["place-items"] and "SortMergeJoin [doc_id" in plans["place-items"]
    monkeypatch.setattr(text_queries, "FREQUENT", 10**9)
    assert rare == {tuple(r) for r in catalog.queries()["place_forms"](spark, "/root/testdata/sf0.001").drop("id").collect()}


def test_words_are_cut_where_the_plain_class_cuts_them(spark):
    """Letters told first change no word: every character of the classes' ranges beside letters, and a long word."""
    signs = [chr(c) for c in (*range(9, 14), *range(28, 0x250), 0x1680, *range(0x2000, 0x2030), 0x205F, 0x2060, 0x3000, 0x3040, 0x30FF, 0x4E00, 0xAC00, 0x1F600)]
    rows = spark.createDataFrame([(f"a{s}é{s}{s}Z.{s}",) for s in signs] + [("xé" * 50_000 + " y",), ("",), (None,)], "line string")
    plain = Spark()
    plain.no_cut = lambda negated: negated
    cut = rows.select(F.expr(text_queries.places.cut_words(Spark(), "line")).alias("a"), F.expr(text_queries.places.cut_words(plain, "line")).alias("b"))
    assert cut.where("NOT a <=> b").count() == 0 and cut.where("size(a) > 1").count() > 20


def test_snippets_of_a_text(spark):
    lines = [["a", "--", "b"], [], list("cdefghijklm"), ["n", "1", "o"]]
    mark = lambda form, run, w0, w1, request=1: {"request": request, "id": form, "run": run, "w0": w0, "w1": w1}
    assert text_queries.snippets_of(lines, [mark(7, 0, 0, 0)]) == [(1, 1, 12, "7", "a -- b c d e f g h i j k")]
    assert text_queries.snippets_of(lines, [mark(7, 3, 2, 2), mark(12, 0, 2, 2)]) == [(1, 1, 17, "7,12", "a -- b c d e f g h i j k l m n 1 o")]
    assert [s[:4] for s in text_queries.snippets_of(lines, [mark(7, 3, 2, 2, 2), mark(12, 0, 2, 2)])] == [(1, 1, 13, "12"), (2, 6, 17, "7")]


def test_places_islands_and_passages(spark):
    got = places(
        spark, "E iho ana o luna here\nwe make a home\nqianyan zhibing heyao pusa jingdian nangajuk-\nwama is a word.", "The word Ελληνικά and 東京 大阪, and 漢x; https://a.org 1984 xiv", "Sørensen déjà here", "wholeword"
    )
    assert got == [
        (0, 0, 0, 4, "E iho ana o luna", "hawaiian", False, False),
        (0, 2, 0, 5, "qianyan zhibing heyao pusa jingdian nangajukwama", "passage,unknown", False, True), (0, 3, 0, 0, "qianyan zhibing heyao pusa jingdian nangajukwama", "passage,unknown", True, False),
        (1, 0, 2, 2, "Ελληνικά", "script:greek", False, False), (1, 0, 4, 5, "東京 大阪", "cjk", False, False), (1, 0, 8, 8, "漢", "cjk", False, False),
        (2, 0, 0, 1, "Sørensen déjà", "accented", False, False), (3, 0, 0, 0, "wholeword", "unknown", False, True),
    ]


def test_gaps_against_a_users_own_rhythm(spark):
    """An hour at least, and 2.5 times the user's upper median: the slow user's day is one session, the quick one's is cut."""
    slow, quick = [0, 7200, 14400, 21600, 40000], [0, 60, 120, 4000, 4060]
    rows = [(u, f"2024-01-01 {s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}") for u, times in ((1, slow), (2, quick), (3, [5])) for s in times]
    events = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(rows)], "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "CAST(ts AS timestamp_ntz) AS ts")
    events.createOrReplaceTempView("events")
    got = sorted(map(tuple, spark.sql(catalog.plans()["adaptive_sessions"](Spark())).collect()))
    # slow: gaps 7200 x 3 and 18400, upper median 7200, cut over 18000; quick: gaps 60 x 3 and 3880, upper median 60, cut over 3600.
    assert got == [(1, 0, 4, 0, 21600.0, 7200.0), (1, 1, 1, 4, 0.0, 7200.0), (2, 0, 3, 5, 120.0, 60.0), (2, 1, 2, 8, 60.0, 60.0), (3, 0, 1, 10, 0.0, None)]


def nearest_by_hand(values, equal, later):
    order = list(enumerate(values))[:: -1 if later else 1]
    out = {}
    for k, (i, v) in enumerate(order):
        fits = [j for j, w in order[:k] if v is not None and w is not None and (w <= v if equal else w < v)]
        out[i] = fits[-1] if fits else None
    return out


@pytest.mark.parametrize(("equal", "later"), [(False, False), (True, False), (False, True), (True, True)])
def test_nearest_smaller_over_many_ranges(spark, equal, later):
    r = random.Random(5)
    groups = {"hot": [r.choice([None, *range(9)]) for _ in range(400)], "up": list(range(60)), "down": list(range(60, 0, -1)), "same": [4] * 30, "one": [1], None: [3, 1, 2, None, 2]}
    rows = [(k, i, v, "clash") for k, values in groups.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, i long, v int, until string").repartition(5)
    got = {(x.k, x.i): x.to for x in nearest.nearest_smaller(df, ["k"], "i", "v", "i", "to", equal, later).collect()}
    assert got == {(k, i): j for k, values in groups.items() for i, j in nearest_by_hand(values, equal, later).items()}
    assert nearest.nearest_smaller(df.where("false"), ["k"], "i", "v", "i", "to").count() == 0


def test_nearest_smaller_of_a_million_rows_of_one_key(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("0 AS k", "id AS i", "CASE WHEN id = 0 THEN 0L ELSE id % 1000 + 1 END AS v")
    out = nearest.nearest_smaller(df, ["k"], "i", "v", "i", "to")
    assert out.where("i > 0 and to <> CASE WHEN v = 1 THEN 0 ELSE i - 1 END").count() == 0 and out.where("to is null").count() == 1


def test_running_sums_over_ranges(spark):
    r = random.Random(8)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, 1, 2, 5]), r.random()) for i in range(700)] + [("z", 1, 3, 0.5)]
    df = spark.createDataFrame(rows, "k string, i long, n int, x double").repartition(7)
    got = {(x.k, x.i): (x.so_far_n, x.so_far_x) for x in ranges.running(df, ["k"], ["i"], ["n", "x"]).collect()}
    want, total = {}, {}
    for k, i, n, x in sorted(rows, key=lambda t: (t[0] or "", t[1])):
        a, b = total.get(k, (0, 0.0))
        total[k] = want[k, i] = (a + (n or 0), b + x)
    assert got.keys() == want.keys() and all(got[w][0] == want[w][0] and abs(got[w][1] - want[w][1]) < 1e-9 for w in want)
    assert {(x.k, x.i): x.place for x in ranges.numbered(df, ["k"], ["i"]).collect()} == {(k, i): sum(k == a and i >= b for a, b, *_ in rows) for k, i, *_ in rows}
    assert ranges.running(df.where("false"), ["k"], ["i"], ["n"]).count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Session:
        sparkContext = type("C", (), {"master": "spark://host:7077"})
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_path(Session(), "x")
    assert all(a != b for a, b in pairwise(shared.shared_path(spark, "x") for _ in range(3)))
