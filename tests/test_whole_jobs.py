"""Jobs done whole: what a review found cut."""

from leafmend import catalog
from leafmend.operators import copies
from leafmend.plans.dialect import Spark

def _rows(spark, name, **tables):
    """A plan's rows over small tables."""
    sql = catalog.plans()[name](Spark())
    for t, df in tables.items():
        df.createOrReplaceTempView(t)
    return spark.sql(sql).collect()


def test_asof_predicts_every_order(spark):
    day = lambda n: f"2020-01-0{n}"
    rows = [(1, 7, 100.0, day(1)), (2, 7, 200.01, day(2)), (3, 7, 5.0, day(2)), (4, 7, 1.0, day(3)), (5, 8, 400000.0, day(1)), (6, None, 1.0, day(1)), (7, None, 1.0, day(2)), (8, 7, 2.0, None)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string")
    got = {r.o_orderkey: (r.seen, r.predicted) for r in _rows(spark, "asof_backtest", orders=orders)}
    assert got == {1: (0, None), 2: (1, 100.0), 3: (1, 100.0), 4: (3, 101.67), 5: (0, None), 6: (0, None), 7: (0, None), 8: (0, None)}


def test_mcnemar_counts_all_discordant_pairs(spark):
    pairs = [(1, 0)] * 10 + [(0, 1)] * 2 + [(1, 1)] * 3
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(pairs, 1)], "doc_id long, quality long, toxic long")
    documents = spark.createDataFrame([(i, "s") for i in range(1, len(pairs) + 1)], "doc_id long, source string")
    (row,) = _rows(spark, "mcnemar_exact", labels=labels, documents=documents)
    assert (row.b, row.c, row.p) == (10, 2, round(2 * (1 + 12 + 66) / 2**12, 6))


def test_junk_has_all_rules(spark):
    texts = ["f7 MBH #x a*b (c®) 12 3rd 4a 1990s Word AE 漢7 “–” x", "plain words", "", None]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.tokens, r.junk, r.flagged) for r in _rows(spark, "junk_stats", documents=documents)}
    assert got == {0: (13, 5, False), 1: (2, 0, False), 2: (0, 0, False), 3: (0, 0, False)}


def test_suspect_words_and_wordlike_words(spark):
    texts = ["a A I b é x, don't re-do h3llo t;l¢e n¢d u7 a*b", "brr 漢 (word) x2 Ab, hm ½y ok", ""]
    documents = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    (row,) = _rows(spark, "text_quality_by_source", documents=documents.where("doc_id = 0"))
    assert (row.tokens, row.suspect) == (13, 6)
    got = {r.doc_id: (r.tokens, r.wordlike) for r in _rows(spark, "textlike_gate", documents=documents)}
    assert got == {0: (13, 0), 1: (8, 5), 2: (0, 0)}


def test_copied_runs_cross_and_split_sentences(spark):
    items = spark.createDataFrame([(1, "One short. Sentences that end. Here and there, often."), (2, "abcdefghij KLMNOPQRSTU"), (3, "too short"), (4, None)], "item_id long, text string")
    texts = ["Quoted: sentences THAT end. here and x", "xxabcdefghijk lmnopqrstyy", "abcdefghijklmnopqrs", None, "aabcdefghij klmnopqrstu"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, copies.shared_runs(items, docs).collect())) == [(1, 0, 5), (2, 1, 1), (2, 4, 2)]
    assert copies.shared_runs(items.where("false"), docs).count() == 0 == copies.shared_runs(items, docs.where("false")).count()
