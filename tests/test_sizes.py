"""Work that grows no faster than its tables."""

from leafmend import catalog
from leafmend.functions import words
from leafmend.operators import moved, validate

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_a_tag_do_not_meet_in_one_task(spark):
    parts = spark.createDataFrame([(1, 1, 0, 0, 3, "en"), (2, 1, 0, 4, 5, "xx"), (3, 1, 0, 6, 7, None)], "pos long, page long, mcid long, first long, last long, lang string")
    found = validate.language_parts(parts, 2, spark.createDataFrame([("en",), ("en",)], "lang string"))
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    assert {r.pos: r.why for r in found.collect()} == {1: None, 2: "language tag not allowed", 3: "language tag not allowed"}


def test_checklists_are_not_laid_out_for_each_evaluation(spark):
    found = catalog.queries()["checklists"](spark, SMALL)
    assert plan(found).count("Join") <= 3  # lines with their parts, answers with their items, counts with the section's


def test_words_of_two_texts_travel_once(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["b", "a"]), (2, ["a"], ["a"]), (3, None, ["a"]), (4, ["a", "b"], None)], "id long, a array<string>, b array<string>")
    found = moved.moved_fragments(pairs, "a", "b")
    assert "_a#" not in plan(found) and "_b#" not in plan(found)
    assert {r.id: (r.stayed, r.moved, r.lost) for r in found.collect()} == {1: (1, 1, 0), 2: (1, 0, 0), 3: (0, 0, 0), 4: (0, 0, 2)}


def test_bags_of_characters_in_one_pass():
    every = "".join(map(chr, range(0x4E00, 0x9F00))) * 5
    assert words.gap("aab", "abc") == 2 and words.gap("", "") == 0 and words.gap("𝒳é", "é") == 1 and words.gap(every, every[::-1] + "x") == 1


def test_syllables_are_read_once_for_each_word(spark):
    found = catalog.queries()["syllable_shapes"](spark, SMALL)
    assert "keys=[w#" in plan(found)  # pieces are counted before they become words


def test_parts_of_plans_are_no_queries():
    assert not {"steps", "cut_words", "classed_words"} & (catalog.queries().keys() | catalog.oracle_sql().keys())


def test_forms_of_pages_are_judged_in_one_pass(spark):
    assert plan(catalog.queries()["hawaiian_pages"](spark, SMALL)).count("Join") <= 3  # forms with words of the list, places with forms, documents with shares
