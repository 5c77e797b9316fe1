"""Moved fragments, page shares, content out of reach, figures' answers, costs and back matter by values worked out by hand."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from leafmend import catalog
from leafmend.operators import moved
from leafmend.plans import pages
from leafmend.plans.dialect import Spark


def test_moved_by_hand():
    w = str.split
    assert moved.compared(w("one two three four five six"), w("four five six one two three")) == (3, 3, 0, ["four five six"])
    assert moved.compared(w("a b c d"), w("a b c d")) == (4, 0, 0, []) and moved.compared(w("a b"), w("c d")) == (0, 0, 2, [])
    assert moved.compared(w("x x x y"), w("y x x")) == (3, 0, 1, []) or moved.compared(w("x x x y"), w("y x x"))[2] == 3
    assert moved.compared(w("the cat sat here now"), w("now the cat sat")) == (3, 1, 1, ["now"])
    assert moved.compared([], w("a")) == (0, 0, 0, []) and moved.compared(w("a"), []) == (0, 0, 1, [])


def test_kept_order_is_the_heaviest():
    r = random.Random(4)
    for _ in range(300):
        n = r.randrange(1, 9)
        runs = [(i * 10, j * 10, r.randrange(1, 4)) for i, j in enumerate(r.sample(range(n), n))]
        got = moved.in_order(runs)
        places = [runs[i][1] for i in sorted(got)]
        assert places == sorted(places)
        best = max(sum(runs[i][2] for i in c) for k in range(n + 1) for c in combinations(range(n), k) if [runs[i][1] for i in c] == sorted(runs[i][1] for i in c))
        assert sum(runs[i][2] for i in got) == best


def test_moved_runs_are_equal_and_apart():
    r = random.Random(9)
    for _ in range(200):
        a = [r.choice("abcdefghij") + r.choice("xyz") for _ in range(30)]
        b = a[:]
        for _ in range(3):
            i, j = sorted(r.sample(range(30), 2))
            b = b[:i] + b[j:] + b[i:j]
        runs = moved.anchors(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in runs) and all(x[0] + x[2] <= y[0] for x, y in zip(runs, runs[1:], strict=False))
        stay, gone, lost, _ = moved.compared(a, b)
        assert stay + gone + lost == 30


def test_moved_on_rows(spark):
    rows = [(1, ["a", "b"], ["a", "b"]), (2, ["a", "b", "c"], ["c", "a", "b"]), (3, None, ["a"]), (4, ["a"], None), (5, [], []), (6, ["z"] * 40_000, ["z"] * 40_000 + ["y"]), (7, [str(i) for i in range(30_000)], [str(i) for i in range(15_000, 30_000)] + [str(i) for i in range(15_000)])]
    got = {r.id: (r.stayed, r.moved, r.lost, len(r.fragments)) for r in moved.moved_fragments(spark.createDataFrame(rows, "id long, a array<string>, b array<string>"), "a", "b").collect()}
    assert got == {1: (2, 0, 0, 0), 2: (2, 1, 0, 1), 3: (0, 0, 0, 0), 4: (0, 0, 1, 0), 5: (0, 0, 0, 0), 6: (0, 0, 40_000, 0), 7: (15_000, 15_000, 0, 1)}


def ask(spark, name, own=None, **tables):
    for t, df in tables.items():
        df.createOrReplaceTempView(t)
    return [tuple(r) for r in spark.sql(catalog.plans()[name](Spark(own))).collect()]


def test_hawaiian_and_foreign_pages(spark):
    haw = "aloha mākou hale nani wahine kāne moku honua kaulana pūkele lani ʻāina moana mahina kumu keiki hānau hoʻokipa aliʻi makani"
    english = "the house stands near a river with garden trees"
    texts = [haw, haw + " " + " ".join(["whare"] * 10), haw + " " + english, "few words", "", None, " ".join(["tonga"] * 30)] + [english] * pages.LISTED
    rows = [(i, "en" if i > 6 else "haw", t) for i, t in enumerate(texts)]
    got = {r[0]: r[1:] for r in ask(spark, "hawaiian_pages", documents=spark.createDataFrame(rows, "doc_id long, lang string, text string"))}
    assert got[0] == (1.0, 0.0, True)
    assert got[1] == (round(20 / 30, 6), round(10 / 30, 6), False)  # whare: r is no Hawaiian letter, nor is it English
    assert got[2][2] is True and got[2][1] == 0.0  # English words aren't foreign
    assert got[3] == (None, 1.0, False) and got[4] == got[5] == (None, None, False) and got[6] == (0.0, 1.0, False)


def test_content_out_of_reach(spark):
    own = {
        "runs": [(1, 1, 5, 10.0, 30.0, False), (1, 2, 6, 10.0, 400.0, False), (1, 3, None, 50.0, 60.0, False), (1, 4, None, 50.0, 60.0, True), (1, 5, 7, 210.0, 700.0, False), (2, 6, 5, 0.0, 80.0, False), (3, 7, 8, 0.0, 80.0, False)],
        "owned": [(1, 6), (3, 8)], "figure_boxes": [(1, 40.0, 60.0, 50.0, 70.0), (1, 200.0, 220.0, 0.0, 750.0), (2, 5.0, 9.0, 0.0, 99.0)], "visible": [(1, 10.0, 750.0), (2, 0.0, 800.0), (3, 0.0, 800.0)],
    }
    # Page 1: run 1 is an orphan at the top (20 below the edge), 3 untagged at the top, inside a figure, 5 an orphan at the bottom (690 > 680), inside another; 2 is owned, 4 an artifact.
    assert sorted(ask(spark, "unreached_content", own)) == [(1, 2, 1, 2, 0, 1, 2), (2, 1, 0, 0, 1, 0, 0)]


FIGURES = {
    "figures_sent": [(1, False, 10), (1, True, 3), (2, False, 11), (3, False, 12), (4, False, 13)],
    "figure_replies": [(1, 1, "alt", 10), (1, 2, "alt", 11), (1, 3, "page_figures", 3), (1, 4, "page_figures", 10), (1, 5, "tables", 10), (1, 6, "deferrals", None), (1, 7, "artifacts.elements", 10), (2, 8, "alt", 11), (3, 9, "alt", 12)],
    "request_ends": [(1, "done"), (2, "failed"), (3, "stale")],
    "first_decisions": [(20, "alt", 10), (21, "alt", 11), (22, "retype", 12), (23, "page_figures", 3), (24, "alt", 99), (25, "tables", 10), (26, "alt", 13)],
    "broken_rules": [("r1", 10), ("r1", 11), ("r2", 12), ("r2", 99)],
}


def test_figures_answers_and_their_merge(spark):
    mine = "not one of the figures sent in figure request 1"
    assert {r[1]: r[3] for r in ask(spark, "figure_answers", FIGURES)} == {1: None, 2: mine, 3: None, 4: mine, 5: "not a decision about figures", 6: None, 7: None, 8: None, 9: None}
    got = {(r[0], r[1]): r[3] for r in ask(spark, "merged_figures", FIGURES)}
    seen = "decided in figure request 1, which saw the image"
    assert got == {
        ("first", 20): seen, ("first", 21): "its image was in figure request 2, which did not finish", ("first", 22): "the saved answers of figure request 3 were written for a different figure list",
        ("first", 23): seen, ("first", 24): None, ("first", 25): None, ("first", 26): "its image was in figure request 4, which did not finish",
        ("figure", 1): None, ("figure", 3): None, ("figure", 6): None, ("figure", 7): None,
    }
    assert sorted(ask(spark, "restricted_rules", FIGURES)) == [(1, "r1", 1, "10"), (2, "r1", 1, "11"), (3, "r2", 1, "12")]


COSTS = {
    "runs_made": [(1, 7, 10, False, False), (2, 7, 10, True, False), (3, 7, 0, True, True), (4, None, 5, True, False), (5, 8, 5, False, False)],
    "calls": [(1, "order", 2.0, None), (1, "attempt", 0.5, None), (1, "attempt", None, 0.25), (1, "pages", 1.0, 0.125), (2, "order", 3.0, None), (2, "attempt", 0.25, None), (3, "order", 1.5, None), (4, "order", 9.0, None), (4, "language", 0.75, None)],
    "trashed": [(7, 1.0), (7, 2.5), (9, 4.0)],
}


def test_what_runs_and_batches_cost(spark):
    got = {r[0]: r[2:] for r in ask(spark, "run_costs", COSTS)}
    assert got[1] == (3.5, 0.5, 4, 0.35, False, 3.875, 0.125, "$3.50 ($3.00 + $0.50 for previous attempts)")
    assert got[2] == (0.25, 0.25, 1, 0.025, True, 0.25, 0.0, "$0.25 ($0.25 for previous attempts)")  # a saved reply costs nothing here
    assert got[3] == (1.5, 0.0, 1, None, False, 1.5, 0.0, "$1.50")  # the run paid for that reply itself
    assert got[4] == (0.75, 0.0, 1, 0.15, False, 0.75, 0.0, "$0.75")  # the language step is its own money
    assert got[5] == (0.0, 0.0, 1, None, False, 0.0, 0.0, "$0.00")
    assert sorted(ask(spark, "batch_costs", COSTS)) == [(7, 3, 8.75, 0.75, 3.5), (8, 1, 0.0, 0.0, 0.0), (9, 0, 4.0, 0.0, 4.0)]


def test_back_matter_is_named_whole(spark):
    yes = {
        "BIBLIOGRAPHY": "bibliography", "Selected  Bibliography": "bibliography", "Works Cited": "bibliography", "References": "bibliography", "Glossary": "glossary", "Glossary of Chinese Characters": "glossary", "Character Glossary": "glossary",
        "Index of Poems Cited": "index", "Appendix B: Glossary": "glossary", "Sources Consulted": "bibliography", "List of Characters": "glossary", "The Index": "index", "Sources in Japanese": "bibliography",
    }
    no = ["Sources of Japanese Tradition", "References to the dead", "Index fossils in the strata", "Notes", "Introduction", "Theory of the Index", "", None]
    own = {"headings": [("x", i, t) for i, t in enumerate([*yes, *no])]}
    got = {r[1]: r[2:] for r in ask(spark, "back_matter_headings", own)}
    assert [got[i] for i in range(len(yes))] == [(True, k) for k in yes.values()] and all(got[i] == (False, None) for i in range(len(yes), len(yes) + len(no)))


def test_forms_of_places_are_numbered_in_order(spark):
    rows = [r.asDict() for r in catalog.queries()["place_forms"](spark, "/root/testdata/sf0.001").orderBy("id").collect()]
    from leafmend.operators.text_queries import GROUPS

    assert [r["id"] for r in rows] == list(range(1, len(rows) + 1)) and len({(r["grp"], r["form"]) for r in rows}) == len(rows)
    order = [(GROUPS.index(r["grp"]), r["first_doc"], r["first_run"], r["first_word"]) for r in rows]
    assert order == sorted(order)
    places = catalog.queries()["candidate_places"](spark, "/root/testdata/sf0.001")
    assert sum(r["places"] for r in rows) == places.count() and {r["form"] for r in rows} == {r.form for r in places.select(F.col("form")).distinct().collect()}


def test_names_of_downloads(spark):
    long_ = "é" * 100
    own = {"downloads": [(1, " .My: Book?.pdf", "007", "Ready", None), (2, "a/b|c", None, "Shipped", "3"), (3, "x.PDF", "2", "Shipped", None), (4, "x", "2", "withdrawn", "4"), (5, "", "x", "Not Ready", None), (6, None, "9", "earlier version", None), (7, long_, "1", "Pending Evaluation", None), (8, "...", "1", "odd", None)]}
    got = {r[0]: r[1:] for r in ask(spark, "download_names", own)}
    assert got[1] == ("My_ Book__session-7_not-shipped.pdf", "My_ Book__record_session-7_not-shipped.zip") and got[2] == ("a_b_c.pdf", "a_b_c_record_shipment-3.zip")
    assert got[3] == ("x.pdf", "x_record.zip") and got[4] == ("x_shipment-4_withdrawn.pdf", "x_record_shipment-4_withdrawn.zip")
    assert got[5] == ("book_no-review_not-ready.pdf", "book_record_no-review_not-ready.zip") and got[6][0] == "book_session-9_previous-version.pdf"
    assert got[7][0] == "é" * 75 + "_session-1_not-ready.pdf" and got[8][0] == "book_session-1_not-ready.pdf"


def test_language_lines(spark):
    columns = "todo any_forms state candidates reviewer day not_reviewed held held_why accepted_by accepted_count none_tagged".split()
    base = dict(zip(columns, (0, False, "decided", 0, None, "May 1, 2026", None, None, None, None, None, False), strict=True))
    cases = [
        ({}, True, "Not Applicable"), ({"state": "off", "candidates": None}, False, "Not Done (not checked)"), ({"state": "failed", "candidates": 3}, False, "Not Done (the language step did not finish)"),
        ({"state": "odd", "candidates": 3}, False, "Not Done (the language step was not run)"), ({"todo": 1200, "any_forms": True}, False, "Not Reviewed (1,200 word forms to decide on the review page)"),
        ({"todo": 1, "any_forms": True}, False, "Not Reviewed (1 word form to decide on the review page)"), ({"todo": 5, "any_forms": True, "none_tagged": True}, False, "Not Reviewed (5 word forms the AI left untagged to confirm on the review page)"),
        ({"todo": 5, "any_forms": True, "reviewer": "Ann", "not_reviewed": 0}, True, "Approved (Ann on May 1, 2026)"), ({"todo": 5, "any_forms": True, "reviewer": "Ann", "not_reviewed": 2}, False, "Not Reviewed (2 word forms to decide on the review page)"),
        ({"held": 1, "held_why": "forms"}, False, "Not Reviewed (1 word form was not sent: more than the set number of word forms)"),
        ({"todo": 5, "any_forms": True, "held": 1500, "held_why": "book"}, False, "Not Reviewed (5 word forms to decide on the review page; 1,500 not sent: more than the room left in this PDF's limit)"),
        ({"todo": 5, "any_forms": True, "held": 2, "held_why": "step", "reviewer": "Ann", "not_reviewed": 0, "accepted_by": "Bo", "accepted_count": 2}, True, "Approved (Ann on May 1, 2026 · 2 word forms not sent, accepted by Bo)"),
        ({"todo": 5, "any_forms": True, "held": 3, "held_why": "step", "reviewer": "Ann", "not_reviewed": 0, "accepted_by": "Bo", "accepted_count": 2}, False, "Not Reviewed (3 word forms were not sent: more than the limit for language suggestions)"),
    ]
    own = {"tagging": [(i, *(base | change).values()) for i, (change, _, _) in enumerate(cases)]}
    assert sorted(ask(spark, "language_lines", own)) == [(i, ok, line) for i, (_, ok, line) in enumerate(cases)]


def test_states_of_steps_and_deferred_issues(spark):
    steps = [(1, "language", "cap", False, True, True, 4, 5, 6), (2, "pages", "book", True, True, True, 4, 5, 6), (3, "pages", "error", False, True, True, 0, 5, 6), (4, "language", "forms_changed", False, True, True, 4, 5, 6), (5, "pages", "pages_changed", False, True, True, 4, 5, 6), (6, "language", "done", False, True, True, 2, 5, 6), (7, "language", "done", False, True, True, 0, 5, 6), (8, "pages", None, False, False, True, 0, 5, 6), (9, "pages", None, False, False, False, 0, 5, 6), (10, "pages", "declined", False, True, True, 2, 5, 6)]
    got = {r[0]: r[2:] for r in ask(spark, "step_states", {"steps": steps})}
    assert got.keys() == {1, 2, 3, 4, 6, 8}
    assert got[1][:4] == ("left_out", "cap", 0, False) and got[2][:4] == ("left_out", "book", 6, False) and got[2][5] is False and got[2][4].endswith("this PDF's limit.")
    assert got[3] == ("unfinished", "error", 5, True, "The step stopped with an error.", True) and got[4][:3] == ("unfinished", "forms_changed", 5)
    assert got[6] == ("unfinished", "done", 2, True, "", True) and got[8][:3] == ("unfinished", "done", 5)
    deferred = [(1, "caption", 3, "both"), (1, "caption", 3, "both"), (1, "a  run", 5, "both"), (1, None, None, "both"), (1, " ", 7, "both"), (1, "a run", 9, "pdfua"), (2, "alt", None, "both")]
    assert sorted(ask(spark, "deferred_issues", {"deferred": deferred}), key=str) == [
        (1, "a run", 1, 1, 5, "a run"), (1, "caption", 2, 1, 3, "2 captions not grouped: several figures on the page"), (1, "not described", 2, 1, 7, "not described (2)"), (2, "alt", 1, 0, None, "alt"),
    ]


def test_blocks_are_the_standard_matchers():
    from difflib import SequenceMatcher

    from leafmend.functions import words

    r = random.Random(6)
    for k in range(400):
        alphabet = "ab" if k % 3 else "abcdefgh "
        a, b = ("".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(2))
        if k % 4 == 0:
            b = a[: len(a) // 2] + b + a[len(a) // 3 :]
        want = [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        assert words.blocks(a, b) == want and words.blocks(list(a), list(b)) == want
        opcodes = [(o == "equal", *x) for o, *x in SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]
        assert list(words._spans(a, b)) == opcodes


def test_quotes_escape_what_begins_a_line(spark):
    import hashlib

    text = "plain\n# head *x*\n  - item\n12. no\n> said\n\n \t\n3) a_b\n=\n[x](y) <z> `c` \\"
    want = "> plain\n> \\# head \\*x\\*\n>   \\- item\n> 12\\. no\n> \\> said\n>\n>\n> 3\\) a\\_b\n> \\=\n> \\[x\\](y) \\<z\\> \\`c\\` \\\\"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = dict(ask(spark, "markdown_escaped", documents=docs))
    assert got == {1: hashlib.sha256(want.encode()).hexdigest(), 2: None, 3: hashlib.sha256(b">").hexdigest()}


def test_rows_that_tell_a_tables_shape(spark):
    rows = [(1, 1, i, i, 1.0 if i in (2, 6, 7, 30, 59) or i >= 10 and i % 4 == 0 else 9.0, 1.0) for i in range(60)] + [(2, 1, i, i, 1.0, 1.0) for i in range(3)]
    lines = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double")
    got = sorted((r[0], r[2]) for r in ask(spark, "shape_rows", lineitem=lines))
    lone = [i for i in range(4, 58) if i in (6, 7, 30) or i >= 10 and i % 4 == 0][: 14 - 6]
    assert got == sorted([(1, i) for i in (0, 1, 2, 3, 58, 59, *lone)] + [(2, i) for i in range(3)])


def test_jumps_in_a_column(spark):
    # (line, top, x / 8, size - 4): back over twice the size counts, not across columns, not by less.
    runs = [(1, 500, 10, 6), (2, 470, 10, 6), (3, 480, 10, 6), (4, 300, 10, 6), (5, 10, 60, 6), (6, 690, 60, 6), (7, 650, 60, 6)]
    lines = spark.createDataFrame([(9, n, top, s, float(x), 1.0) for n, top, x, s in runs], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double")
    assert ask(spark, "jumps_up", lineitem=lines) == [(9, 3, 7)]
