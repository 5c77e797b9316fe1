"""Rule plans by values worked out by hand, apart from any SQL."""

from collections import namedtuple

import duckdb
import pytest

from fixtures import FIXTURES
from leafmend import catalog
from leafmend.operators import text_queries
from leafmend.plans import language, rules
from leafmend.plans.dialect import Duck, Spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ask(spark):
    """A plan's rows where it asks about FIXTURES in place of the tables."""

    def rows(name):
        sql = catalog.plans()[name](Spark(FIXTURES))
        catalog.views(spark, SF, sql)
        return [tuple(r) for r in spark.sql(sql).collect()]

    return rows


def test_dates_in_words(ask):
    dates = dict(FIXTURES["iso_dates"])
    got = {dates[r[0]]: r[1:] for r in ask("iso_date_words")}
    none = "date not recorded"
    assert got["2026-11-15"] == ("November 15, 2026", "time not recorded", "November 15, 2026")
    assert got["2026-11-15T18:19:00"] == ("November 15, 2026", "6:19 PM", "November 15, 2026, at 6:19 PM")
    assert got["2026-02-30 00:05"] == ("February 30, 2026", "12:05 AM", "February 30, 2026, at 12:05 AM")
    assert got["2026-13-01"] == ("2026-13-01",) * 3 and got["soon"] == ("soon",) * 3
    assert got[""] == got[None] == (none, "time not recorded", none)
    assert got["2026-10-31T09:07:30.5Z"][1] == "9:07 AM" and got["2026-10-31T24:00"][0] == "2026-10-31T24:00"
    assert got["2026-06-07T12:00+09:00"][2] == "June 7, 2026, at 12:00 PM"


def test_tags(ask):
    got = {r[1]: r[2:] for r in ask("short_tags")}
    assert got["jpn-Latn"] == ("ja-Latn", "jpn-Latn") and got["ms-Latn"] == ("ms-Latn", "ms") and got["eng"][0] == "en"
    assert got["haw"] == ("haw", "haw") and got["ryu-Latn"][1] == "ryu-Latn" and got["zho-Hant"][0] == "zh-Hant" and got["de-Latn-AT"][1] == "de-Latn-AT"


def test_names(ask):
    got = {rules.TITLES[-1 - r[0]]: r[1:] for r in ask("book_names") if r[0] < 0}
    assert got[("_no template_Da Kine Talk copy 2", "da_kine.pdf")] == (True, "_no template_Da Kine Talk copy 2", "Da Kine Talk")
    assert got[("Untitled", "my-file_2.PDF")] == (False, "my file 2", "my file 2")
    assert got[("report.docx", "a__b.pdf")] == (False, "a b", "a b")
    assert got[("  A   Good Title ", "x.pdf")] == (True, "A Good Title", "A Good Title")
    assert got[(None, ".pdf")] == (False, ".pdf", ".pdf") and got[("12 3", "plain")][0] is False and got[("Documents of Old", "d.pdf")][0] is False  # it begins like a placeholder
    assert {"B3+SimSun": "SimSun", "Arial": "Arial", "AB+CD+Times": "Times", "": "", "+Minion": "Minion"}.items() <= dict(ask("font_names")).items()


def test_resolution_and_cover(ask):
    # 300 x 150 pixels on 144 x 72 points: 150; its other image, turned: 200. 149 x 299 on 72 x 144: 149. 50 x 50 on 100 x 100: 36.
    assert sorted(ask("low_resolution")) == [(4, 2, 149), (7, 1, 36)]
    assert [c for _, c in sorted(ask("page_scans"))] == [True, False, True, True, False, False]


def test_cjk_pages(spark):
    text = lambda n, nd, first: "".join(chr(first + i % nd) for i in range(n))
    counts = [(9, 9), (10, 10), (30, 12), (16, 10), (17, 10), (40, 20), (100, 19), (10, 9)]
    rows = [text(n, nd, 0x4E00) + " latin " for n, nd in counts] + [text(n, nd, 0xE0) for n, nd in counts] + ["plain", "", None]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").createOrReplaceTempView("documents")
    got = {r.doc_id: r for r in spark.sql(rules.cjk_pages(Spark())).collect()}
    want = [False, True, False, True, False, True, False, False]
    assert [got[i].cjk for i in range(8)] == want == [got[i].beyond_ascii for i in range(8, 16)] and [(got[i].n, got[i].nd) for i in range(8)] == counts
    assert not any(got[i].cjk for i in range(8, 19)) and got[16].n == got[17].n == got[18].n == 0



def test_checklists(ask):
    assert {r[:2]: r[2:] for r in ask("checklists")} == {(1, "a"): (True, 0), (2, "a"): (False, 1), (3, "a"): (False, 1), (4, "b"): (True, 1), (5, "a"): (False, 0)}


def test_sentence_ends():
    con = duckdb.connect()
    words = 'End. "Yes!" cf. N. 52. Really?) plain 。 ok。 etc., (no.) Stop.”'
    con.execute("CREATE TABLE documents AS SELECT 's' AS source, ? AS text", [words])
    # End. "Yes!" Really?) 。 ok。 Stop.” end one; cf. N. 52. (no.) and etc., don't.
    assert con.sql(rules.sentence_ends(Duck())).fetchall() == [("s", 12, 6)]


def test_learned_line_by_refitting(ask):
    """Each book left out by fitting anew, as the plan does by subtracting totals."""
    import math
    from collections import Counter

    rows = duckdb.sql(f"SELECT o_orderpriority, o_custkey % 40, floor(o_totalprice), 200 + o_orderkey % 5000 FROM '{SF}/orders.parquet' ORDER BY o_orderdate, o_orderkey").fetchall()

    def line(calls):
        n = Counter(b for b, _, _ in calls)
        s, sx, sy, sxx, sxy = 1e-6, 0.0, 0.0, 1e-6, 0.0
        for b, i, o in calls:
            w, x, y = 1 / n[b], math.log(i / 1000), math.log(o)
            s, sx, sy, sxx, sxy = s + w, sx + w * x, sy + w * y, sxx + w * x * x, sxy + w * x * y
        return (sy * sxx - sx * sxy) / (s * sxx - sx * sx), (s * sxy - sx * sy) / (s * sxx - sx * sx)

    for kind, calls, books, a, b, lo, md, hi, *_ in ask("learned_costs"):
        mine = [r[1:] for r in rows if r[0] == kind][-80:]
        assert (calls, books) == (80, len({x for x, _, _ in mine})) and line(mine) == pytest.approx((a, b), abs=1e-5)
        ratios = []
        for book in {x for x, _, _ in mine}:
            p, q = line([c for c in mine if c[0] != book])
            ratios += [(o / math.exp(p + q * math.log(i / 1000)), x) for x, i, o in mine if x == book]
        n, at = Counter(x for _, x in ratios), 0.0
        wanted = {}
        for v, x in sorted(ratios):
            at += 1 / n[x] / len(n)
            for k in (0.05, 0.5, 0.95):
                if at >= k - 1e-9:
                    wanted.setdefault(k, v)
        assert (lo, md, hi) == pytest.approx((wanted[0.05], wanted[0.5], wanted[0.95]), rel=1e-5)


def test_work_order_reasons(ask):
    whys = lambda name: {r[:-1] if len(r) > 2 else r[0]: r[-1] for r in ask(name)}
    unsent = "its image was not sent (over --max-images), so the alt was written unseen"
    assert whys("role_checks") == {
        ("rolemap", 1): None, ("rolemap", 2): "unknown style", ("rolemap", 3): "target not allowed", ("rolemap", 4): "target not allowed", ("rolemap", 5): "target not allowed",
        ("retype", 1): None, ("retype", 2): "unknown obj", ("retype", 3): "type not allowed", ("retype", 4): None,
        ("alt", 1): None, ("alt", 2): unsent, ("alt", 3): "not a figure or empty alt", ("alt", 4): "not a figure or empty alt", ("alt", 5): "unknown obj", ("alt", 6): "not a figure or empty alt",
    }
    got = whys("page_figure_checks")
    assert got[1] is None and got[2] == got[6] == "empty alt" and got[3].startswith("its page image") and got[4] == got[5] == "not a page listed in page_figures"
    rows, twice = "group_rows and repeat_rows must list row numbers in the table", "the same table twice"
    assert whys("table_checks") == {
        1: None, 2: "not a table listed in the digest", 3: "also flattened", 4: "header_rows and header_cols must be whole numbers 0-3", 5: "title_rows and note_rows must be whole numbers 0-3",
        6: rows, 7: "no header rows or columns", 8: twice, 9: None, 10: rows, 11: twice,
    }
    assert {k for k, v in whys("style_checks").items() if v is None} == {("merges", 1), ("merges", 5), ("lists", 1), ("keep_lists", 1), ("notes", 1)}
    assert {k[0] for k, v in whys("section_checks").items() if v is None} == {1, 4, 6, 7}
    assert {k for k, v in whys("untagged_checks").items() if v is None} == {("artifacts.text_rules", 1), ("artifacts.text_rules", 3), ("artifacts.elements", 1)}


def test_section_moves_one_by_one(spark):
    """Each book's moves against a plain loop; the second book's first move counts for it alone."""
    want = {}
    for book in (1, 2):
        kept, starts = [], [p for b, p in FIXTURES["misread"] if b == book]
        for b, pos, low, high, goal in FIXTURES["moves"]:
            if b != book:
                continue
            if not all(1 <= p <= 12 for p in (low, high, goal)):
                why = "bad pages"
            elif not any(low <= f <= high or f == goal for f in starts):
                why = "the audit finds no section read out of place in these pages or where it lands"
            elif len(kept) == 3:
                why = "more than 3 section moves"
            elif any(low <= h and l <= high for l, h, _ in kept):
                why = "its pages overlap another section move"
            elif any(l <= goal <= h or low <= g <= high for l, h, g in kept):
                why = "it lands inside the pages of another section move"
            else:
                why = None
                kept.append((low, high, goal))
            want[book, pos] = why
    got = {(r.book, r.pos): r.why for r in text_queries.section_moves(spark, SF, Spark(FIXTURES)).collect()}
    assert got == want and len(set(want.values())) == 6


def test_written_tags(ask):
    got = {language.WRITTEN[r.id]: r for r in rows(ask, "written_tags") if r.id < 1000}
    allowed = {w for w, r in got.items() if r.allowed}
    assert allowed == {"ja-Latn", "qaa", "qaa-x-a", "en-1994", "de-DE-1996", "haw", "haw-US", "es-419", "zh-Hant"}
    assert {w: got[w].tag for w in ("en_US", " EN ", "zh_hant_tw", "x-ab", "x-ab-cd", "en-x-ab", "english", "en--US", "en US", "en-u-co", "", None)} == {
        "en_US": "en-US", " EN ": "en", "zh_hant_tw": "zh-Hant-TW", "x-ab": "x-ab", "x-ab-cd": None, "en-x-ab": "en-x-ab", "english": None, "en--US": None, "en US": None, "en-u-co": None, "": None, None: None,
    }
    assert (got["jpn-latn"].shortest, got["eng"].shortest, got["english"].shortest) == ("ja-Latn", "en", None)
    assert got["zh_hant_tw"].name == "Chinese (Traditional)" and got["xx"].name is None and got["eng"].name is None
    assert {w: r.from_name for w, r in got.items() if r.from_name} == {"english": "en", "Hawaiian": "haw", "ʻŌlelo  Hawaiʻi": "haw", "MĀORI": "mi", "Hawai''i": "haw"}


def rows(ask, name):
    """Rows by column name: (id, tag, shortest, name, allowed, from_name)."""
    kind = namedtuple("Row", "id tag shortest name allowed from_name")
    return [kind(*r) for r in ask(name)]


def test_reply_decisions(ask):
    got = {r[:2]: r[3:] for r in ask("reply_decisions")}
    codes = {1: None, 2: "echo", 3: "invalid", 4: None, 5: "twice", 6: "unknown_id", 7: "tag", 8: "invalid", 9: None, 10: "tag", 11: "unknown_id"}
    assert {p: c for (r, p), (_, c) in got.items() if r == 1} == codes
    assert got[(1, 4)] == ("ms", None)  # without the script that Malay leaves out
    assert got[(2, 1)] == (None, None) and got[(5, 1)] == ("fr", None) and got[(5, 2)] == (None, None)


def test_form_answers(ask):
    assert {r[:2]: r[2:] for r in ask("form_answers")} == {
        (1, "a"): ("ja-Latn", None, True, False, True), (1, "b"): (None, "echo", False, True, True), (1, "c"): ("ms", None, True, False, True), (1, "e"): (None, "tag", False, True, True),
        (1, "f"): ("it", None, False, False, False), (1, "g"): (None, "tag", False, True, True), (2, "a"): (None, None, False, False, False), (2, "b"): (None, "invalid", False, True, True),
        (3, "a"): (None, "unreadable", False, True, True), (4, "a"): (None, "cut_off", False, True, True), (5, "a"): ("fr", None, False, False, True), (5, "b"): (None, None, False, False, True),
    }


def test_release_lines(ask):
    got = {r[0]: r[1:] for r in ask("release_lines")}
    assert got[1] == ("Ready · 2 issues noted", "Completed (2 issues noted)", None)
    assert got[2][1] == "Not Completed (PAC 2026: recorded on a previous version, Session 3; Screen-Reader Test not recorded)"
    assert got[3][:2] == ("Pending Evaluation · 1 issue noted", "Not Completed (PAC 2026: could not be read in full: record it again; Screen-Reader Test: recorded on a previous version; 1 issue noted)")
    assert got[4] == ("Pending Evaluation", "Not Completed", None) and got[5] == ("Not Ready", "Completed", None)  # the latest result of a file counts
    assert got[6][::2] == ("Shipped · 1 issue noted", "Newer version (Session 2): Pending Evaluation")
    assert got[7][2] == "Newer version: Session 4 being reviewed" and got[8][2] == "Newer version: Session 5 finished, not applied"
    assert got[9] == ("Shipped", "Not Completed", "Newer version: Pending Evaluation")


def test_unfinished_requests_and_whole_costs(ask):
    # 2 and 8 finished by their second reply; 3's was cut off again, 4 failed, 5 can't be read, 6 ended without a word, 7 was never sent.
    assert sorted(r[0] for r in ask("unfinished_requests")) == [3, 4, 5, 6, 7]
    assert {r[0]: r[1:] for r in ask("whole_costs")} == {
        1: (2.0, 1.5, 2.5, 80, False, None), 2: (2.5, 1.75, 3.5, 40, True, None), 3: (2.5, 2.5, 2.5, 30, True, None), 4: (None, None, None, None, False, "too_few"), 5: (None, None, None, None, False, None),
        6: (None, None, None, None, False, "no_page_figure"),
    }
