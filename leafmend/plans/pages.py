"""What pages hold: shares of word shapes, bands and content out of reach, figures' answers, and what runs have cost."""

from __future__ import annotations

from .places import HYPHENS, LISTED, _plain, _shape
from .text import SPACES

#: The longer words a page needs, the letters of one, the share of the shape from which a page is read, the share of foreign words up to which.
WORDS, LONG, SHARE, FOREIGN = 20, 4, 0.5, 0.10
#: Letters that the Hawaiian alphabet lacks; heights of the bands at a page's edges.
NOT_HAWAIIAN, TOP, BOTTOM = "[bcdfgjqrstvxyz]", 70, 60
#: Headings of back matter, as books title them; those that may go on, those that stand alone; their kinds.
BEFORE = r"(?i)^[^\pL\pN_]*(?:appendix\s*[\pL\pN_.]*\s*[:.–—-]\s*)?(?:(?:the|an?)\s+)?(?:(?:select(?:ed)?|annotated|general|chinese|japanese|korean|character)\s+)*"
GOES_ON = BEFORE + (
    r"(?:bibliograph(?:y|ies)|glossar(?:y|ies)|index(?:es)?|character\s+(?:list|glossary)|characters|list\s+of\s+(?:chinese\s+|japanese\s+|korean\s+)?(?:characters|terms|names))"
    r"(?:\s+(?:of|and|for|to|in)\b.*|\s*[:(–—-].*)?[^\pL\pN_]*$"
)
ALONE = BEFORE + (
    r"(?:works\s+cited|references(?:\s+cited)?|literature\s+cited|sources(?:\s+cited|\s+consulted)?|(?:sources|references|works|bibliography)\s+in\s+(?:\w+\s+)?(?:languages?|\w+)|"
    r"(?:chinese|japanese|korean)\s+characters|further\s+reading)[^\pL\pN_]*$"
)
KINDS = [("bibliography", r"(?i)bibliograph|works\s+cited|references|literature|sources|further\s+reading|^[^\pL\pN_]*works\s+in\b"), ("index", r"(?i)\bindex")]


def hawaiian_pages(d) -> str:
    """A document's share of longer words of Hawaiian shape, null with few of them, its share of words with a letter Hawaiian lacks that aren't English, and whether it is read as Hawaiian.

    English is the words that LISTED documents in English have. Words are
    judged once for each form, not for each place.
    """
    core = d.replaced(d.replaced("w", r"^[^\pL\pN_]+|[^\pL\pN_]+$", ""), r"[’\x27]s$", "")
    edge = d.replaced("w", r"^[^\pL\pN_]+|[^\pL\pN_]+$", "")
    words = d.found(_plain(d, "lower(text)"), r"[a-z\x27’]+")
    flags = f"""length({d.replaced("core", r"[ʻ‘’\x27\x60]", "")}) >= {LONG} AS long, {_shape(d, "core")} AS shape, length(core) >= 2 AND {d.matches("core", r"\pL")} AS counts"""
    judged = f"""parts AS (SELECT w, max(CASE WHEN length(part) >= 2 AND {d.matches("part", NOT_HAWAIIAN)} AND l.word IS NULL THEN 1 ELSE 0 END) AS foreign_one
      FROM {d.rows_placed("forms", "w", d.split(_plain(d, "lower(bare)"), f"[{HYPHENS}]"), "k", "part")} p LEFT JOIN wordlist l ON l.word = part GROUP BY w),
    judged AS (SELECT f.w, {flags}, coalesce(p.foreign_one, 0) AS foreign_one FROM forms f LEFT JOIN parts p ON p.w = f.w)"""
    if d.name == "spark":  # a word once for each document, and a form's flags ride with its parts
        words = f"array_distinct({words})"
        judged = f"""flagged AS (SELECT w, bare, {flags} FROM forms),
    judged AS (SELECT w, bool_or(long) AS long, bool_or(shape) AS shape, bool_or(counts) AS counts, max(CASE WHEN length(part) >= 2 AND {d.matches("part", NOT_HAWAIIAN)} AND l.word IS NULL THEN 1 ELSE 0 END) AS foreign_one
      FROM {d.rows_placed("flagged", "w, long, shape, counts", d.split(_plain(d, "lower(bare)"), f"[{HYPHENS}]"), "k", "part")} p LEFT JOIN wordlist l ON l.word = part GROUP BY w)"""
    return f"""
    WITH wordlist AS (SELECT replace(word, '’', '''') AS word FROM (SELECT doc_id, word FROM (SELECT * FROM documents WHERE lang = 'en') {d.each(words, "word")}) GROUP BY 1 HAVING count(DISTINCT doc_id) >= {LISTED}),
    counted AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, w FROM documents {d.each(d.found("text", f"[^{SPACES}]+"), "w")}) GROUP BY doc_id, w),
    forms AS (SELECT w, {edge} AS core, {core} AS bare FROM (SELECT DISTINCT w FROM counted)),
    {judged},
    shares AS (SELECT doc_id, sum(CASE WHEN long THEN n ELSE 0 END) AS n_long, sum(CASE WHEN long AND shape THEN n ELSE 0 END) AS n_shape, sum(CASE WHEN counts THEN n ELSE 0 END) AS n_words, sum(CASE WHEN counts THEN n * foreign_one ELSE 0 END) AS n_foreign
      FROM counted c JOIN judged j ON j.w = c.w GROUP BY doc_id),
    found AS (SELECT t.doc_id, CASE WHEN n_long >= {WORDS} THEN CAST(n_shape AS DOUBLE) / n_long END AS share, CASE WHEN n_words > 0 THEN CAST(n_foreign AS DOUBLE) / n_words END AS foreign_share FROM documents t LEFT JOIN shares s ON s.doc_id = t.doc_id)
    SELECT doc_id, round(share, 6) AS share, round(foreign_share, 6) AS foreign_share, coalesce(share >= {SHARE} AND foreign_share < {FOREIGN}, false) AS hawaiian FROM found"""


def unreached_content(d) -> str:
    """A page's runs that no element owns or that aren't marked, by band and inside figures; pages without any are left out."""
    band = f"CASE WHEN y - vt < {TOP} THEN 'top' WHEN y - vt > (vb - vt) - {BOTTOM} THEN 'bottom' ELSE 'body' END"
    n = lambda when: f"CAST(sum(CASE WHEN {when} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""
    WITH runs AS (SELECT * FROM {d.given("runs", "r")}), owned AS (SELECT * FROM {d.given("owned", "o")}), boxes AS (SELECT * FROM {d.given("figure_boxes", "b")}), visible AS (SELECT * FROM {d.given("visible", "v")}),
    out AS (SELECT r.page, r.run, r.x, r.y, CASE WHEN r.mcid IS NULL THEN 'untagged' ELSE 'orphan' END AS kind, {band} AS band FROM runs r JOIN visible v ON v.page = r.page
      LEFT JOIN (SELECT DISTINCT page, mcid FROM owned) o ON o.page = r.page AND o.mcid = r.mcid WHERE o.mcid IS NULL AND NOT (r.mcid IS NULL AND r.artifact)),
    inside AS (SELECT DISTINCT o.page, o.run FROM out o JOIN boxes b ON b.page = o.page AND o.x BETWEEN b.x0 AND b.x1 AND o.y BETWEEN b.y0 AND b.y1)
    SELECT o.page, {n("kind = 'orphan'")} AS orphan_runs, {n("kind = 'untagged'")} AS untagged_runs, {n("band = 'top'")} AS top_runs, {n("band = 'body'")} AS body_runs, {n("band = 'bottom'")} AS bottom_runs, count(i.run) AS in_figure
    FROM out o LEFT JOIN inside i ON i.page = o.page AND i.run = o.run GROUP BY o.page"""


def figure_answers(d) -> str:
    """A figure request's answers cut to what it may decide, for the figures it was sent: kept, or the reason why not."""
    return f"""
    SELECT a.request, a.pos, a.part, CASE WHEN a.part NOT IN ('alt', 'page_figures', 'deferrals', 'artifacts.elements') THEN 'not a decision about figures' WHEN a.part = 'deferrals' OR s.target IS NOT NULL THEN NULL
      ELSE concat('not one of the figures sent in figure request ', CAST(a.request AS STRING)) END AS why
    FROM {d.given("figure_replies", "a")} LEFT JOIN (SELECT DISTINCT request, whole_page, target FROM {d.given("figures_sent")}) s ON s.request = a.request AND s.target = a.target AND s.whole_page = (a.part = 'page_figures')"""


def merged_figures(d) -> str:
    """The first request's decisions on figures that figure requests were sent, dropped with the reason, and the finished requests' answers added."""
    return f"""
    WITH sent AS (SELECT whole_page, target, max(request) AS request FROM {d.given("figures_sent")} GROUP BY whole_page, target), ends AS (SELECT * FROM {d.given("request_ends", "e")}),
    kept AS ({figure_answers(d)}),
    first AS (SELECT f.pos, f.part, s.request, e.outcome FROM {d.given("first_decisions", "f")} LEFT JOIN sent s ON s.target = f.target AND s.whole_page = (f.part = 'page_figures') AND f.part IN ('alt', 'retype', 'actual_text', 'page_figures', 'artifacts.elements')
      LEFT JOIN ends e ON e.request = s.request)
    SELECT 'first' AS origin, pos, part, CASE WHEN request IS NULL THEN NULL WHEN outcome = 'done' THEN concat('decided in figure request ', CAST(request AS STRING), ', which saw the image')
      WHEN outcome = 'stale' THEN concat('the saved answers of figure request ', CAST(request AS STRING), ' were written for a different figure list') ELSE concat('its image was in figure request ', CAST(request AS STRING), ', which did not finish') END AS why FROM first
    UNION ALL SELECT 'figure', k.pos, k.part, NULL FROM kept k JOIN ends e ON e.request = k.request WHERE k.why IS NULL AND e.outcome = 'done'"""


def restricted_rules(d) -> str:
    """The rules that a request's figures break, with those figures only."""
    one = "CAST(obj AS STRING)"
    return f"""
    SELECT s.request, r.rule, count(*) AS figures, {d.listed(one)} AS objs FROM {d.given("broken_rules", "r")} JOIN (SELECT DISTINCT request, target FROM {d.given("figures_sent")} WHERE NOT whole_page) s ON s.target = r.obj GROUP BY s.request, r.rule"""


def run_costs(d) -> str:
    """What a run's calls have cost, earlier attempts apart, calls, the cost of a page, whether a saved reply was used, what counts toward its limit with charges not known at their worst, and the line that says so.

    A reply from elsewhere costs nothing here unless the run paid for it
    itself; page readings and the language step are the run's own money.
    """
    money = lambda x: f"concat('$', {d.fixed(f'round(CAST({x} AS DECIMAL(18, 6)), 2)', 2)})"
    return f"""
    WITH c AS (SELECT run, sum(CASE WHEN kind = 'attempt' THEN coalesce(cost, 0) ELSE 0 END) AS earlier, sum(CASE WHEN kind = 'attempt' THEN coalesce(cost, 0) + coalesce(worst, 0) ELSE 0 END) AS attempts,
        sum(CASE WHEN kind IN ('pages', 'language') THEN coalesce(cost, 0) ELSE 0 END) AS own, sum(CASE WHEN kind = 'order' THEN coalesce(cost, 0) ELSE 0 END) AS decided, sum(CASE WHEN kind IN ('pages', 'language') THEN coalesce(worst, 0) ELSE 0 END) AS open,
        sum(CASE WHEN kind = 'order' THEN 1 ELSE 0 END) AS passes, sum(CASE WHEN kind <> 'order' THEN 1 ELSE 0 END) AS others FROM {d.given("calls")} GROUP BY run),
    a AS (SELECT r.run, r.batch, r.pages, r.saved AND NOT r.own_reply AND coalesce(c.own, 0) = 0 AS reused, coalesce(c.own, 0) + CASE WHEN r.saved AND NOT r.own_reply THEN 0 ELSE coalesce(c.decided, 0) END AS now, coalesce(c.earlier, 0) AS earlier,
        CASE WHEN r.saved AND NOT r.own_reply THEN 0 ELSE CASE WHEN coalesce(c.passes, 0) = 0 THEN 1 ELSE c.passes END END + coalesce(c.others, 0) AS calls,
        coalesce(c.attempts, 0) + CASE WHEN r.saved AND NOT r.own_reply THEN 0 ELSE coalesce(c.decided, 0) END + coalesce(c.own, 0) + coalesce(c.open, 0) AS spent, coalesce(c.open, 0) AS not_known
      FROM {d.given("runs_made", "r")} LEFT JOIN c ON c.run = r.run)
    SELECT run, batch, round(now + earlier, 6) AS usd, round(earlier, 6) AS earlier_usd, CAST(calls AS BIGINT) AS calls, CASE WHEN pages > 0 AND now + earlier > 0 THEN round(CAST(now + earlier AS DOUBLE) / pages, 6) END AS per_page_usd, reused, round(spent, 6) AS spent, round(not_known, 6) AS not_known,
      CASE WHEN reused AND earlier = 0 THEN 'none (a saved reply was used)' ELSE concat({money("now + earlier")}, CASE WHEN round(earlier, 2) > 0 THEN concat(' (', CASE WHEN round(now, 2) > 0 THEN concat({money("now")}, ' + ') ELSE '' END, {money("earlier")}, ' for previous attempts)') ELSE '' END) END AS words
    FROM a"""


def batch_costs(d) -> str:
    """What a batch has spent: its runs, whatever their state, and those in the trash, which keep their cost."""
    return f"""
    SELECT coalesce(b.batch, t.batch) AS batch, coalesce(runs, 0) AS runs, round(coalesce(usd, 0) + coalesce(gone, 0), 4) AS usd, round(coalesce(earlier_usd, 0), 4) AS earlier_usd, round(coalesce(gone, 0), 4) AS trashed_usd FROM (
      SELECT batch, count(*) AS runs, sum(usd) AS usd, sum(earlier_usd) AS earlier_usd FROM ({run_costs(d)}) WHERE batch IS NOT NULL GROUP BY batch) b
    FULL OUTER JOIN (SELECT batch, sum(cost) AS gone FROM {d.given("trashed")} GROUP BY batch) t ON t.batch = b.batch"""


def back_matter_headings(d) -> str:
    """Pages' titles, and documents' short first lines, that name a glossary, bibliography or index, and which."""
    back = f"({d.matches('t', GOES_ON)} OR {d.matches('t', ALONE)})"
    kind = " ".join(f"WHEN {d.matches('t', p)} THEN '{k}'" for k, p in KINDS)
    return f"""
    SELECT origin, id, {back} AS back_matter, CASE WHEN {back} THEN CASE {kind} ELSE 'glossary' END END AS kind FROM (
      SELECT origin, id, trim({d.replaced("coalesce(t, '')", f"[{SPACES}]+", " ")}) AS t FROM {d.given("headings")})"""
