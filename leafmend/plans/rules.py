"""Rules for a person's eye: names, dates, amounts, checks, learned costs.

Where the tables have no such column, a few literal rows stand in, listed with the plan.
"""

from __future__ import annotations

from .given import values as _values
from .text import CJK_WIDE, SPACES

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: The shape of a date, names that aren't titles, a maker's tag before a title, a copy's number after it.
ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.]\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2})?$"
NOT_TITLE = r"(?i)^(untitled|title|document|microsoft word\b|adobe\b|pdf\b)|[.](indd|docx?|pdf|qxd|qxp|tiff?|txt|rtf|p65|pm\d|ps|eps|fm|book)\s*$"
TAG, COPY = r"^_[^_]{1,40}_\s*", r"(?i)\s+copy(\s+\d+)?\s*$"
#: How a sentence ends, and abbreviations that don't end one.
END = '[.!?。！？]["”’»)\\]」』]*$'
ABBREVIATIONS = """e.g. i.e. cf. fl. ca. c. vol. vols. no. nos. p. pp. ed. eds. trans. mr. mrs. dr. st. ch. chap. fig. jr. sr. vs. etc. r. d. b. ibid. op. cit. jap. chin. kor.""".split()
#: Languages whose tags leave a Latin script out.
SUPPRESSED = "ch cs da de en es fi fj fr hu id it la mh ms nl no pl pt sm sv tl to tpi tr vi".split()
#: Three-letter codes of languages that have a two-letter one.
SHORT = """eng en fra fr fre fr deu de ger de spa es por pt ita it nld nl dut nl lat la tgl tl vie vi ind id msa ms may ms mri mi mao mi
smo sm ton to jpn ja kor ko zho zh chi zh ara ar heb he rus ru ell el gre el tha th san sa pli pi mah mh cha ch tah ty fij fj
bod bo tib bo mon mn hin hi urd ur fas fa per fa tur tr khm km mya my bur my lao lo uig ug swe sv dan da nor no pol pl ces cs
cze cs hun hu fin fi jav jv""".split()
#: How many calls a kind learns from, the fewest calls and books, and the quantiles of what it foretells.
WINDOW, CALLS, BOOKS, LOW, HIGH = 80, 12, 6, 0.05, 0.95


def iso_date_words(d) -> str:
    """Dates and times as written, in words: no zone is applied, days to 31 pass in any month, what doesn't parse stays, what is missing says so."""
    part = lambda i: f"CAST(nullif({d.first('v', ISO, i)}, '') AS INT)"
    two = "lpad(CAST(mi AS STRING), 2, '0')"
    return f"""
    SELECT id, day, clock, CASE WHEN sound AND h IS NOT NULL THEN concat(day, ', at ', clock) ELSE day END AS moment FROM (
      SELECT id, sound, h, CASE WHEN coalesce(v, '') = '' THEN 'date not recorded' WHEN sound THEN concat({d.pick(MONTHS, "mo")}, ' ', CAST(d AS STRING), ', ', CAST(y AS STRING)) ELSE v END AS day,
        CASE WHEN coalesce(v, '') = '' OR sound AND h IS NULL THEN 'time not recorded' WHEN NOT sound THEN v
          ELSE concat(CAST(CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END AS STRING), ':', {two}, CASE WHEN h < 12 THEN ' AM' ELSE ' PM' END) END AS clock
      FROM (SELECT *, coalesce(mo BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND (h IS NULL OR h <= 23 AND mi <= 59), false) AS sound FROM (
        SELECT id, v, {part(1)} AS y, {part(2)} AS mo, {part(3)} AS d, {part(4)} AS h, {part(5)} AS mi FROM (SELECT id, trim(v) AS v FROM {d.given("iso_dates")}))))"""


def short_tags(d) -> str:
    """Language tags with the two-letter code where there is one, and without a script that the language leaves out."""
    pairs = list(zip(SHORT[::2], SHORT[1::2], strict=True))
    first, rest = d.first("tag", "^([^-]+)", 1), d.replaced("tag", "^[^-]+", "")
    return f"""
    SELECT id, tag, concat(coalesce(two, {first}), {rest}) AS shortest,
      CASE WHEN {d.first("tag", "^([^-]+)-Latn$", 1)} IN ({", ".join(f"'{x}'" for x in SUPPRESSED)}) THEN {first} ELSE tag END AS unscripted
    FROM {d.given("tags")} LEFT JOIN {_values(pairs, "m", "three, two")} ON three = {first}"""


def sentence_ends(d) -> str:
    """Words of a source that end a sentence: a stop, closing signs after it; no abbreviation, initial or number."""
    core = d.replaced("lower(w)", r'^["“”‘’()\[\]]+|["“”‘’()\[\]]+$', "")
    known = ", ".join(f"'{x}'" for x in ABBREVIATIONS)
    ends = f"{d.matches('w', END)} AND NOT ({core} IN ({known}) OR {d.matches(core, r'^\pL[.]$')} OR {d.matches(core, r'^[0-9.,:–-]+$')})"
    return f"""
    SELECT source, CAST(sum(n) AS BIGINT) AS words, CAST(sum(CASE WHEN {ends} THEN n ELSE 0 END) AS BIGINT) AS ends
    FROM (SELECT source, w, count(*) AS n FROM (SELECT source, w FROM documents {d.each(d.found("text", f"[^{SPACES}]+"), "w")}) GROUP BY source, w) GROUP BY source"""


def _title_ok(d, t: str) -> str:
    letters = d.replaced(t, r"[^\pL]", "")
    return f"length({t}) BETWEEN 3 AND 300 AND length({letters}) >= 3 AND NOT {d.matches(t, NOT_TITLE)} AND NOT {d.matches(t, r'^[\pL\pN_.-]+[.][\pL\pN_]{2,4}$')}"


TITLES = [("_no template_Da Kine Talk copy 2", "da_kine.pdf"), ("Untitled", "my-file_2.PDF"), ("report.docx", "a__b.pdf"), ("  A   Good Title ", "x.pdf"), (None, ".pdf"), ("12 3", "plain"), ("Documents of Old", "d.pdf")]


def book_names(d) -> str:
    """Names of books: the title where it is one, else the file's name; the automatic name without a maker's tag and a copy's number."""
    flat = lambda t: f"trim({d.replaced(t, f'[{SPACES}]+', ' ')})"
    stem = flat(d.replaced(d.replaced("file", r"(?i)[.]pdf$", ""), "[_-]+", " "))
    return f"""
    SELECT id, {_title_ok(d, "t")} AS usable, CASE WHEN {_title_ok(d, "t")} THEN t ELSE stem END AS display, CASE WHEN {_title_ok(d, "bare")} THEN bare ELSE stem END AS automatic
    FROM (SELECT id, t, trim({d.replaced(d.replaced("t", TAG, ""), COPY, "")}) AS bare, coalesce(nullif({stem}, ''), file) AS stem FROM (
      SELECT id, file, {flat("coalesce(title, '')")} AS t FROM (
        SELECT id, title, file FROM {_values([(-1 - i, *x) for i, x in enumerate(TITLES)], "v", "id, title, file")}
        UNION ALL SELECT page_id, {d.first("html", "<title>([^<]*)</title>")}, {d.first("url", "([^/?#]*)/*(?:[?#].*)?$")} FROM pages)))"""


def font_names(d) -> str:
    """Fonts without the prefix of a subset: what stands after the last plus sign."""
    fonts = ["B3+SimSun", "Arial", "AB+CD+Times", "", "+Minion"]
    return f"SELECT f, {d.replaced('f', '^.*[+]', '')} AS short FROM {_values([(x,) for x in fonts], 't', 'f')} UNION ALL SELECT concat(p_brand, '+', p_type), {d.replaced("concat(p_brand, '+', p_type)", '^.*[+]', '')} FROM part"


def money_words(d) -> str:
    """Amounts in words, four decimals under a cent, and 'up to' amounts, never rounded down."""
    return f"""
    SELECT l_orderkey, l_linenumber, concat('$', CASE WHEN x >= 0.01 OR x = 0 THEN {d.fixed("x", 3)} ELSE {d.fixed("x", 4)} END) AS words, ceil(round(x * 100, 6)) / 100 AS up_to
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN l_discount / 64 ELSE l_extendedprice / 70001 END AS x FROM lineitem)"""


def request_estimates(d) -> str:
    """Input tokens of a request: 2.2 characters each, an image by its area over 750; the worst case a quarter more."""
    return """
    SELECT doc_id, floor(text_tokens + image_tokens) AS estimate, ceil(CAST(1.25 AS DOUBLE) * (text_tokens + image_tokens)) AS worst FROM (
      SELECT doc_id, n_chars / CAST(2.2 AS DOUBLE) AS text_tokens, (n_chars % 1000) * 700 / CAST(750 AS DOUBLE) AS image_tokens FROM documents)"""


def low_resolution(d) -> str:
    """Figures under 150 pixels an inch: the least of their images, short side to short side; images of under an inch, whole pages and figures without a page aside."""
    return f"""
    SELECT obj, page, ppi FROM (
      SELECT obj, min(page) AS page, CAST(round(min(least(least(w, h) / (least(pw, ph) / 72), greatest(w, h) / (greatest(pw, ph) / 72)))) AS BIGINT) AS ppi
      FROM (SELECT obj, page, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, CAST(x1 - x0 AS DOUBLE) AS pw, CAST(y1 - y0 AS DOUBLE) AS ph
        FROM {d.given("images")} WHERE NOT whole AND page IS NOT NULL)
      WHERE least(w, h) > 0 AND least(pw, ph) > 0 AND greatest(pw, ph) >= 72 GROUP BY obj) WHERE ppi < 150"""


def page_scans(d) -> str:
    """Whether a box covers 80.0 % of the visible area or more, cut to it and rounded to a tenth."""
    part = "greatest(least(x1, vx1) - greatest(x0, vx0), 0) * greatest(least(y1, vy1) - greatest(y0, vy0), 0)"
    return f"""
    SELECT id, round(CAST(100 * {part} AS DOUBLE) / greatest(greatest(vx1 - vx0, 0) * greatest(vy1 - vy0, 0), 1), 1) >= 80 AS covers
    FROM {d.given("boxes")}"""


def _cjk(n: str, nd: str) -> str:
    return f"{n} >= 10 AND ({nd} >= 20 OR {nd} >= 10 AND CAST({nd} AS DOUBLE) / {n} >= 0.6)"


def cjk_pages(d) -> str:
    """A page holds CJK text from 10 characters, 20 of them different, or 10 different ones that are 60 % of all; characters beyond ASCII stand in for CJK ones too."""
    only = lambda p: d.replaced("coalesce(text, '')", p, "")
    count = lambda x: f"CASE WHEN {x} = '' THEN 0 ELSE {d.size(d.characters(x))} END"
    return f"""
    SELECT doc_id, n, nd, {_cjk("n", "nd")} AS beyond_ascii, {_cjk("c", "cd")} AS cjk FROM (
      SELECT doc_id, length(b) AS n, {count("b")} AS nd, length(c) AS c, {count("c")} AS cd FROM (SELECT doc_id, {only(r"[\x00-\x7F]+")} AS b, {only(f"[^{CJK_WIDE}]+")} AS c FROM documents))"""


def page_lists(d) -> str:
    """The lines of an order as pages for a person: up to four by name, with printed labels, more by their number and span."""
    one = lambda n: f"concat('PDF ', CAST({n} AS STRING), CASE {n} WHEN 2 THEN ' (printed ii)' WHEN 5 THEN ' (printed 3)' ELSE '' END)"
    return f"""
    SELECT l_orderkey, CASE WHEN n <= 4 THEN listed ELSE concat(CAST(n AS STRING), ' pages, ', {one("low")}, ' to ', {one("high")}) END AS pages FROM (
      SELECT l_orderkey, count(*) AS n, min(p) AS low, max(p) AS high, {d.listed(one("p"))} AS listed FROM (SELECT DISTINCT l_orderkey, l_linenumber AS p FROM lineitem) GROUP BY l_orderkey)"""


def safety_lines(d) -> str:
    """Five checks (an order's lines): failed with the names of those that did, not checked unless all five are there, else passed."""
    return f"""
    SELECT l_orderkey, bad IS NULL AND n = 5 AND lines = 5 AS ok,
      CASE WHEN bad IS NOT NULL THEN concat('Failed (', bad, ')') WHEN n = 5 AND lines = 5 THEN 'Passed' ELSE concat('Not Checked (only ', CAST(lines AS STRING), ' of the 5 checks were recorded for this run)') END AS line
    FROM (SELECT l_orderkey, count(*) AS lines, count(DISTINCT CASE WHEN l_linenumber <= 5 THEN l_linenumber END) AS n, nullif({d.listed("CASE WHEN l_returnflag = 'R' THEN concat('check ', CAST(l_linenumber AS STRING)) END")}, '') AS bad FROM lineitem GROUP BY l_orderkey)"""


def checklists(d) -> str:
    """Results of evaluations: complete where each item of the checklist has one of its choices and no item is unknown; the items marked fail."""
    answers, items = d.given("answers"), d.given("checklist")
    if d.name == "spark":  # answers meet their items and are counted against the section's, so no section is laid out for each evaluation
        return f"""
    WITH a AS (SELECT id, section, item, result FROM {answers}), c AS (SELECT section, item, choices FROM {items}),
    asked AS (SELECT section AS asked_section, count(DISTINCT item) + count(DISTINCT CASE WHEN item IS NULL THEN 1 END) AS n FROM c GROUP BY section),
    judged AS (SELECT a.id, a.section, c.item, a.result, coalesce(concat(',', c.choices, ',') LIKE concat('%,', a.result, ',%'), false) AS good FROM a LEFT JOIN c ON c.section = a.section AND c.item = a.item),
    told AS (SELECT id, section, size(collect_set(item)) AS n, count_if(item IS NULL OR NOT good) AS bad, count_if(item IS NOT NULL AND result = 'fail') AS issues FROM judged WHERE id IS NOT NULL GROUP BY id, section)
    SELECT t.id, t.section, t.n = q.n AND t.bad = 0 AS complete, t.issues FROM told t JOIN asked q ON q.asked_section = t.section"""
    return f"""
    WITH a AS (SELECT id, section, item, result FROM {answers}), c AS (SELECT section, item, choices FROM {items}),
    asked AS (SELECT k.id, c.section, c.item, c.choices FROM (SELECT DISTINCT id, section FROM a) k JOIN c ON c.section = k.section),
    unknown AS (SELECT a.id, a.section, sum(CASE WHEN c.item IS NULL THEN 1 ELSE 0 END) AS n FROM a LEFT JOIN c ON c.section = a.section AND c.item = a.item GROUP BY a.id, a.section),
    judged AS (SELECT q.id, q.section, a.result, coalesce(concat(',', q.choices, ',') LIKE concat('%,', a.result, ',%'), false) AS good FROM asked q LEFT JOIN a ON a.id = q.id AND a.section = q.section AND a.item = q.item)
    SELECT j.id, j.section, sum(CASE WHEN good THEN 0 ELSE 1 END) = 0 AND max(u.n) = 0 AS complete, CAST(sum(CASE WHEN result = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS issues
    FROM judged j JOIN unknown u ON u.id = j.id AND u.section = j.section GROUP BY j.id, j.section"""


def live_shipments(d) -> str:
    """The latest shipment of a file (a user's events) that wasn't withdrawn (an error), and how many there were."""
    return "SELECT user_id, max(CASE WHEN event_type <> 'error' THEN event_id END) AS live, count(*) AS shipments FROM events GROUP BY user_id"


def sibling_turns(d) -> str:
    """The turn before and after each turn."""
    return "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before_turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after_turn FROM conversations"


def table_shapes(d) -> str:
    """Tables (orders) by their cells: rows of three, most columns, header cells, the span of pages."""
    row = "CAST(floor((l_linenumber - 1) / 3) AS BIGINT)"
    return f"""
    SELECT l_orderkey, count(*) AS n_rows, max(cols) AS most_cols, CAST(sum(heads) AS BIGINT) AS header_cells, max(last_page) - min(first_page) AS page_span FROM (
      SELECT l_orderkey, {row} AS r, count(*) AS cols, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS heads, min(l_suppkey) AS first_page, max(l_suppkey) AS last_page FROM lineitem GROUP BY l_orderkey, {row}) GROUP BY l_orderkey"""


def element_fonts(d) -> str:
    """An element's most frequent size, to the half and the first seen of equals, and its share of bold runs."""
    return """
    SELECT l_orderkey, size, round(CAST(bold AS DOUBLE) / runs, 6) AS bold_share FROM (
      SELECT l_orderkey, size, sum(bold) OVER (PARTITION BY l_orderkey) AS bold, sum(n) OVER (PARTITION BY l_orderkey) AS runs, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first_line, size) AS place FROM (
        SELECT l_orderkey, round(l_quantity * 2 / 10) / 2 AS size, count(*) AS n, min(l_linenumber) AS first_line, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bold FROM lineitem GROUP BY l_orderkey, round(l_quantity * 2 / 10) / 2)) WHERE place = 1"""


def total_runtimes(d) -> str:
    """Runtime of a user's steps; 'at least' where a step (an error) has none."""
    return f"""
    SELECT user_id, concat(CASE WHEN missing > 0 THEN 'at least ' ELSE '' END, CAST(seconds AS STRING), ' s') AS runtime FROM (
      SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS missing, CAST(coalesce(sum(CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END), 0) AS BIGINT) AS seconds FROM events GROUP BY user_id)"""


def next_ids(d) -> str:
    """The next number of a run's sessions, three digits."""
    return "SELECT conv_id, lpad(CAST(max(turn) + 1 AS STRING), 3, '0') AS next_id FROM conversations GROUP BY conv_id"


def stratified_sample(d) -> str:
    """A hundred documents, source by source in turn, by the hash of their id: a repeatable sample that no source fills."""
    h = d.sha256("CAST(doc_id AS STRING)")
    return f"""
    SELECT doc_id, source, rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {h}, doc_id) AS rn FROM documents)
    WHERE rn <= 100 ORDER BY rn, source LIMIT 100"""


def group_outcomes(d) -> str:
    """Answers of three judges by several groups of an item at once, and how many items they all answer alike."""
    judges = " UNION ALL ".join(f"SELECT doc_id, {i} AS judge, {e} AS v FROM labels" for i, e in enumerate(("quality", "toxic", "(quality + toxic) % 2")))
    return f"""
    WITH j AS ({judges}), items AS (SELECT doc_id, CASE WHEN count(DISTINCT v) = 1 AND count(*) = 3 THEN 1 ELSE 0 END AS alike FROM j GROUP BY doc_id),
    g AS (SELECT doc_id, 'all' AS grp FROM labels UNION ALL SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 2000)
    SELECT grp, judge, count(*) AS n, CAST(sum(v) AS BIGINT) AS said_yes, CAST(sum(alike) AS BIGINT) AS alike FROM g JOIN j ON j.doc_id = g.doc_id JOIN items ON items.doc_id = g.doc_id GROUP BY grp, judge"""


def _learned(d) -> str:
    """CTEs: calls (orders as a ledger: priority is the kind, customers fall in 40 books), what each kind learns, model."""
    quantile = lambda p: f"min(CASE WHEN share >= {p} - 1e-9 THEN ratio END)"
    return f"""
    WITH ledger AS (SELECT o_orderpriority AS kind, o_custkey % 40 AS book, o_orderkey AS id, floor(o_totalprice) AS input_est, floor(o_totalprice) * (10 + o_orderkey % 7) / 10 AS billed,
      CAST(200 + o_orderkey % 5000 AS DOUBLE) AS output, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders WHERE o_totalprice >= 1),
    calls AS (SELECT kind, book, id, input_est, billed, output, ln(input_est / 1000) AS x, ln(output) AS y FROM ledger WHERE age <= {WINDOW}),
    books AS (SELECT kind, book, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(x * x) AS xx, avg(x * y) AS xy FROM calls GROUP BY kind, book),
    kinds AS (SELECT kind, sum(n) AS calls, count(*) AS books, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM books GROUP BY kind),
    fits AS (SELECT kind, book, n, (y * xx - x * xy) / (s * xx - x * x) AS a, (s * xy - x * y) / (s * xx - x * x) AS b FROM (
      SELECT k.kind, CAST(NULL AS BIGINT) AS book, k.calls AS n, k.books + 1e-6 AS s, k.x, k.y, k.xx + 1e-6 AS xx, k.xy FROM kinds k
      UNION ALL SELECT k.kind, b.book, b.n, k.books - 1 + 1e-6, k.x - b.x, k.y - b.y, k.xx - b.xx + 1e-6, k.xy - b.xy FROM kinds k JOIN books b ON b.kind = k.kind WHERE k.books >= 3)),
    ratios AS (SELECT kind, ratio, sum(w) OVER (PARTITION BY kind ORDER BY ratio, book ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER (PARTITION BY kind) AS share FROM (
      SELECT c.kind, c.book, c.output / exp(f.a + f.b * c.x) AS ratio, CAST(1 AS DOUBLE) / f.n AS w FROM calls c JOIN fits f ON f.kind = c.kind AND f.book = c.book)),
    model AS (SELECT k.kind, k.calls, k.books, f.a, f.b, q.lo, q.md, q.hi, i.input_ratio, i.max_input FROM kinds k
      JOIN fits f ON f.kind = k.kind AND f.book IS NULL
      JOIN (SELECT kind, {quantile(LOW)} AS lo, {quantile(0.5)} AS md, {quantile(HIGH)} AS hi FROM ratios GROUP BY kind) q ON q.kind = k.kind
      JOIN (SELECT kind, {d.median("billed / input_est")} AS input_ratio, max(input_est) AS max_input FROM calls GROUP BY kind) i ON i.kind = k.kind
      WHERE k.calls >= {CALLS} AND k.books >= {BOOKS})"""


def learned_costs(d) -> str:
    """What a kind's last 80 calls teach: a weighted line of the logarithms, and quantiles of the ratios that each book has to the line of all others.

    A book left out is the totals less its own, so no fit is repeated.
    """
    return f"""{_learned(d)}
    SELECT kind, CAST(calls AS BIGINT) AS calls, books, round(a, 6) AS a, round(b, 6) AS b, round(lo, 6) AS lo, round(md, 6) AS md, round(hi, 6) AS hi, round(input_ratio, 6) AS input_ratio, max_input FROM model"""


def expected_costs(d) -> str:
    """What runs will cost (80 older orders of each kind as their requests): expected, low and high, never above the ceiling; the thinnest basis; whether any request is larger than all learned from."""
    out = lambda q: f"least(exp(m.a + m.b * ln(r.input_est / 1000)) * m.{q}, 3000)"
    total = lambda q: f"sum(r.input_est * m.input_ratio * 3e-6 + {out(q)} * 15e-6)"
    return f"""{_learned(d)}
    SELECT run, requests, round(usd, 4) AS usd, round(least(low, usd), 4) AS low, round(greatest(high, usd), 4) AS high, CAST(basis AS BIGINT) AS basis, beyond FROM (
      SELECT r.book % 8 AS run, count(*) AS requests, least({total("md")}, 9.0) AS usd, {total("lo")} AS low, least({total("hi")}, 9.0) AS high, min(m.calls) AS basis, max(CASE WHEN r.input_est > m.max_input THEN 1 ELSE 0 END) = 1 AS beyond
      FROM (SELECT * FROM ledger WHERE age BETWEEN {WINDOW + 1} AND {2 * WINDOW}) r JOIN model m ON m.kind = r.kind GROUP BY r.book % 8)"""
