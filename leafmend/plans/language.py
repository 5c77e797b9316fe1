"""Language values, replies about word forms, and how far a book's release has come; given.py takes replies and results from the tables."""

from __future__ import annotations

from .given import values as _values
from .rules import SHORT, SUPPRESSED

#: The languages that may be written, by tag, with their names for people.
NAMES = {
    "en": "English", "fr": "French", "de": "German", "es": "Spanish", "pt": "Portuguese", "it": "Italian", "nl": "Dutch", "la": "Latin", "haw": "Hawaiian", "tl": "Tagalog",
    "fil": "Filipino", "ilo": "Ilokano", "bik": "Bikol", "vi": "Vietnamese", "id": "Indonesian", "ms": "Malay", "mi": "Māori", "sm": "Samoan", "to": "Tongan", "ja": "Japanese",
    "ko": "Korean", "zh": "Chinese", "zh-Hant": "Chinese (Traditional)", "zh-Hans": "Chinese (Simplified)", "ar": "Arabic", "he": "Hebrew", "ru": "Russian", "el": "Greek", "th": "Thai",
    "ja-Latn": "Japanese (Romanized)", "zh-Latn": "Chinese (Romanized)", "ko-Latn": "Korean (Romanized)", "sa": "Sanskrit", "sa-Latn": "Sanskrit (Romanized)", "pi": "Pali",
    "pi-Latn": "Pali (Romanized)", "yue": "Cantonese", "mh": "Marshallese", "chk": "Chuukese", "pon": "Pohnpeian", "ch": "Chamorro", "ty": "Tahitian", "fj": "Fijian", "gil": "Gilbertese",
    "ceb": "Cebuano", "hil": "Hiligaynon", "pam": "Kapampangan", "pag": "Pangasinan", "war": "Waray", "bo": "Tibetan", "mn": "Mongolian", "hi": "Hindi", "ur": "Urdu", "fa": "Persian",
    "tr": "Turkish", "km": "Khmer", "my": "Burmese", "lo": "Lao", "ug": "Uyghur", "ain": "Ainu", "ryu": "Okinawan", "sv": "Swedish", "da": "Danish", "no": "Norwegian", "pl": "Polish",
    "cs": "Czech", "hu": "Hungarian", "fi": "Finnish", "grc": "Ancient Greek", "yue-Latn": "Cantonese (Romanized)", "grc-Latn": "Ancient Greek (Romanized)", "tpi": "Tok Pisin",
    "jv": "Javanese", "aoi": "Anindilyakwa", "bcl": "Central Bikol", "ban": "Balinese", "su": "Sundanese", "min": "Minangkabau", "aly": "Alyawarr", "bbc": "Batak Toba", "mak": "Makasar",
    "rar": "Rarotongan", "ks": "Kashmiri", "kk": "Kazakh", "jv-Latn": "Javanese (Latin script)", "ryu-Latn": "Okinawan (Romanized)", "bo-Latn": "Tibetan (Romanized)",
    "hi-Latn": "Hindi (Romanized)", "ar-Latn": "Arabic (Romanized)", "ks-Latn": "Kashmiri (Romanized)", "kk-Latn": "Kazakh (Romanized)", "qaa": "Placeholder (local use)",
}
#: Other names that mean one language; codes replaced by others.
OTHER_NAMES = [("hawaii", "haw"), ("hawai", "haw"), ("hawai''i", "haw"), ("hawaiʻi", "haw"), ("hawai‘i", "haw"), ("olelo hawaii", "haw"), ("ʻōlelo hawaiʻi", "haw"), ("mandarin", "zh"), ("chinese", "zh"), ("cantonese", "yue")]
REPLACED = "iw in jw ji mo".split()
#: The shape of a tag (language, script, region, variants, extensions, private use).
SHAPE = r"^(?:[a-z]{2,3}(?:-[a-z]{3}){0,3}(?:-[A-Z][a-z]{3})?(?:-(?:[A-Z]{2}|[0-9]{3}))?(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?:-[a-wyz0-9](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?|x(?:-[a-z0-9]{1,8})+)$"
#: Confidences and reasons that a reply may give.
SURE, REASONS = ("high", "medium", "low"), ("language", "name", "english", "indeterminate", "unsure", "varies")

WRITTEN = [
    "en_US", " EN ", "english", "zh_hant_tw", "jpn-latn", "ja-Latn", "eng", "iw", "qaa", "qaa-x-a", "en-1994", "de-DE-1996", "x-ab", "x-ab-cd", "en-x-ab", "sl-rozaj", "ms-Latn", "en--US", "en US",
    "haw", "haw-US", "xx", "es-419", "en-u-co", "Hawaiian", "ʻŌlelo  Hawaiʻi", "Chinese (Romanized)", "MĀORI", "Hawai''i", "", None, "ja-Cyrl", "zh-Hant",
]


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _spelled(d, parts: str) -> str:
    """A tag's parts in canonical case: scripts begin with a capital, regions are capitals, but not behind an x."""
    late = "coalesce(lower({before}), '') <> 'x' AND {place} > 1"
    each = f"""CASE WHEN {late} AND {d.matches("{part}", "^[A-Za-z]{{4}}$")} THEN concat(upper(substr({{part}}, 1, 1)), lower(substr({{part}}, 2)))
      WHEN {late} AND {d.matches("{part}", "^[A-Za-z]{{2}}$")} THEN upper({{part}}) ELSE lower({{part}}) END"""
    return d.strung(d.placed(parts, each), "-")


def _tags(d, source: str) -> str:
    """Rows (id, written) with tag, shortest, name and allowed."""
    first, rest = d.first("tag", "^([^-]+)", 1), d.replaced("tag", "^[^-]+", "")
    two, second = d.first("tag", "^([^-]+-[^-]+)", 1), d.first("tag", "^[^-]+-([^-]+)", 1)
    pairs, names = _values(list(zip(SHORT[::2], SHORT[1::2], strict=True)), "m", "three, two"), _values(list(NAMES.items()), "k", "code, name")
    return f"""
    SELECT id, written, tag, shortest, name, coalesce(written = tag AND shortest = tag AND NOT one IN ({_listed(REPLACED)}) AND (one = 'qaa' OR name IS NOT NULL
      AND (coalesce(second, '') = '' OR by_two IS NOT NULL OR length(second) = 2 OR {d.matches("second", "^[0-9]+$")})), false) AS allowed
    FROM (SELECT s.id, s.written, s.tag, CASE WHEN s.tag IS NOT NULL THEN concat(coalesce(m.two, s.one), s.rest) END AS shortest, s.one, s.second, a.name AS by_two, coalesce(a.name, b.name) AS name
      FROM (SELECT id, written, tag, {first} AS one, {rest} AS rest, {two} AS pair, {second} AS second FROM (
        SELECT id, written, CASE WHEN {d.matches("spelt", SHAPE)} THEN spelt END AS tag FROM (SELECT id, written, {_spelled(d, d.split("trim(written)", "[-_]"))} AS spelt FROM {source}))) s
      LEFT JOIN {pairs} ON m.three = s.one LEFT JOIN (SELECT code, name FROM {names}) a ON a.code = s.pair LEFT JOIN (SELECT code, name FROM {names}) b ON b.code = s.one)"""


def written_tags(d) -> str:
    """Language values as written (and the documents'): canonical tag or null, its shortest form, its name for people, whether it may be written, the code that a name in its place means."""
    plain = [(n.lower(), c) for c, n in NAMES.items() if "(" not in n]
    known = {n for n, _ in OTHER_NAMES}
    means = _values(OTHER_NAMES + [x for x in plain if x[0] not in known], "w", "called, code")
    source = f"(SELECT id, written FROM {_values(list(enumerate(WRITTEN)), 'v', 'id, written')} UNION ALL SELECT 1000 + row_number() OVER (ORDER BY lang), lang FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))"
    return f"""
    SELECT t.id, t.tag, t.shortest, t.name, t.allowed, w.code AS from_name FROM ({_tags(d, source)}) t
    LEFT JOIN {means} ON w.called = lower(trim({d.replaced("t.written", "[ ]+", " ")}))"""


def _decided(d) -> str:
    """CTEs ending in decided: each decision with the code of the first reason against it, null where it is kept."""
    key = lambda x: f"lower({d.replaced(x, r'[^\pL\pN]', '')})"
    same = lambda x: f"lower(trim({d.replaced(x, '[ ]+', ' ')}))"
    bare = f"CASE WHEN {d.first('lang', '^([^-]+)-Latn$', 1)} IN ({_listed(SUPPRESSED)}) THEN {d.first('lang', '^([^-]+)-Latn$', 1)} ELSE lang END"
    return f"""
    WITH items AS (SELECT reply, item, form, grp, class FROM {d.given("requested")}),
    keys AS (SELECT DISTINCT reply, item, loose FROM (SELECT reply, item, {key("form")} AS loose FROM items UNION ALL SELECT reply, item, {key("form")} FROM {d.given("echoed")}) WHERE loose <> ''),
    owners AS (SELECT reply, loose, min(item) AS item FROM keys GROUP BY reply, loose HAVING count(*) = 1),
    given AS (SELECT reply, place, item, echo, lang AS said, {bare} AS lang, confidence, why FROM {d.given("decisions")}),
    tags AS (SELECT id, allowed FROM ({_tags(d, "(SELECT DISTINCT lang AS id, lang AS written FROM given WHERE lang IS NOT NULL)")})),
    judged AS (SELECT g.reply, g.place, g.item, g.lang, g.confidence, g.why, i.item IS NOT NULL AS known,
        CASE WHEN g.echo IS NOT NULL AND NOT coalesce({same("g.echo")} = {same("i.form")}, false) AND NOT coalesce(o.item = g.item, false) THEN 'echo'
          WHEN g.lang IS NOT NULL AND NOT coalesce(t.allowed, false) THEN 'tag'
          WHEN NOT coalesce(g.confidence IN ({_listed(SURE)}), false) OR NOT coalesce(g.why IN ({_listed(REASONS)}), false) THEN 'invalid' END AS fault
      FROM given g LEFT JOIN items i ON i.reply = g.reply AND i.item = g.item LEFT JOIN tags t ON t.id = g.lang LEFT JOIN owners o ON o.reply = g.reply AND o.loose = {key("g.echo")}),
    decided AS (SELECT reply, place, item, lang, confidence, why, CASE WHEN NOT known THEN 'unknown_id'
        WHEN coalesce(sum(CASE WHEN known AND fault IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY reply, item ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'twice' ELSE fault END AS code FROM judged)"""


def reply_decisions(d) -> str:
    """A reply's decisions with the first reason against each: its id unknown, decided before, its echo no item's or another's, its tag, its confidence or reason not allowed (an absent echo passes).

    Echoes fit their item's form but for white space and case, or by letters and digits alone where no other item of the
    request has the same; texts are taken to be in one normal form.
    """
    return f"{_decided(d)}\n    SELECT reply, place, item, lang, code FROM decided"


def form_answers(d) -> str:
    """Each item of each request: its decision, whether it is tagged, left to a person, shown on the review page, and why it has no answer.

    Where no item of a reply is tagged or a person's, all are shown.
    """
    return f"""{_decided(d)},
    gaps AS (SELECT reply, item, min_by(code, place) AS own FROM decided WHERE code IN ('echo', 'tag', 'invalid') GROUP BY reply, item),
    answers AS (SELECT i.reply, i.item, i.grp, i.class, k.lang, k.confidence, k.item IS NULL AS missing,
        CASE WHEN k.item IS NULL THEN CASE WHEN g.own IS NOT NULL THEN g.own WHEN r.finish = 'length' THEN 'cut_off' WHEN r.was_read = 'unreadable' THEN 'unreadable' WHEN r.was_read = 'partial' THEN 'invalid' ELSE 'not_answered' END END AS no_answer
      FROM items i LEFT JOIN (SELECT * FROM decided WHERE code IS NULL) k ON k.reply = i.reply AND k.item = i.item LEFT JOIN gaps g ON g.reply = i.reply AND g.item = i.item
      JOIN {d.given("replies", "r")} ON r.reply = i.reply),
    marked AS (SELECT reply, item, lang, no_answer, grp <> 'existing' AND lang IS NOT NULL AND coalesce(confidence IN ('high', 'medium'), false) AS tagged,
        grp = 'existing' OR missing OR {d.matches("class", "^(cjk|script):")} AND (lang IS NULL OR confidence = 'low') AS person FROM answers)
    SELECT reply, item, lang, no_answer, tagged, person, tagged OR person OR max(CASE WHEN tagged OR person THEN 1 ELSE 0 END) OVER (PARTITION BY reply) = 0 AS shown FROM marked"""


def release_lines(d) -> str:
    """A book's status, with the issues noted on its version; once shipped, the shipped copy's, and a line on what comes next; and the line on its evaluation."""
    noted = lambda n: f"concat(CAST({n} AS STRING), CASE WHEN {n} = 1 THEN ' issue noted' ELSE ' issues noted' END)"
    session = lambda x: f"concat('Session ', CAST(CAST({x} AS INT) AS STRING))"
    number = lambda x: f"coalesce({d.matches(x, '^[0-9]+$')}, false)"
    with_issues = lambda name, n: f"concat({name}, CASE WHEN {n} > 0 THEN concat(' · ', {noted(n)}) ELSE '' END)"
    # A result counts for the hash it was made on, the last one of equals; without one, the last of any hash tells of an earlier version.
    missing = f"""concat(CASE section WHEN 'pac' THEN 'PAC 2026' ELSE 'Screen-Reader Test' END, CASE state WHEN 'not recorded' THEN ' not recorded' WHEN 'could not be read' THEN ': could not be read in full: record it again'
      ELSE concat(': recorded on a previous version', CASE WHEN {number("ses")} THEN concat(', ', {session(f"CASE WHEN {number('ses')} THEN ses END")}) ELSE '' END) END)"""
    return f"""
    WITH books AS (SELECT book, cur, base_ok, shipped, finished, being, ses FROM {d.given("books")}),
    results AS (SELECT book, section, place, sha, session, whole, issues FROM {d.given("results")}),
    asked AS (SELECT b.book, v.sha, s.section FROM books b JOIN (SELECT book, cur AS sha FROM books UNION SELECT book, shipped FROM books WHERE shipped IS NOT NULL) v ON v.book = b.book
      JOIN {_values([("pac", 1), ("screen_reader", 1)], "s", "section, one")} ON s.one = 1),
    latest AS (SELECT book, sha, section, max_by(whole, place) AS whole, max_by(issues, place) AS issues FROM results GROUP BY book, sha, section),
    before AS (SELECT book, section, max(place) AS place, max_by(coalesce(session, ''), place) AS ses FROM results GROUP BY book, section),
    parts AS (SELECT a.book, a.sha, a.section, CASE WHEN l.whole THEN 'completed' WHEN l.whole IS NOT NULL THEN 'could not be read' WHEN e.place IS NOT NULL THEN 'earlier version' ELSE 'not recorded' END AS state, coalesce(l.issues, 0) AS issues, e.ses
      FROM asked a LEFT JOIN latest l ON l.book = a.book AND l.sha = a.sha AND l.section = a.section LEFT JOIN before e ON e.book = a.book AND e.section = a.section),
    judged AS (SELECT book, sha, min(CASE WHEN state = 'completed' THEN 1 ELSE 0 END) = 1 AS complete, min(CASE WHEN state = 'not recorded' THEN 1 ELSE 0 END) = 1 AS nothing, CAST(sum(issues) AS BIGINT) AS issues,
      max(CASE WHEN section = 'pac' AND state <> 'completed' THEN {missing} END) AS pac, max(CASE WHEN section <> 'pac' AND state <> 'completed' THEN {missing} END) AS reader FROM parts GROUP BY book, sha),
    current AS (SELECT b.*, CASE WHEN NOT base_ok THEN 'Not Ready' WHEN j.complete THEN 'Ready' ELSE 'Pending Evaluation' END AS name, j.issues, CASE WHEN j.complete THEN concat('Completed', CASE WHEN j.issues > 0 THEN concat(' (', {noted("j.issues")}, ')') ELSE '' END)
      WHEN j.nothing THEN 'Not Completed' ELSE concat('Not Completed (', coalesce(pac, ''), CASE WHEN pac IS NOT NULL AND reader IS NOT NULL THEN '; ' ELSE '' END, coalesce(reader, ''), CASE WHEN j.issues > 0 THEN concat('; ', {noted("j.issues")}) ELSE '' END, ')') END AS evaluation
      FROM books b JOIN judged j ON j.book = b.book AND j.sha = b.cur)
    SELECT c.book, CASE WHEN c.shipped IS NULL THEN {with_issues("c.name", "c.issues")} ELSE {with_issues("'Shipped'", "s.issues")} END AS status, evaluation,
      CASE WHEN c.shipped IS NULL THEN NULL WHEN {number("finished")} THEN concat('Newer version: ', {session("finished")}, ' finished, not applied') WHEN {number("being")} THEN concat('Newer version: ', {session("being")}, ' being reviewed')
        WHEN c.shipped <> c.cur THEN concat('Newer version', CASE WHEN {number("ses")} THEN concat(' (', {session("ses")}, ')') ELSE '' END, ': ', {with_issues("c.name", "c.issues")}) END AS newer
    FROM current c LEFT JOIN judged s ON s.book = c.book AND s.sha = c.shipped"""


def unfinished_requests(d) -> str:
    """The requests asked for that didn't finish: failed, cut off or sent again in part without a sound second reply, ended otherwise, unreadable, or never sent."""
    sound = "NOT error AND coalesce(finish = 'stop', false) AND NOT unreadable AND NOT again"
    return f"""
    WITH sent AS (SELECT n, sha, again_for, error, again, finish, unreadable FROM {d.given('sent', 't')}),
    second AS (SELECT again_for, max_by(CASE WHEN {sound} THEN 1 ELSE 0 END, n) = 1 AS good FROM sent WHERE again_for IS NOT NULL GROUP BY again_for),
    done AS (SELECT s.n, NOT error AND CASE WHEN again OR coalesce(finish = 'length', false) THEN coalesce(r.good, false) ELSE {sound} END AS good FROM sent s LEFT JOIN second r ON r.again_for = s.sha WHERE s.again_for IS NULL)
    SELECT a.n FROM {d.given("asked", "a")} LEFT JOIN done ON done.n = a.n WHERE NOT coalesce(good, false)"""


def whole_costs(d) -> str:
    """A book's expected cost with its page readings: as it is where none are to be read or it has no figure, no figure where the readings have none, else the sums on the thinner basis."""
    return f"""
    SELECT id, CASE WHEN alone THEN usd WHEN p_usd IS NOT NULL THEN usd + p_usd END AS usd, CASE WHEN alone THEN low WHEN p_usd IS NOT NULL THEN coalesce(low, usd) + coalesce(p_low, p_usd) END AS low,
      CASE WHEN alone THEN high WHEN p_usd IS NOT NULL THEN coalesce(high, usd) + coalesce(p_high, p_usd) END AS high, CASE WHEN alone THEN calls WHEN p_usd IS NOT NULL THEN least(calls, p_calls) END AS calls,
      CASE WHEN alone THEN beyond ELSE p_usd IS NOT NULL AND (beyond OR p_beyond) END AS beyond, CASE WHEN NOT alone AND p_usd IS NULL THEN coalesce(p_none, 'no_page_figure') END AS missing
    FROM (SELECT *, usd IS NULL OR to_read = 0 AS alone FROM {d.given("figures", "t")})"""
