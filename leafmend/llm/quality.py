"""Quality rules, line first, in native expressions only.

Each line is judged on its own: navigation (menus of links, menu words in a short
line), boilerplate (rights, cookies, licences and the like in a short line),
shouting and lines of signs rather than words fail; so does the punctuation rule, a long run
of words without any sentence punctuation. Failing lines are removed, and a
document that loses too much of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

WINDOW, LEAST_WORDS, REPEAT_SHARE = 8, 20, 30
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
#: A document that keeps less than this share of its words' characters is rejected, in percent.
KEEP_SHARE = 50
#: Longest line, in characters, that navigation and boilerplate rules look at; words from which a line needs punctuation.
SHORT_LINE, LONG_LINE = 200, 60
#: Phrases of navigation and boilerplate, in lower case.
NAVIGATION = r"^(home|menu|login|log in|sign in|sign up|search|next|previous|back to top|skip to content|read more|share)( *[|>/·•-].*)?$"
#: Signs between the links of a menu: two or more, and one for each so many words or fewer, make a menu of a line.
BARS, BAR_WORDS = "|>»", 6
#: A line with more than one exclamation mark for each so many characters shouts.
SHOUT = 12
BOILERPLATE = (
    r"all rights reserved|copyright|©|cookie|privacy policy|terms of (use|service)|subscribe|newsletter|javascript|"
    r"click here|spdx-license|licensed under|permission is hereby granted|lorem ipsum"
)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ink(text: Column) -> Column:
    """The text without white space. Regular expressions do this far faster than translate()."""
    return F.regexp_replace(text, F.lit(SPACE), F.lit(""))


def _count(text: Column, signs: str) -> Column:
    """How many of the signs of a character class a text has."""
    return F.length(F.regexp_replace(text, F.lit(f"[^{signs}]+"), F.lit("")))


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but the six ASCII white-space characters."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of so many words that occur twice or more in the array.

    Windows are compared by 64-bit hashes. Only an array with a repeated hash
    is sorted; neighbours of equal hash give the starts, whose spans are added up.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))

        def total(p: Column) -> Column:
            zero = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"))
            return F.aggregate(p, zero, step, lambda a: a["n"])

        return _let(pairs, lambda s: _let(starts(s), total))

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))

    many = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    coded = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(_let(coded, lambda w: _let(hashes(w), many)))


def bad_line(line: Column) -> Column:
    """Whether a line with words fails a line rule."""
    low, short = F.lower(line), F.length(line) <= SHORT_LINE
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    signs, bars, shouts, inked = _count(line, SYMBOLS), _count(line, BARS), _count(line, "!"), F.length(_ink(line))
    menu = (bars >= 2) & (BAR_WORDS * bars >= words)
    unpunctuated = (words >= LONG_LINE) & ~line.rlike("[.,!?;:…。！？]")
    return (short & (F.trim(low).rlike(NAVIGATION) | low.rlike(BOILERPLATE))) | menu | (5 * signs > inked) | ((shouts > 2) & (SHOUT * shouts > inked)) | unpunctuated


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text), row by row.

    docs: doc_id and text, other columns ignored. A null text has no words and
    fails; so does an empty one. clean_text joins the lines that pass (blank
    ones too) by line feeds and is null where the text is. A text is judged
    whole; repeated rows are judged each, and a null doc_id stays null; an
    empty table gives no rows. Nothing is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    inked = lambda x: x.rlike(WORD)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(_ink(text)).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        _let(F.filter(lines, inked), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
        F.when(F.col("text").isNotNull(), F.array_join(F.filter(lines, lambda x: ~(inked(x) & bad_line(x))), "\n")).alias("clean_text"),
    )
    n, r = F.col("w")["n"], F.col("w")["r"]
    failed = (n < LEAST_WORDS) | (100 * r > REPEAT_SHARE * n)
    left = F.length(_ink(F.coalesce("clean_text", F.lit(""))))
    kept = ~failed & (100 * left >= KEEP_SHARE * F.col("word_chars"))
    return rows.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed"), kept.alias("kept"), "clean_text")


def digest(docs: DataFrame) -> DataFrame:
    return judged(docs).drop("clean_text")


#: The same in DuckDB's SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 7)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM rep, range(8) t(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lj AS (
  SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS inked FROM ln),
lf AS (SELECT doc_id, line, inked,
    (length(line) <= {SHORT_LINE} AND (regexp_matches(trim(lower(line), ' '), '{NAVIGATION}') OR regexp_matches(lower(line), '{BOILERPLATE}')))
    OR 5 * (inked - length(regexp_replace(line, '[\x20\x09-\x0D#*$%&|<>]', '', 'g'))) > inked
    OR (length(line) - length(regexp_replace(line, '[{BARS}]', '', 'g')) >= 2
      AND {BAR_WORDS} * (length(line) - length(regexp_replace(line, '[{BARS}]', '', 'g'))) >= length(line) - length(replace(line, ' ', '')) + 1)
    OR (length(line) - length(replace(line, '!', '')) > 2 AND {SHOUT} * (length(line) - length(replace(line, '!', ''))) > inked)
    OR (length(line) - length(replace(line, ' ', '')) + 1 >= {LONG_LINE} AND NOT regexp_matches(line, '[.,!?;:…。！？]')) AS bad
  FROM lj WHERE inked > 0),
la AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN bad THEN 0 ELSE inked END) AS left_chars FROM lf GROUP BY doc_id),
j AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN la USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words) AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words) AND 100 * left_chars >= {KEEP_SHARE} * word_chars AS kept
FROM j
"""
