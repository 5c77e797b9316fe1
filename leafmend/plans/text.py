"""Text audits: repeated lines, suspect words, junk, scripts, pages' titles and links."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
#: Characters for classes of regular expressions: all white space, of Unicode too; those of CJK scripts, without and with full-width forms or compatibility ideographs.
SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CJK = r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{AC00}-\x{D7AF}"
CJK_WIDE, CJK_COMPAT = CJK + r"\x{FF00}-\x{FFEF}", CJK + r"\x{F900}-\x{FAFF}"
#: Signs that words are stripped of at their edges, and those that make a word junk.
EDGES = r".,;:!?()\[\]\x22\x27"
EDGES_MORE = EDGES + "’‘“”–—-"
JUNK = r"[#@®©&§¶|\\^~{}<>¤¢£¥€°±×÷=+*_™]"


#: Link texts that say nothing, and those that are an address only.
GENERIC = r"^(click |tap )?(here|more|read more|learn more|link|this link|this|details|go|continue|website)[^\pL\pN_]*$"
ADDRESS = r"^\s*(https?://|www[.])\S+\s*$"


#: Most words: letters alone, the first of any case, which no rule of edges, junk or suspects can touch.
PLAIN_WORD = "^[A-Za-z][a-z]+$"


def _stripped(d, edges: str) -> str:
    """Documents' words without these signs at their edges, as column w, and whether they are plain; each text has one more that is empty (the stop), so that none is left out."""
    core = d.replaced("raw", f"^[{edges}]+|[{edges}]+$", "")
    return f"""(SELECT doc_id, plain, CASE WHEN plain THEN raw ELSE {core} END AS w FROM (SELECT doc_id, raw, {d.matches("raw", PLAIN_WORD)} AS plain FROM (SELECT doc_id, concat(coalesce(text, ''), ' .') AS text FROM documents) {d.each(d.found("text", f"[^{SPACES}]+"), "raw")}))"""


def repeated_lines(d) -> str:
    """Running heads: digits and roman-numeral letters become #; kept when seen 3 times or more with 3 letters or more."""
    mark = d.replaced("lower(line)", "[0-9ivxlc]+", "#")
    return f"""
    SELECT pattern, count(*) AS n, min(line) AS example, min(doc_id) AS first_doc, max(doc_id) AS last_doc
    FROM (SELECT doc_id, line, {mark} AS pattern FROM documents {d.each(d.lines("text"), "line")})
    WHERE length({d.replaced("line", "[^A-Za-z]", "")}) >= 3
    GROUP BY pattern HAVING count(*) >= 3"""


def suspect_forms_topk(d) -> str:
    """Word forms with a symbol after a letter: ranked by count, the first 700 kept, ties by form."""
    core = d.replaced("w", "^[.,;:!?]+|[.,;:!?]+$", "")
    return f"""
    SELECT form, n, pages, first_doc, place FROM (
      SELECT form, count(*) AS n, count(DISTINCT doc_id) AS pages, min(doc_id) AS first_doc, CAST(row_number() OVER (ORDER BY count(*) DESC, form) AS BIGINT) AS place
      FROM (SELECT doc_id, {core} AS form FROM documents {d.each(d.found("text", WORD), "w")})
      WHERE {d.matches("form", "[A-Za-z][#*$%&|<>@=+_]")} GROUP BY form)
    WHERE place <= 700"""


def text_quality_by_source(d) -> str:
    """Suspect words for each 1000 words of a source: a letter by itself other than a, A and I, or anything but letters, quotes and stops between letters."""
    between = rf"[A-Za-z][^A-Za-z{SPACES}\x27’\-.,;:!?)\]”\x22]+[A-Za-z]"
    return f"""
    SELECT source, count(*) AS tokens, CAST(sum(bad) AS BIGINT) AS suspect, round(CAST(1000 AS DOUBLE) * sum(bad) / count(*), 4) AS per_thousand
    FROM (SELECT source, CASE WHEN {d.matches("w", PLAIN_WORD)} THEN 0 WHEN {d.matches("w", r"^\pL$")} AND w NOT IN ('a', 'A', 'I') OR {d.matches("w", between)} THEN 1 ELSE 0 END AS bad FROM documents {d.each(d.found("text", f"[^{SPACES}]+"), "w")})
    GROUP BY source"""


def junk_stats(d) -> str:
    """Share of junk words; a document is flagged from a share of 0.05 of 30 words or more.

    Junk is a word with a junk sign, capitals without a vowel, or letters and
    digits mixed other than ordinals; CJK words are fine.
    """
    capitals = f"w = upper(w) AND w <> lower(w) AND {d.matches('w', '[A-Za-z][^A-Za-z]*[A-Za-z]')} AND NOT {d.matches('w', '[AEIOUY]')}"
    mixed = f"{d.matches('w', '[A-Za-z]')} AND {d.matches('w', r'\p{Nd}')} AND NOT {d.matches('w', r'^\p{Nd}+(st|nd|rd|th|s|[a-z])$')}"
    return f"""
    SELECT doc_id, tokens, junk, round(junk / greatest(tokens, 1), 6) AS share, tokens >= 30 AND junk / greatest(tokens, 1) >= 0.05 AS flagged FROM (
      SELECT doc_id, CAST(sum(CASE WHEN w <> '' THEN 1 ELSE 0 END) AS DOUBLE) AS tokens,
        CAST(sum(CASE WHEN plain THEN 0 WHEN NOT {d.matches("w", f"[{CJK_COMPAT}]")} AND ({d.matches("w", JUNK)} OR {capitals} OR {mixed}) THEN 1 ELSE 0 END) AS DOUBLE) AS junk
      FROM {_stripped(d, EDGES_MORE)} GROUP BY doc_id)"""


def textlike_gate(d) -> str:
    """Text is like text from 15 wordlike words and a share of 0.6: two letters or more with a vowel, or any CJK character."""
    wordlike = f"plain AND {d.matches('w', '[aeiouyAEIOUY]')} OR NOT plain AND ({d.matches('w', r'^[\pL\p{Nl}\p{No}]{2,}$')} AND {d.matches('w', '[aeiouyAEIOUY]')} OR {d.matches('w', f'[{CJK_WIDE}]')})"
    return f"""
    SELECT doc_id, tokens, wordlike, wordlike >= 15 AND wordlike >= 0.6 * tokens AS textlike FROM (
      SELECT doc_id, CAST(sum(CASE WHEN w <> '' THEN 1 ELSE 0 END) AS BIGINT) AS tokens, CAST(sum(CASE WHEN {wordlike} THEN 1 ELSE 0 END) AS BIGINT) AS wordlike
      FROM {_stripped(d, EDGES)} GROUP BY doc_id)"""


def script_histogram(d) -> str:
    """Characters by script block and language."""
    count = lambda cls: f"sum(length({d.replaced('text', f'[^{cls}]+', '')}))"
    return f"""
    SELECT lang, CAST({count("A-Za-z")} AS BIGINT) AS latin_basic, CAST({count("À-ÖØ-öø-ÿ")} AS BIGINT) AS latin_accented,
      CAST({count("0-9")} AS BIGINT) AS digits, CAST({count("一-鿿")} AS BIGINT) AS han, CAST({count("ぁ-ヿ")} AS BIGINT) AS kana, CAST({count("가-힣")} AS BIGINT) AS hangul
    FROM documents GROUP BY lang"""


def script_kind_action(d) -> str:
    """Kind of a CJK run, and what is done: kana is Japanese, hangul Korean, Han alone is put off, Latin inherits."""
    kana, hangul, han, latin = (d.matches("s", x) for x in ("[ぁ-ヿ]", "[가-힣]", "[一-鿿]", "[A-Za-z]"))
    kind = f"CASE WHEN {kana} THEN 'kana' WHEN {hangul} THEN 'hangul' WHEN {han} AND {latin} THEN 'mixed_with_latin' WHEN {han} THEN 'han_only' END"
    return f"""
    SELECT id, kind, CASE kind WHEN 'kana' THEN 'ja' WHEN 'hangul' THEN 'ko' ELSE 'en' END AS lang,
      CASE WHEN kind IN ('kana', 'hangul') THEN 'tag' WHEN kind IS NULL THEN 'inherit' ELSE 'defer' END AS action
    FROM (SELECT id, {kind} AS kind FROM {d.given('scripts')})"""


def lang_tag_norm(d) -> str:
    """Language tags in canonical case; NULL where the shape is wrong."""
    part = lambda i: d.first("tag", r"^([A-Za-z]{2,3})(?:[-_]([A-Za-z]{4}))?(?:[-_]([A-Za-z]{2}|[0-9]{3}))?$", i)
    return f"""
    SELECT tag, lower({part(1)}) AS primary_tag, CASE WHEN {part(1)} = '' THEN NULL ELSE
      concat(lower({part(1)}), CASE WHEN {part(2)} = '' THEN '' ELSE concat('-', upper(substr({part(2)}, 1, 1)), lower(substr({part(2)}, 2))) END,
        CASE WHEN {part(3)} = '' THEN '' ELSE concat('-', upper({part(3)})) END) END AS canonical
    FROM (SELECT DISTINCT lang AS tag FROM documents WHERE lang IS NOT NULL UNION ALL
      SELECT tag FROM (VALUES ('EN-us'), ('zh_hans_cn'), ('ms-Latn'), ('x'), ('de-DE-1996-x'), ('es-419')) AS v(tag))"""


def html_title_checks(d) -> str:
    """Titles: missing, generic, a file name, or usable (3 to 300 characters with 3 letters or more)."""
    title = d.first("html", "<title>([^<]*)</title>")
    return f"""
    SELECT page_id, title, CASE WHEN trim(title) = '' THEN 'missing' WHEN {d.matches("lower(title)", "^(untitled|document|page|home|index)( [0-9]+)?$")} THEN 'generic'
      WHEN {d.matches("lower(title)", "[.](pdf|docx?|html?)$")} THEN 'file name'
      WHEN length(title) BETWEEN 3 AND 300 AND length({d.replaced("title", r"[^\pL]", "")}) >= 3 THEN 'usable' ELSE 'unusable' END AS state
    FROM (SELECT page_id, {title} AS title FROM pages)"""


def link_counts(d) -> str:
    """Links of a page, the 15 pages with most."""
    return f"""
    SELECT page_id, links FROM (SELECT page_id, CAST({d.size(d.found("html", "<a [^>]*href=", 0))} AS BIGINT) AS links FROM pages)
    WHERE links > 0 ORDER BY links DESC, page_id LIMIT 15"""


def link_text_flags(d) -> str:
    """Link texts that say nothing: generic, an address only, without letters, or used three times or more."""
    return f"""
    SELECT t, n, CASE WHEN {d.matches("lower(t)", GENERIC)} THEN 'generic' WHEN {d.matches("t", ADDRESS)} THEN 'address'
      WHEN NOT {d.matches("t", r"\pL")} THEN 'no letters' WHEN n >= 3 THEN 'repeated' ELSE 'fine' END AS flag
    FROM (SELECT t, count(*) AS n FROM (SELECT trim(x) AS t FROM pages {d.each(d.found("html", "<a [^>]*>([^<]*)</a>", 1), "x")}) GROUP BY t)"""


def slugs(d) -> str:
    """Headings as anchors (letters, digits, underscores and hyphens stay, each space is a hyphen), and cut to 40 characters."""
    h = d.first("html", "<h1[^>]*>([^<]*)</h1>")
    return f"""
    SELECT page_id, {d.replaced(d.replaced("lower(trim(h))", r"[^\pL\pN_ -]", ""), " ", "-")} AS slug,
      CASE WHEN length(c) <= 40 THEN c ELSE concat(substr(c, 1, 39), '…') END AS clipped
    FROM (SELECT page_id, h, trim({d.replaced("h", "[ ]+", " ")}) AS c FROM (SELECT page_id, {h} AS h FROM pages))"""


def token_estimate(d) -> str:
    """A token for each CJK character and 3.5 others, with an allowance of 1.7 times and 10."""
    cjk = f"length({d.replaced('text', '[^一-鿿ぁ-ヿ가-힣]+', '')})"
    return f"SELECT doc_id, CAST(floor(({cjk} + (length(text) - {cjk}) / CAST(3.5 AS DOUBLE)) * CAST(1.7 AS DOUBLE)) AS BIGINT) + 10 AS size FROM documents"


def grouping_two_level(d) -> str:
    """Places by language, and by language and source, in one pass."""
    return """
    SELECT lang, source, count(*) AS places, count(DISTINCT n_chars) AS forms, CAST(grouping(source) AS BIGINT) AS whole
    FROM documents GROUP BY GROUPING SETS ((lang), (lang, source))"""


def cleaned_text(d) -> str:
    """A person's text as kept, by hashes: line ends become plain, control characters but tabs and line feeds go, directions too; as it is, and on one line."""
    plain = "replace(replace(coalesce(text, ''), concat(chr(13), chr(10)), chr(10)), chr(13), chr(10))"
    kept = d.replaced(plain, r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}]", "")
    return f"SELECT doc_id, {d.sha256(d.trimmed('t', WHITE_SPACE))} AS hash, {d.sha256('trim(' + d.replaced('t', f'[{SPACES}]+', ' ') + ')')} AS line_hash FROM (SELECT doc_id, {kept} AS t FROM documents)"


def duplicate_text_flags(d) -> str:
    """Titles of pages as alternative texts: generic or empty, a file name, without letters, or used on three pages or more."""
    return f"""
    SELECT page_id, CASE WHEN {d.matches("t", r"(?i)^(illustration|image|img|picture)?[\s_-]*[0-9]*$")} THEN 'generic' WHEN {d.matches("lower(t)", "[.](jpe?g|png|gif|tiff?|pdf)$")} THEN 'file name' WHEN NOT {d.matches("t", r"\pL")} THEN 'no letters' WHEN n >= 3 THEN 'repeated' END AS flag
    FROM (SELECT page_id, t, count(*) OVER (PARTITION BY t) AS n FROM (SELECT page_id, trim({d.first("html", "<title>([^<]*)</title>")}) AS t FROM pages
      UNION ALL SELECT id, t FROM (VALUES (-1, 'fig1.PNG'), (-2, '12 - 3'), (-3, 'A map'), (-4, 'A map'), (-5, 'A map'), (-6, 'A plan')) AS v(id, t)))"""


def loose_keys(d) -> str:
    """Words that fall together when all but letters and digits is left out, case aside."""
    return f"""
    SELECT key, count(DISTINCT w) AS spellings, count(*) AS n FROM (SELECT w, lower({d.replaced("w", r"[^\pL\pN]", "")}) AS key FROM documents {d.each(d.found("text", WORD), "w")})
    WHERE key <> '' GROUP BY key HAVING count(DISTINCT w) > 1"""


def excerpts(d) -> str:
    """About the first 100 characters of a document, cut at a word's end where one comes after 60, signs before the cut left out."""
    flat = f"trim({d.replaced('text', f'[{SPACES}]+', ' ')})"
    cut = "CASE WHEN sp > 60 THEN substr(t, 1, sp) ELSE substr(t, 1, 100) END"
    return f"""
    SELECT doc_id, CASE WHEN t IS NULL OR length(t) <= 100 THEN t ELSE concat({d.replaced(cut, "[ ,;:.–—-]+$", "")}, '…') END AS excerpt
    FROM (SELECT doc_id, t, CAST(length({d.replaced("substr(t, 1, 101)", "[^ ]*$", "")}) AS INT) - 1 AS sp FROM (SELECT doc_id, {flat} AS t FROM documents))"""


def markdown_escaped(d) -> str:
    """Texts as Markdown quotes, by the hash of the result: every line begins with '> ', marks are escaped, and what would begin a heading, quote or list at a line's start."""
    marks = d.replaced("{part}", r"([\\`*_\[\]<>])", d.escaped)
    start = d.replaced(d.replaced(marks, r"^(\s*)([#>+=-])", d.escaped_second), r"^(\s*\d+)([.)])", d.escaped_second)
    each = f"CASE WHEN {d.matches('{part}', f'[^{SPACES}]'.replace('{', '{{').replace('}', '}}'))} THEN concat('> ', {start}) ELSE '>' END"
    return f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {d.sha256(d.strung(d.placed(d.lines('text'), each), chr(10)))} END AS hash FROM documents"


def stem_names(d) -> str:
    """File names (the last part of an address) as read: no .pdf, underscores and hyphens as spaces."""
    last = d.first("url", "([^/?#]*)/*(?:[?#].*)?$")
    stem = f"trim({d.replaced(d.replaced(d.replaced('file', '(?i)[.]pdf$', ''), '[_-]+', ' '), f'[{SPACES}]+', ' ')})"
    return f"SELECT page_id, coalesce(nullif({stem}, ''), file) AS stem FROM (SELECT page_id, {last} AS file FROM pages)"
