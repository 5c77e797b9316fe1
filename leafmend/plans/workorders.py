"""A work order's keys against what its book holds, each item with the first reason against it (null: kept).

The reasons are fixed values, output that must be the same word for word. A
book has 12 pages; its objects, styles and decisions come from the tables by
given.py.
"""

from __future__ import annotations

PAGES = 12
TYPES = "'H1', 'H2', 'H3', 'H4', 'H5', 'H6', 'P', 'Span', 'Caption', 'Note', 'Div'"


def _range(low: str, high: str) -> str:
    return f"coalesce({low} BETWEEN 1 AND {PAGES} AND {high} BETWEEN 1 AND {PAGES}, false)"


def role_checks(d) -> str:
    """Style mappings, new types of elements, alternative texts."""
    styles, objects = d.given("styles", "s"), d.given("objects", "o")
    return f"""
    SELECT 'rolemap' AS part, pos, CASE WHEN s.style IS NULL THEN 'unknown style' WHEN NOT coalesce(target IN ({TYPES}), false) THEN 'target not allowed' END AS why
    FROM {d.given('maps', 'm')} LEFT JOIN {styles} ON s.style = m.style
    UNION ALL SELECT 'retype', pos, CASE WHEN o.obj IS NULL THEN 'unknown obj' WHEN NOT coalesce(kind IN ({TYPES}, 'Figure'), false) THEN 'type not allowed' END
    FROM {d.given('retypes', 'r')} LEFT JOIN {objects} ON o.obj = r.obj
    UNION ALL SELECT 'alt', pos, CASE WHEN o.obj IS NULL THEN 'unknown obj' WHEN what <> 'figure' OR trim(coalesce(alt, '')) = '' THEN 'not a figure or empty alt'
      WHEN NOT sent THEN 'its image was not sent (over --max-images), so the alt was written unseen' END
    FROM {d.given('alts', 'a')} LEFT JOIN {objects} ON o.obj = a.obj"""


def page_figure_checks(d) -> str:
    """Texts for whole-page figures: the page is listed, the text is there, the image was sent."""
    return f"""
    SELECT pos, CASE WHEN p.page IS NULL THEN 'not a page listed in page_figures' WHEN trim(coalesce(alt, '')) = '' THEN 'empty alt'
      WHEN NOT sent THEN 'its page image was not sent (over --max-images), so the alt was written unseen' END AS why
    FROM {d.given('figure_texts', 'i')} LEFT JOIN {d.given('figure_pages', 'p')} ON p.page = i.page"""


def table_checks(d) -> str:
    """Readings of tables: known, not flattened too, counts from 0 to 3, listed rows inside the table, some header, once each."""
    small = lambda c: f"coalesce({c}, 0) BETWEEN 0 AND 3"
    why = f"""CASE WHEN o.obj IS NULL OR what <> 'table' THEN 'not a table listed in the digest' WHEN flat THEN 'also flattened'
      WHEN NOT ({small("hr")} AND {small("hc")}) THEN 'header_rows and header_cols must be whole numbers 0-3' WHEN NOT ({small("tr")} AND {small("nr")}) THEN 'title_rows and note_rows must be whole numbers 0-3'
      WHEN coalesce(least_row < 0 OR most_row >= n_rows, least_row < 0, false) THEN 'group_rows and repeat_rows must list row numbers in the table' WHEN hr = 0 AND hc = 0 THEN 'no header rows or columns' END"""
    return f"""
    SELECT pos, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY obj, why IS NULL ORDER BY pos) > 1 THEN 'the same table twice' END) AS why FROM (
      SELECT t.pos, t.obj, {why} AS why FROM {d.given("table_readings", "t")} LEFT JOIN {d.given("objects", "o")} ON o.obj = t.obj)"""


def style_checks(d) -> str:
    """Merges, lists, kept lists and note styles: what they name is there."""
    known = lambda c: f"coalesce({c} IN (SELECT style FROM {d.given('styles')}), false)"
    return f"""
    SELECT 'merges' AS part, pos, CASE WHEN {known("m.style")} AND direction IN ('next', 'prev') AND (partner IS NULL OR {known("partner")}) THEN NULL ELSE 'unknown style or direction' END AS why FROM {d.given('merges', 'm')}
    UNION ALL SELECT 'lists', pos, CASE WHEN {known("l.style")} THEN NULL ELSE 'unknown style' END FROM {d.given('lists', 'l')}
    UNION ALL SELECT 'keep_lists', pos, CASE WHEN k.obj IN (SELECT obj FROM {d.given('objects')} WHERE what = 'list') THEN NULL ELSE 'not a list the one-item rule would flatten' END FROM {d.given('kept_lists', 'k')}
    UNION ALL SELECT 'notes', pos, CASE WHEN {known("n.style")} THEN NULL ELSE 'unknown styles' END FROM {d.given('note_styles', 'n')}"""


def section_checks(d) -> str:
    """Page ranges of sections, contents and adopted orphans, and the page an index starts from."""
    return f"""
    SELECT pos, part, CASE WHEN NOT {_range("low", "high")} THEN 'bad page range' END AS why FROM {d.given('ranges')}
    UNION ALL SELECT pos, 'index_from', CASE WHEN NOT coalesce(page BETWEEN 1 AND {PAGES}, false) THEN 'bad page' END FROM {d.given('index_pages')}"""


def untagged_checks(d) -> str:
    """Text rules of artifacts (a band, two pages of the book) and elements (figures of a single run)."""
    return f"""
    SELECT 'artifacts.text_rules' AS part, pos, CASE WHEN coalesce(band, 'any') NOT IN ('top', 'bottom', 'any') THEN 'band must be top, bottom or any' WHEN NOT {_range("low", "high")} THEN 'bad page range' END AS why FROM {d.given('text_rules')}
    UNION ALL SELECT 'artifacts.elements', e.pos, CASE WHEN o.obj IS NULL THEN 'unknown obj' WHEN o.what <> 'figure' THEN 'not a single-run figure listed in the digest' END
    FROM {d.given('elements', 'e')} LEFT JOIN {d.given('objects', 'o')} ON o.obj = e.obj"""
