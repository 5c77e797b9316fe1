"""Names of downloads, and lines and states that tell a person how far a run has come."""

from __future__ import annotations

from .text import SPACES

#: Bytes of a name, signs that no file name may have, words of states.
BYTES, RESERVED = 150, r"[<>:\x22/\\|?*;]"
STATES = {"Not Ready": "not-ready", "Pending Evaluation": "not-ready", "Ready": "not-shipped", "earlier version": "previous-version"}
#: Why a step was left out or didn't finish, in words.
LEFT_OUT = {
    ("cap", "language"): "The language suggestions were left out because they could cost more than the limit for language suggestions.", ("cap", "pages"): "The page readings were left out because they could cost more than the limit for page readings.",
    ("book", "language"): "The language suggestions were left out because they could cost more than this PDF''s limit.", ("book", "pages"): "The page readings were left out because they could cost more than this PDF''s limit.",
}
OPEN = {
    "credit": "There was not enough AI credit.", "lookup": "The AI service could not be reached to look up the model.", "error": "The step stopped with an error.", "started": "The step did not run to the end.",
    "pages_changed": "New page readings changed some words.", "forms_changed": "More word forms were found after the estimate.",
}
#: Why the language step decided nothing.
NOT_DONE = {"off": "the language step was turned off", "left_out_book": "the language step was left out: over the limit per PDF", "left_out_cap": "the language step was left out: over its own limit", "failed": "the language step did not finish", "not_run": "the language step was not run"}


def _cases(x: str, words: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items())


def download_names(d) -> str:
    """File names of a version's PDF and record: the base safe for any computer, at most BYTES long, then its session and state."""
    ends = lambda x: d.replaced(d.replaced(x, r"^[ .]+", ""), r"[ .]+$", "")
    plain = d.replaced(ends("coalesce(output, '')"), r"(?i)[.]pdf$", "")
    plain = ends(d.replaced(d.replaced(plain, r"\p{C}", ""), RESERVED, "_"))
    number = lambda x: f"coalesce({d.matches(x, '^[0-9]+$')}, false)"
    ship = f"CASE WHEN {number('shipment')} THEN CAST(CAST(CASE WHEN {number('shipment')} THEN shipment END AS INT) AS STRING) END"
    session = f"CASE WHEN {number('session')} THEN concat('session-', CAST(CAST(CASE WHEN {number('session')} THEN session END AS INT) AS STRING)) ELSE 'no-review' END"
    tail = f"concat({session}, '_', coalesce({_cases('state', STATES)} END, 'not-ready'))"
    return f"""
    SELECT id, CASE WHEN state = 'withdrawn' THEN concat(base, '_shipment-', ship, '_withdrawn.pdf') WHEN state = 'Shipped' THEN concat(base, '.pdf') ELSE concat(base, '_', tail, '.pdf') END AS pdf,
      CASE WHEN state = 'withdrawn' THEN concat(base, '_record_shipment-', ship, '_withdrawn.zip') WHEN state = 'Shipped' THEN concat(base, '_record', CASE WHEN ship IS NULL THEN '' ELSE concat('_shipment-', ship) END, '.zip') ELSE concat(base, '_record_', tail, '.zip') END AS zip
    FROM (SELECT id, state, {ship} AS ship, {tail} AS tail, CASE WHEN cut = '' THEN 'book' ELSE cut END AS base FROM (
      SELECT *, {ends(d.first_bytes("clean", BYTES))} AS cut FROM (SELECT id, session, state, shipment, {plain} AS clean FROM {d.given("downloads")})))"""


def language_lines(d) -> str:
    """Whether a book's language tags are dealt with, and the line that says so: not applicable, not done and why, approved, or what is left to review.

    Tags count as approved only where a person decided every form; forms that
    the limits held back are told as long as nobody has accepted them.
    """
    forms = lambda n: f"concat({d.thousands(n)}, ' word form', CASE WHEN {n} = 1 THEN '' ELSE 's' END)"
    held = "CASE held_why WHEN 'forms' THEN 'more than the set number of word forms' WHEN 'book' THEN 'more than the room left in this PDF''s limit' ELSE 'more than the limit for language suggestions' END"
    left = "coalesce(not_reviewed, todo)"
    return f"""
    SELECT book, coalesce(line LIKE 'Approved%' OR line = 'Not Applicable', false) AS ok, line FROM (
      SELECT book, CASE WHEN todo = 0 AND NOT any_forms AND state NOT IN ('decided', 'held_back') AND candidates IS NULL THEN 'Not Done (not checked)'
        WHEN todo = 0 AND NOT any_forms AND state NOT IN ('decided', 'held_back') AND candidates > 0 THEN concat('Not Done (', coalesce({_cases("state", NOT_DONE)} END, '{NOT_DONE["not_run"]}'), ')')
        WHEN todo = 0 AND reviewer IS NULL AND held IS NULL THEN 'Not Applicable'
        WHEN held_open AND (coalesce(not_reviewed = 0, false) OR todo = 0) THEN concat('Not Reviewed (', {d.thousands("held")}, ' word form', CASE WHEN held = 1 THEN ' was' ELSE 's were' END, ' not sent: ', {held}, ')')
        WHEN reviewer IS NOT NULL AND not_reviewed = 0 THEN concat('Approved (', reviewer, ' on ', day, CASE WHEN held IS NULL THEN '' ELSE concat(' · ', {forms("held")}, ' not sent, accepted by ', accepted_by) END, ')')
        WHEN held_open THEN concat('Not Reviewed (', {forms(left)}, ' to decide on the review page; ', {d.thousands("held")}, ' not sent: ', {held}, ')')
        WHEN none_tagged THEN concat('Not Reviewed (', {forms(left)}, ' the AI left untagged to confirm on the review page)') ELSE concat('Not Reviewed (', {forms(left)}, ' to decide on the review page)') END AS line
      FROM (SELECT *, held IS NOT NULL AND NOT coalesce(accepted_by IS NOT NULL AND accepted_count = held, false) AS held_open FROM {d.given("tagging")}))"""


def step_states(d) -> str:
    """Which of a run's optional steps are left out or unfinished, how much is left, whether it can be sent again, and why in words; and whether that holds the run."""
    cap = " ".join(f"WHEN why = '{w}' AND step = '{s}' THEN '{words}'" for (w, s), words in LEFT_OUT.items())
    return f"""
    WITH judged AS (SELECT run, step, why, override, CASE WHEN why IN ('cap', 'book') THEN 'left_out' WHEN why IN ('credit', 'started', 'error', 'lookup') OR step = 'language' AND why IN ('pages_changed', 'forms_changed') THEN 'unfinished'
        WHEN (why IN ('done', 'saved') OR why IS NULL AND ran) AND unfinished > 0 THEN 'unfinished' WHEN why IS NULL AND NOT ran AND marked AND to_send > 0 THEN 'unfinished' END AS state,
        CASE WHEN why IN ('cap', 'book') THEN CASE WHEN step = 'pages' THEN listed ELSE 0 END WHEN why IN ('credit', 'started', 'error', 'lookup') THEN CASE WHEN unfinished > 0 THEN unfinished ELSE to_send END
          WHEN why IN ('pages_changed', 'forms_changed') THEN to_send WHEN why IS NULL AND NOT ran THEN to_send ELSE unfinished END AS left_over FROM {d.given("steps")})
    SELECT run, step, state, coalesce(why, 'done') AS why, CAST(left_over AS BIGINT) AS left_over, state = 'unfinished' AS retry, coalesce(CASE {cap} ELSE {_cases("why", OPEN)} END END, '') AS words, NOT override AS held
    FROM judged WHERE state IS NOT NULL"""


def deferred_issues(d) -> str:
    """What was deferred, one line for each kind of a book: how many, on which pages, and the line's words."""
    flat = f"trim({d.replaced('what', f'[{SPACES}]+', ' ')})"
    return f"""
    SELECT book, what, count(*) AS n, count(DISTINCT page) AS pages, min(page) AS first_page,
      CASE WHEN what = 'caption' THEN concat(CAST(count(*) AS STRING), ' captions not grouped: several figures on the page') WHEN count(*) = 1 THEN what ELSE concat(what, ' (', CAST(count(*) AS STRING), ')') END AS words
    FROM (SELECT book, coalesce(nullif({flat}, ''), 'not described') AS what, page FROM {d.given("deferred", "t")} WHERE scope <> 'pdfua') GROUP BY book, what"""
