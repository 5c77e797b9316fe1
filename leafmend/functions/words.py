"""Word functions that need Unicode normal forms or alignment: Arrow-batched pandas UDFs, null in, null out."""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: What scanning makes of letters it can't read; the same for short words; marks standing for an ʻokina.
JUNK = frozenset("il1jtfrz;:'./|_~()¢£")
SHORT_JUNK = JUNK | frozenset("0123456789@d")
OKINA_LIKE = "‘’'`"
_NO_OKINA = str.maketrans("", "", OKINA_LIKE)


def bare(text: str, form: str = "NFKD") -> str:
    """Lower case, without combining marks."""
    return "".join(filter(lambda c: not unicodedata.combining(c), unicodedata.normalize(form, text.lower())))


def letters(word: str) -> str:
    """Letters and digits in lower case without marks: what a scan and its page have in common."""
    return "".join(c for c in bare(word, "NFD").translate(_NO_OKINA) if c.isalnum())


def gap(text: str, later: str) -> int:
    """How many characters two texts differ by, in any order: one pass over each, whatever characters they have."""
    counts = Counter(text)
    counts.subtract(Counter(later))
    return sum(map(abs, counts.values()))


def edit_cost(scanned: str, reading: str) -> float:
    """Weighted edits from scanned to reading, marks aside: changing or dropping a JUNK character costs 0.25, any other edit 1.

    One row of costs at a time; insertions, 1 each, are a running minimum over cost minus position.
    """
    target = np.array([ord(c) for c in bare(reading)], np.int64)
    at = np.arange(len(target) + 1, dtype=float)
    row = at.copy()
    for c in bare(scanned):
        price = 0.25 if c in JUNK else 1.0
        step = row + price
        step[1:] = np.minimum(step[1:], row[:-1] + price * (target != ord(c)))
        row = np.minimum.accumulate(step - at) + at
    return float(row[-1])


#: Pairs of places up to which runs are looked up in a table of all of them.
TABLE = 4_000_000


def _numbered(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences as numbers, equal ones for equal items."""
    if isinstance(a, str):
        return tuple(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32) for s in (a, b))
    known: dict = {}
    return tuple(np.array([known.setdefault(x, len(known)) for x in s], np.int32) for s in (a, b))


def blocks(a, b) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the matching blocks of two sequences: the longest run, of equal ones the first in a, then in b, and so on left and right of it.

    A table holds how long a run ends at each pair of places, made row by row;
    a rectangle's longest run is then one maximum over its part of the table,
    cut to what began inside it. Long sequences go to the standard library's
    matcher, which finds the same.
    """
    if len(a) * len(b) > TABLE or not len(a) or not len(b):
        return [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    x, y = _numbered(a, b)
    kind = np.int16 if max(len(x), len(y)) < 1 << 15 else np.int32
    same = {c: (y == c).astype(kind) for c in set(x.tolist())}
    runs = np.zeros((len(x) + 1, len(y) + 1), kind)
    for i, c in enumerate(x.tolist()):
        row = runs[i + 1, 1:]
        np.add(runs[i, :-1], 1, out=row)
        row *= same[c]
    runs, steps = runs[1:, 1:], np.arange(1, max(len(x), len(y)) + 1, dtype=kind)
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        part = np.minimum(runs[i0:i1, j0:j1], steps[: i1 - i0, None])
        np.minimum(part, steps[None, : j1 - j0], out=part)
        at = int(part.argmax())
        i, j = i0 + at // (j1 - j0), j0 + at % (j1 - j0)
        n = int(part[i - i0, j - j0])
        if not n:
            continue
        i, j = i - n + 1, j - n + 1
        found.append((i, j, n))
        todo += [r for r in ((i0, i, j0, j), (i + n, i1, j + n, j1)) if r[0] < r[1] and r[2] < r[3]]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (i, j):
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def _spans(a, b):
    """(whether equal, i1, i2, j1, j2) over both sequences, in order, none empty on both sides."""
    i = j = 0
    for m, n, size in [*blocks(a, b), (len(a), len(b), 0)]:
        if i < m or j < n:
            yield False, i, m, j, n
        if size:
            yield True, m, m + size, n, n + size
        i, j = m + size, n + size


def _edits(a, b):
    return (s[1:] for s in _spans(a, b) if not s[0])


def error_rate(scanned: str, layer: str) -> float:
    """Characters to change for each scanned character, by the matcher's alignment (no least edit distance)."""
    if scanned == layer:
        return 0.0
    return sum(max(i2 - i1, j2 - j1) for i1, i2, j1, j2 in _edits(scanned, layer)) / max(1, len(scanned))


def refusal(scanned: str, reading: str) -> str | None:
    """Why reading may not stand for scanned: 'not one word', 'same', 'too different'; None where it may.

    Marks may always differ. Words of four letters or more may differ by a third of the reading, two at
    least; in shorter ones only junk may go or change, and nothing may be added.
    """
    if not reading or len(reading.split()) != 1 or reading != reading.strip():
        return "not one word"
    if reading == scanned:
        return "same"
    if letters(reading) == letters(scanned):
        return None
    a, b = scanned.translate(_NO_OKINA), reading.translate(_NO_OKINA)
    x, y = bare(a), bare(b)
    if min(len(x), len(y)) >= 4:
        fine = edit_cost(a, b) <= max(2, 0.34 * len(y))
    else:
        fine = len(y) <= len(x) and all(i1 < i2 and SHORT_JUNK.issuperset(x[i1:i2]) for i1, i2, _, _ in _edits(x, y))
    return None if fine else "too different"


def paired(scanned: list[str], reading: list[str]) -> dict:
    """Words paired one to one by alignment of their letters: how many pair, change, differ too much and stay alone; changes by place."""
    out = {"paired": 0, "changed": 0, "too_different": 0, "unpaired": 0, "changes": []}
    for equal, i1, i2, j1, j2 in _spans([letters(w) for w in scanned], [letters(w) for w in reading]):
        if not equal and i2 - i1 != j2 - j1:
            out["unpaired"] += i2 - i1
            continue
        out["paired"] += i2 - i1
        for place, new in zip(range(i1, i2), reading[j1:j2], strict=True):
            new = unicodedata.normalize("NFC", new)
            why = refusal(scanned[place], new)
            if why is None:
                out["changed"] += 1
                out["changes"].append({"place": place, "word": new})
            out["too_different"] += why == "too different"
    return out


def _each(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def _pairs(f, kind):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def skeleton(c):
    return F.pandas_udf(_each(bare), "string")(c)


def nfc(c):
    return F.pandas_udf(_each(lambda t: unicodedata.normalize("NFC", t)), "string")(c)


def loose(c):
    return F.pandas_udf(_each(letters), "string")(c)


def same_form(a, b):
    """Equality but for white space and case."""
    fold = lambda t: "".join(unicodedata.normalize("NFC", t).split()).casefold()
    return _pairs(lambda x, y: fold(x) == fold(y), "boolean")(a, b)


def weighted_distance(scanned, reading):
    return _pairs(edit_cost, "double")(scanned, reading)


def character_error_rate(scanned, layer):
    return _pairs(error_rate, "double")(scanned, layer)


def reading_refusal(scanned, reading):
    return _pairs(refusal, "string")(scanned, reading)


def aligned(scanned, reading):
    """A struct of paired(): both columns are arrays of words."""
    kind = "struct<paired:long, changed:long, too_different:long, unpaired:long, changes:array<struct<place:int, word:string>>>"

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [paired(list(x if x is not None else []), list(y if y is not None else [])) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=["paired", "changed", "too_different", "unpaired", "changes"])

    return run(scanned, reading)


def bag_gap(a, b):
    """gap() of two columns; null where either is."""
    return _pairs(gap, "long")(a, b)
