"""Secret scans: base patterns, and guess costs of values in credential context.

A value that follows a credential word (of four languages) or stands before the
@ of an address is cut into dictionary words, dates, repeats, sequences,
keyboard walks and brute-force characters so that the guesses needed are fewest
(dynamic programming over the value's positions). A value that takes at least
GUESSES guesses is a secret; placeholders and prose take few. The dictionary is
fixed: a short list of frequent passwords and, behind it, the whole words of
two public tokenizers' vocabularies in their order, which is nearly that of
frequency. So a text's secrets don't depend on any other text: a leaked value
that is copied, however often, never becomes a word.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Words that announce a credential, in English, German, French and Spanish, and how its value is written after them.
_KEYWORDS = (
    r"password|passphrase|passwd|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|login|pin"
    r"|passwort|kennwort|zugangscode|zugangsdaten|(?:api|zugriffs|geheim)?-?schl(?:[üÜ]|ue)ssel"
    r"|mot[\x20_-]de[\x20_-]passe|cl[eéÉ][\x20_-](?:api|secr[eèÈ]te|priv[eéÉ]e|d['’]acc[eèÈ]s)|jeton|identifiants?"
    r"|contrase[nñÑ]a|clave(?:[\x20_-](?:api|secreta|privada|de[\x20_-]acceso))?|credenciales"
)
#: What every credential word begins with, in lower case.
_STEMS = ("pass", "pwd", "secret", "token", "api", "access", "private", "auth", "credential", "login", "pin", "kennwort", "zugangs", "zugriffs", "geheim", "schl", "mot", "cle", "clé", "jeton", "identifiant", "contrase", "clave", "credenciales")
_CONTEXT = re.compile(
    rf"""(?ai)(?<![a-z])(?:{_KEYWORDS})["']?(?:[\x20\t]*(?:[:=]|=>|->)[\x20\t]*|(?P<verb>[\x20\t]+(?:is|ist|lautet|est|es)[\x20\t]+))(?:"(?P<double>[^"\n]+)"|'(?P<single>[^'\n]+)'|(?P<bare>[^\s"',;<>]+))"""
)
#: The rest of a line after a bare value, where it is further words: a passphrase, if none is a frequent word.
_PHRASE = re.compile(r"[^\W\d_]{3,}(?:[\x20-][^\W\d_]{3,}){2,}(?=[\x20\t]*$)", re.M)
_ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://", re.I)
#: The password of an address: scheme://user:password@host.
_USERINFO = re.compile(r"(?ai)[a-z][a-z0-9+.-]*://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
#: Decimal exponent of the guesses from which a value is a secret.
GUESSES = 10.0
#: Letters of the dictionary's words; its first words, which no passphrase has.
LETTERS, FREQUENT = (3, 20), 1700
#: Frequent passwords and words of placeholders, most frequent first.
COMMON = """password 123456 12345678 qwerty admin letmein welcome monkey dragon master login abc123 iloveyou
sunshine princess football baseball shadow michael superman batman trustno1 hello freedom whatever secret token
pass test user root guest default changeme example sample demo value your none null true false undefined here
key api my the and for with this that enter insert replace placeholder redacted hidden removed xxxx todo
string name email server client access public private data file""".split()
#: Rows of a keyboard, left to right.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
_LEET = str.maketrans("@430157$!", "aaeoistsi")
_NEXT = {a + b for r in ROWS for s in (r, r[::-1]) for a, b in zip(s, s[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")


def _words(v: str, low: str, plain: str, i: int, longest: int, words: dict[str, int]) -> Iterator[tuple[int, float]]:
    """(end, log10 guesses) of the dictionary words that start at i."""
    for j in range(i + 3, min(len(v), i + longest) + 1):
        for form, extra in ((low, 0.0), (plain, 0.5)):
            if rank := words.get(form[i:j]):
                yield j, math.log10(rank + 1) + extra + (0.3 if v[i:j] != low[i:j] else 0.0)
                break


def _spans(v: str, low: str) -> Iterator[list[tuple[int, float]]]:
    """For each start in turn the (end, log10 guesses) of the other patterns; nothing is looked at before it is asked for."""
    n = len(v)
    dates = _DATE.finditer(v)
    date = next(dates, None)
    pieces = dict.fromkeys(range(2, min(16, n // 2) + 1), 0)  # length of a piece: where it is looked for next
    same = steps = row = 0  # the same for one character, steps of one; the end of the last run on a keyboard row
    for i in range(n):
        out = []
        if date and date.start() == i:
            out.append((date.end(), math.log10(120 if date.end() - i == 4 else 36_500)))
            date = next(dates, None)
        if i == same:  # one character again and again
            j = i + 1
            while j < n and v[j] == v[i]:
                j += 1
            if j - i >= 3:
                out.append((j, math.log10(12 * (j - i))))
            same = j
        for k, at in pieces.items():  # a longer piece again and again
            if i == at and i + 2 * k <= n:
                j = i + k
                while j < n and v[j] == v[j - k]:
                    j += 1
                if j - i >= 2 * k:
                    out.append((j, math.log10(j - i) + _brute(v[i : i + k])))
                    pieces[k] = j
                else:
                    pieces[k] = i + 1
        if i == steps and i < n - 1:  # steps of one along the alphabet, the digits or a keyboard row
            j = i + 1
            step = ord(low[j]) - ord(low[i])
            while j < n and abs(step) == 1 and ord(low[j]) - ord(low[j - 1]) == step and low[j].isalnum():
                j += 1
            if j - i >= 3:
                out.append((j, math.log10(26 * (j - i))))
            if row <= i:
                row = i + 1
                while row < n and low[row - 1 : row + 1] in _NEXT:
                    row += 1
            if row - i >= 3:
                out.append((row, math.log10(94 * (row - i) * 2)))
            steps = max(i + 1, (j if j - i >= 3 else i + 1) - 1)
        yield out


def _one(v: str, i: int) -> float:
    """log10 of the characters to try at a place: fewer for a letter that goes on a run of its case, as in words."""
    c = v[i]
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return 0.9 if i and v[i - 1].isalpha() and v[i - 1].isupper() == c.isupper() else math.log10(26)
    return math.log10(33)


def _brute(piece: str) -> float:
    return sum(_one(piece, i) for i in range(len(piece)))


_LENGTHS: dict[int, tuple[dict[str, int], int]] = {}


def _longest(words: dict[str, int]) -> int:
    """Letters of a dictionary's longest word, found once for each dictionary."""
    known = _LENGTHS.get(id(words))
    if known is None or known[0] is not words:
        _LENGTHS.clear()
        known = _LENGTHS[id(words)] = (words, max(map(len, words), default=0))
    return known[1]


def guess_cost(value: str, words: dict[str, int] | None = None, most: float = math.inf) -> float:
    """The least log10 of guesses over all segmentations of value; infinite where it is most or more.

    Best cost to each position by the pattern or single character that ends
    there; each pattern adds a factor for the order of parts. Empty: 0. Costs
    only grow along a segmentation, so positions that take most or more are
    left, and a value is read no further than the last position still open:
    values of any length are costed whole.
    """
    words = words if words is not None else dictionary()
    n, low, longest = len(value), value.lower(), _longest(words)
    plain = low.translate(_LEET)
    open_ = {0: 0.0}
    for i, spans in enumerate(_spans(value, low)):
        if not open_:
            return math.inf
        cost = open_.pop(i, None)
        if cost is None:
            continue
        order = math.log10(2) if i else 0.0
        reached = [(i + 1, cost + _one(value, i)), *((j, cost + c + order) for j, c in (*spans, *_words(value, low, plain, i, longest, words)))]
        for j, c in reached:
            if c < most and c < open_.get(j, math.inf):
                open_[j] = c
    return open_.get(n, math.inf)


def vocabularies() -> tuple[str, str]:
    """Where the two vocabularies lie: words of English, pieces of many languages."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(1)
def dictionary(paths: tuple[str, str] | None = None) -> dict[str, int]:
    """Word to rank: COMMON first, then the whole words of both vocabularies, each by its better rank in either, ties by spelling.

    A whole word is a token that ends a word in the first and one behind a
    blank in the second, of LETTERS letters, folded to lower case.
    """
    words_path, pieces_path = paths or vocabularies()
    ranks: dict[str, int] = {}
    with open(words_path, encoding="utf-8") as f:
        found = [(w.removesuffix("</w>"), i) for w, i in json.load(f)["model"]["vocab"].items() if w.endswith("</w>")]
    with open(pieces_path, "rb") as f:
        found += [(base64.b64decode(t)[1:].decode("utf-8", "replace"), int(i)) for t, i in map(bytes.split, f) if base64.b64decode(t)[:1] == b" "]
    for word, i in found:
        word = word.lower()
        if word.isalpha() and LETTERS[0] <= len(word) <= LETTERS[1]:
            ranks[word] = min(i, ranks.get(word, i))
    ordered = sorted(ranks, key=lambda w: (ranks[w], w))
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *ordered]))}


def _gaps(start: int, end: int, spans: list[tuple[int, int, str]], reach: list[int]) -> Iterator[tuple[int, int]]:
    """What spans, sorted by start, leave of a value; reach: the furthest end of each and those before it."""
    for i in range(bisect_right(reach, start), len(spans)):  # from the first that ends after start
        s, e, _ = spans[i]
        if s >= end:
            break
        if s > start:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def _contexts(text: str) -> Iterator[re.Match]:
    """All matches of _CONTEXT, left to right without overlaps, looked for only where a credential word may begin."""
    low = text.lower()
    if len(low) != len(text):  # some letters' lower case is longer
        yield from _CONTEXT.finditer(text)
        return
    places, end = set(), 0
    for stem in _STEMS:
        i = low.find(stem)
        while i >= 0:
            places.add(i)
            i = low.find(stem, i + 1)
    for i in sorted(places):
        if i >= end and (m := _CONTEXT.match(text, i)):
            end = m.end()
            yield m


def _values(text: str, words: dict[str, int]) -> Iterator[tuple[int, int]]:
    """(start, end) of what stands where a credential would: after a credential word, or before the @ of an address.

    A bare value after a verb ("the password is ...") is one only if it isn't
    letters alone, as prose is; of an address only the password is one. A bare
    value goes on to the end of its line where that is three words or more of
    which none is among the FREQUENT first of the dictionary.
    """
    if "://" in text:
        yield from (m.span(1) for m in _USERINFO.finditer(text))
    for m in _contexts(text):
        kind = m.lastgroup
        start, end = m.span(kind)
        if _ADDRESS.match(m[kind]) or m["verb"] and kind == "bare" and m[kind].rstrip(".!?:)").isalpha():
            continue
        phrase = _PHRASE.match(text, start) if kind == "bare" else None
        if phrase and all(words.get(w.lower(), FREQUENT + 1) > FREQUENT for w in re.split(r"[\x20-]", phrase[0])):
            end = phrase.end()
        yield start, end


def find(text: str | None, guesses: float = GUESSES, words: dict[str, int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in a text, by start, then by the order of KINDS."""
    text = text or ""
    words = words if words is not None else dictionary()
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    base = sorted(found)
    reach = list(accumulate((e for _, e, _ in base), max))
    guessed = {(s, e) for start, end in _values(text, words) for s, e in _gaps(start, end, base, reach) if guess_cost(text[s:e], words, guesses) >= guesses}
    return sorted([*found, *((s, e, "guess") for s, e in guessed)], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """text with overlapping spans merged and each replaced by mask."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, guesses: float = GUESSES, mask: str = "[SECRET]", words: dict[str, int] | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and clean_text added, row by row.

    docs: text and any others (columns of those names are replaced). A null
    text has no secrets and stays null in clean_text; an empty table gives no
    rows; doc_id, null or repeated, plays no part. The base matches are as the
    contract has them; the guess spans never overlap one. Texts are scanned
    whole, one at a time. words: the dictionary, by default that of the
    vocabularies; nothing is gathered from docs, so a row's secrets are its own.
    """
    own = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"]
    base = docs.drop(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            rows = []
            for x in b.column(at):
                text = x.as_py()
                spans = find(text, guesses, words)
                first = [s for s in spans if s[2] != "guess"]
                n = [sum(s[2] == k for s in spans) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_joined(first).encode()).hexdigest(), _joined(spans), redact(text, spans, mask) if spans else text))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            more = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *own])

    types = [T.LongType()] * 3 + [T.StringType()] * 3
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *(T.StructField(n, t) for n, t in zip(own, types, strict=True))]))


def digest(docs: DataFrame) -> DataFrame:
    """scanned() without the texts."""
    return scanned(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).drop("text", "clean_text")
