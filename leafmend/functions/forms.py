"""Forms of words, labels, tags and dates: native column expressions, null in, null or false out as stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of suspect words, addresses, roman numerals, list markers and dates.
SUSPECT = r"(?<=[A-Za-z])ii|ii(?=[a-z])|[A-Za-z][;:¢£·|][A-Za-z¢£]|[¢£]"
ADDRESS = r"(?iu)@|://|www\.|\.(?:com|org|net|edu|gov)(?![\p{L}\p{N}_])"
ROMAN = r"^[ivxlcdm]+$"
MARKER = (
    r"^(?:[•◦▪▫‣⁃●○■□◆◇►▶➢✓✔∙·*–—-]|\(?(?:\d{1,3}|[A-Za-z]|[ivxlcdm]{1,6}|[IVXLCDM]{1,6})[.)]"
    r"|\((?:\d{1,3}|[A-Za-z]|[ivxlcdm]{1,6}|[IVXLCDM]{1,6})\))$"
)
ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2})?$"
OKINAS = "ʻ‘’'`"


def core(c: Column) -> Column:
    """The word without what is no word character around it."""
    return F.regexp_replace(c, r"(?U)^\W+|\W+$", "")


def hawaiian_shape(c: Column) -> Column:
    """Two letters or more, all of the Hawaiian alphabet, a vowel last; ʻokinas aside. Macrons may be composed or not."""
    low = F.translate(F.lower(c), OKINAS, "")
    for plain, long in zip("aeiou", "āēīōū", strict=True):
        low = F.regexp_replace(low, plain + "̄", long)
    return F.coalesce(low.rlike("^[aeiouāēīōūhklmnpw]+[aeiouāēīōū]$"), F.lit(False))


def suspect(c: Column) -> Column:
    """Whether a scan likely misread the word; roman numerals and addresses aren't suspect, null and empty neither."""
    misread = c.rlike(SUSPECT) | (hawaiian_shape(c) & c.rlike("[‘’'`]"))
    return F.coalesce(misread & ~F.lower(c).rlike(ROMAN) & ~c.rlike(ADDRESS), F.lit(False))


def list_marker(label: Column) -> Column:
    """Whether a label, white space aside, is a list's marker."""
    return F.coalesce(F.regexp_replace(label, r"(?U)\s+", "").rlike(MARKER), F.lit(False))


def false_list(items: Column, parts: Column, label: Column) -> Column:
    """A list of one item, a label with a body, whose label is some text but no marker."""
    pair = F.array_sort(parts) == F.array(F.lit("LBody"), F.lit("Lbl"))
    return F.coalesce((items == 1) & pair & (F.trim(label) != "") & ~list_marker(label), F.lit(False))


def iso(c: Column) -> Column:
    """struct(year, month, day, hour, minute), or null; days up to 31 pass in any month, zones are ignored."""
    text = F.trim(c)
    part = lambda i: F.nullif(F.regexp_extract(text, ISO, i), F.lit("")).cast("int")
    y, mo, d, h, mi = (part(i) for i in range(1, 6))
    fits = text.rlike(ISO) & mo.between(1, 12) & d.between(1, 31) & F.coalesce((h <= 23) & (mi <= 59), F.lit(True))
    return F.when(fits, F.struct(y.alias("year"), mo.alias("month"), d.alias("day"), h.alias("hour"), mi.alias("minute")))


def primary(tag: Column) -> Column:
    return F.lower(F.split_part(F.coalesce(tag, F.lit("")), F.lit("-"), F.lit(1)))


def verdict(lang: Column, confidence: Column, why: Column, answered: Column, accept: Column) -> Column:
    """missing, unsure, untagged, right, script (the language in another script) or wrong, against accepted tags.

    The first accepted tag of the same language decides between right and script; zh and yue are one where both are accepted.
    """
    latin = lambda t: F.coalesce(F.contains(t, F.lit("-Latn")), F.lit(False))
    low = F.coalesce(confidence == "low", F.lit(False))
    both = F.array_contains(accept, "zh") & F.array_contains(accept, "yue")
    pair = lambda t: primary(t).isin("zh", "yue")
    hit = F.filter(accept, lambda a: (primary(a) == primary(lang)) | (both & pair(a) & pair(lang)))
    unsure = low | F.coalesce(why.isin("unsure", "varies"), F.lit(False))
    return (
        F.when(~answered, "missing").when(lang.isNull() | low, F.when(unsure, "unsure").otherwise("untagged"))
        .when(F.size(hit) == 0, "wrong").when(latin(F.try_element_at(hit, F.lit(1))) == latin(lang), "right").otherwise("script")
    )
