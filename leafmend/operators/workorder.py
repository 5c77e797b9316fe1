"""Checks of a work order's decisions against what its book holds: each row comes back with why, null where it is kept.

Items and what they name are DataFrames; membership is a left join on
distinct keys, so the planner may broadcast or sort as sizes ask. Null
keys are unknown. Repeated items are judged one by one but for page readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words
from .groups import by_group
from .validate import first_reason

#: The types that a decision may set.
ALLOWED = ("H1", "H2", "H3", "H4", "H5", "H6", "P", "Span", "Caption", "Note", "Div", "Figure")


def _marked(items: DataFrame, key: str, known: DataFrame, flag: str) -> DataFrame:
    """items with flag: whether known (its first column) holds their key."""
    dim = known.select(F.col(known.columns[0]).alias("_k")).distinct().withColumn(flag, F.lit(True))
    return items.join(dim, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"(?U)\s+", "") == "", F.lit(True))


def _allowed(c: Column, kinds) -> Column:
    return F.coalesce(c.isin(*kinds), F.lit(False))


def rolemap(items: DataFrame, styles: DataFrame) -> DataFrame:
    """(style, target): the style exists, the target is an allowed type other than Figure."""
    row = _marked(items, "style", styles, "_known")
    why = first_reason([(~F.col("_known"), "unknown style"), (~_allowed(F.col("target"), [t for t in ALLOWED if t != "Figure"]), "target not allowed")])
    return row.select(*items.columns, why.alias("why"))


def retypes(items: DataFrame, objects: DataFrame) -> DataFrame:
    """(obj, type): the object exists, the type is allowed."""
    row = _marked(items, "obj", objects, "_known")
    return row.select(*items.columns, first_reason([(~F.col("_known"), "unknown obj"), (~_allowed(F.col("type"), ALLOWED), "type not allowed")]).alias("why"))


def alts(items: DataFrame, objects: DataFrame, figures: DataFrame, not_sent: DataFrame) -> DataFrame:
    """(obj, alt): an object, a figure with some text for it, whose image the model has seen."""
    row = _marked(_marked(_marked(items, "obj", objects, "_known"), "obj", figures, "_figure"), "obj", not_sent, "_unseen")
    rules = [
        (~F.col("_known"), "unknown obj"), (~F.col("_figure") | _blank(F.col("alt")), "not a figure or empty alt"),
        (F.col("_unseen"), "its image was not sent (over --max-images), so the alt was written unseen"),
    ]
    return row.select(*items.columns, first_reason(rules).alias("why"))


def word_readings(items: DataFrame, scanned: DataFrame, sent: DataFrame) -> DataFrame:
    """(id, reads) with the word as scanned (text): the id is known and was sent; the reading is one other word of at most 80 characters, near enough.

    scanned: id, text, one row of an id. The distance is weighed in an Arrow UDF, for rows that pass all else.
    """
    row = _marked(items, "id", sent, "_sent").join(scanned.select(F.col("id").alias("_id"), F.col("text").alias("_text")), F.col("id") == F.col("_id"), "left")
    row = row.withColumn("_r", words.nfc(F.regexp_replace("reads", r"(?U)^\s+|\s+$", "")))
    plain = first_reason([
        (F.col("_id").isNull(), "unknown id"), (~F.col("_sent"), "its word sheet was not sent"), (_blank(F.col("_r")), "empty"),
        (F.col("_r").rlike(r"(?U)\s") | (F.length("_r") > 80), "not one word"), (F.col("_r") == F.col("_text"), "same as the OCR text"),
    ])
    row = row.withColumn("_why", plain)
    sound = lambda c: F.when(F.col("_why").isNull(), F.col(c))
    far = words.weighted_distance(sound("_text"), sound("_r")) > F.greatest(F.lit(2.0), 0.34 * F.length(words.skeleton(sound("_r"))))
    why = F.coalesce("_why", F.when(far, "too different from the OCR text to be a misreading of it"))
    return row.select(*items.columns, F.col("_text").alias("text"), why.alias("why"))


def page_readings(items: DataFrame, pages: int) -> DataFrame:
    """(pos, page, text): the page exists, the text isn't blank, and it is the first such of its page."""
    why = first_reason([(~F.coalesce(F.col("page").between(1, pages), F.lit(False)), "bad page"), (_blank(F.col("text")), "empty")])
    row = items.withColumn("_why", why)
    n = F.row_number().over(Window.partitionBy("page", F.col("_why").isNull()).orderBy("pos"))
    return row.withColumn("_n", n).select(*items.columns, F.coalesce("_why", F.when(F.col("_n") > 1, "the same page twice")).alias("why"))


def deferral_pages(items: DataFrame, pages: int) -> DataFrame:
    """items with pages cut to those of the book (null where none is left) and why, where any was cut; the deferral itself stays."""
    fits = lambda p: F.coalesce(p.between(1, pages), F.lit(False))
    good = F.filter("pages", fits)
    cut = F.coalesce(F.size(good) < F.size("pages"), F.lit(False))
    rest = [c for c in items.columns if c != "pages"]
    return items.select(*rest, F.when(F.size(good) > 0, good).alias("pages"), F.when(cut, "not PDF page numbers in range").alias("why"))


#: The reasons against a section's move.
MOVES = (
    "bad pages", "the audit finds no section read out of place in these pages or where it lands", "more than 3 section moves",
    "its pages overlap another section move", "it lands inside the pages of another section move",
)
MOST_MOVES = 3


def section_moves(moves: DataFrame, misread: DataFrame, pages: int) -> DataFrame:
    """moves (book, pos, low, high, goal) with why: the first reason against each, null where it is kept.

    misread (book, page): where a section read out of place starts. Moves of a
    book are judged in order of pos, each on those kept before it, at most
    MOST_MOVES; a move with a null page has bad pages.
    """

    def judged(low: list, high: list, goal: list, bad: list) -> list[list[str | None]]:
        kept, out = [], []
        for a, b, g, starts in zip(low, high, goal, bad, strict=True):
            faults = (
                any(x is None or not 1 <= x <= pages for x in (a, b, g)),
                lambda a=a, b=b, g=g, starts=starts: not any(a <= f <= b or f == g for f in starts or ()),
                lambda: len(kept) == MOST_MOVES,
                lambda a=a, b=b: any(a <= h and l <= b for l, h, _ in kept),
                lambda a=a, b=b, g=g: any(l <= g <= h or a <= k <= b for l, h, k in kept),
            )
            out.append(next((why for fault, why in zip(faults, MOVES, strict=True) if (fault() if callable(fault) else fault)), None))
            if out[-1] is None:
                kept.append((a, b, g))
        return [out]

    starts = misread.groupBy("book").agg(F.collect_set("page").alias("_starts"))
    rows = moves.join(starts, "book", "left").select(*moves.columns, "_starts")
    return by_group(rows, ["book"], ["pos"], ["low", "high", "goal", "_starts"], judged, "why string").drop("_starts")
