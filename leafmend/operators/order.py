"""Reading order: which entries under one parent stand away from their printed place.

Entries: book, pos (their order), parent, first and last page, and any other
columns. Groups are the children of one parent of one book.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import by_group

LATE_PAGES = 5


def backbone(first: list[int], weight: list[int]) -> set[int]:
    """Places of the heaviest run whose first pages never go back; ties go to the earliest.

    frontier holds the first pages at which a heavier run ends, pages and weights rising, so the best run to
    extend is found by bisection; of equal weights the earlier entry stays at the greater page.
    """
    frontier, holder, total, before = [], [], [], []
    for i, (page, w) in enumerate(zip(first, weight, strict=True)):
        at = bisect_right(frontier, page)
        before.append(holder[at - 1] if at else None)
        total.append(w + (total[holder[at - 1]] if at else 0))
        if at and total[holder[at - 1]] >= total[i]:
            continue
        low = high = bisect_left(frontier, page)
        while high < len(frontier) and total[holder[high]] < total[i]:
            high += 1
        frontier[low:high], holder[low:high] = [page], [i]
    kept, i = set(), min(range(len(total)), key=lambda k: (-total[k], k), default=None)
    while i is not None:
        kept.add(i)
        i = before[i]
    return kept


def in_order(entries: DataFrame) -> DataFrame:
    """(book, parent, pos, first, last, in_order) of the entries that have pages and aren't skipped."""

    def flag(first: list[int], last: list[int]) -> list[list[bool]]:
        kept = backbone(first, [b - a + 1 for a, b in zip(first, last, strict=True)])
        return [[i in kept for i in range(len(first))]]

    used = entries.where("first is not null" + (" and not coalesce(skip, false)" if "skip" in entries.columns else ""))
    used = used.select("book", "parent", *(F.col(c).cast("long") for c in ("pos", "first", "last")))
    return by_group(used, ["book", "parent"], ["pos"], ["first", "last"], flag, "in_order boolean")


def out_of_order(entries: DataFrame) -> DataFrame:
    """The entries outside the backbone, with the last page of the one in order before (prev) and the first of the one after (next)."""
    w = Window.partitionBy("book", "parent").orderBy("pos")
    kept = lambda c: F.when(F.col("in_order"), F.col(c))
    out = in_order(entries).withColumn("prev", F.last(kept("last"), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("next", F.first(kept("first"), True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return out.where("not in_order").drop("in_order")


def read_late(entries: DataFrame, small: int = 2, pages: int = LATE_PAGES) -> DataFrame:
    """Small entries in order that are read over so many pages after their own, and the furthest page read before (after)."""
    w = Window.partitionBy("book", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = in_order(entries).withColumn("after", F.max("last").over(w))
    return out.where((F.col("in_order")) & (F.col("last") - F.col("first") < small) & (F.col("after") - F.col("first") > pages)).drop("in_order")
