"""Decisions kept or dropped, each with the first reason against it."""

from __future__ import annotations

from bisect import bisect_right
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import by_group


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule that holds; null where none does. A rule that is null doesn't hold."""
    return F.coalesce(*(F.when(broken, reason) for broken, reason in rules))


def apart(rows: DataFrame, keys: list[str], order: str, first: str, last: str, competes: Column) -> DataFrame:
    """rows with overlaps: whether a row meets an earlier one that was kept, among those of its keys that compete.

    Greedy in order, so a dropped row blocks no other. Kept intervals don't
    overlap, so each is compared with its two neighbours only.
    """

    def mark(lows: list, highs: list, compete: list[bool]) -> list[list[bool]]:
        starts, ends, met = [], [], []
        for a, b, c in zip(lows, highs, compete, strict=True):
            at = bisect_right(starts, b) if c else 0
            hit = bool(at and ends[at - 1] >= a)
            if c and not hit:
                starts.insert(at, a)
                ends.insert(at, b)
            met.append(hit)
        return [met]

    marked = rows.withColumn("_competes", F.coalesce(competes, F.lit(False)))
    return by_group(marked, keys, [order], [first, last, "_competes"], mark, "overlaps boolean").drop("_competes")


def language_parts(parts: DataFrame, pages: int, tags: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """parts (pos, page, mcid, first, last, lang) with why: null where kept.

    tags (lang): those allowed; places (page, mcid, first, last): the candidates. Only parts sound
    in themselves compete for their characters.
    """
    row = parts
    if tags is not None:
        allowed = F.broadcast(tags.select("lang").distinct().withColumn("_tag", F.lit(True)))  # a short list; by exchange all parts of a tag would meet in one task
        row = row.join(allowed, "lang", "left")
    if places is not None:
        on = ["page", "mcid", "first", "last"]
        row = row.join(places.select(*on).distinct().withColumn("_place", F.lit(True)), on, "left")
    rules = [
        (~F.coalesce(F.col("page").between(1, pages), F.lit(False)), "page not in the book"),
        (~F.coalesce(F.col("mcid") >= 0, F.lit(False)), "run (MCID) not a whole number"),
        (~F.coalesce((F.col("first") >= 0) & (F.col("first") <= F.col("last")), F.lit(False)), "character indexes not in order"),
    ]
    if tags is not None:
        rules.append((F.col("_tag").isNull(), "language tag not allowed"))
    if places is not None:
        rules.append((F.col("_place").isNull(), "not a candidate place found by the audit"))
    row = row.withColumn("why", first_reason(rules)).select(*parts.columns, "why")
    row = apart(row, ["page", "mcid"], "pos", "first", "last", F.col("why").isNull())
    return row.withColumn("why", F.coalesce("why", F.when(F.col("overlaps"), "overlaps another part in the same run"))).drop("overlaps")


def fitting(steps: DataFrame, keys: list[str], order: str, cost: str, room: str) -> DataFrame:
    """(keys, kept, left_out): in order, a step that fits what is left of room is kept, one that doesn't is left out and later ones may still fit.

    A fold over the ordered steps of a key, which are few. A null room keeps all; steps without a cost are passed over.
    """
    rows = steps.where(F.col(cost).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("double").alias("c")))).alias("s"), F.min(F.col(room).cast("double")).alias("r")
    )
    fits = lambda a, x: a["r"].isNull() | (x["c"] <= a["r"] + 1e-9)
    none = F.lit(0).cast("long")
    start = F.struct(F.col("r"), none.alias("kept"), none.alias("out"))
    end = F.aggregate(
        "s", start, lambda a, x: F.struct(F.when(fits(a, x), a["r"] - x["c"]).otherwise(a["r"]).alias("r"),
        (a["kept"] + fits(a, x).cast("long")).alias("kept"), (a["out"] + (~fits(a, x)).cast("long")).alias("out")),
    )
    return rows.withColumn("_e", end).select(*keys, F.col("_e.kept").alias("kept"), F.col("_e.out").alias("left_out"))
