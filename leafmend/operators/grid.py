"""Table cells: where each sits, and which headers it has.

Cells: tbl, r (row from 0), i (place in its row), colspan, rowspan, empty. A
reading of a table: tbl, title_rows, note_rows, header_rows, header_cols,
group_rows and repeat_rows (arrays of row numbers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import by_group


def spots(cells: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first column, column after, row after) of each (row, colspan, rowspan) in tag order: a cell starts at the first column free in its row."""
    busy_until: list[int] = []
    out, row, col = [], None, 0
    for r, wide, high in cells:
        if r != row:
            row, col = r, 0
        while col < len(busy_until) and busy_until[col] > r:
            col += 1
        end = col + max(1, wide)
        busy_until += [0] * (end - len(busy_until))
        for c in range(col, end):
            busy_until[c] = max(busy_until[c], r + max(1, high))
        out.append((col, end, r + max(1, high)))
        col = end
    return out


def placed(cells: DataFrame) -> DataFrame:
    """Cells with their columns [c0, c1) and rows [r, r1)."""

    def place(r: list[int], wide: list[int], high: list[int]) -> list[tuple[int, ...]]:
        return list(zip(*spots(list(zip(r, wide, high, strict=True))), strict=True))

    rows = cells.select("tbl", "r", "i", "colspan", "rowspan", "empty")
    return by_group(rows, ["tbl"], ["r", "i"], ["r", "colspan", "rowspan"], place, "c0 long, c1 long, r1 long").drop("colspan", "rowspan")


def headed(cells: DataFrame, readings: DataFrame) -> DataFrame:
    """(tbl, r, i, th, scope, headers) of each cell that stays in its table; headers is an array of (r, i).

    A complex table (group rows, spanning cells in two or more header rows, or
    header-column cells that span rows) lists for each data cell with text the
    column headers above by overlap of columns, the row headers beside by overlap of rows, and the head
    of its group. Others need no lists. Empty cells are never headers. Readings are taken as sound.
    """
    rd = readings.select("tbl", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("title_rows", "note_rows", "header_rows", "header_cols")),
        *(F.coalesce(F.col(c), F.array().cast("array<int>")).alias(c) for c in ("group_rows", "repeat_rows")))
    every = Window.partitionBy("tbl")
    at = placed(cells).join(rd, "tbl").withColumn("n", F.max("r").over(every) + 1)
    at = at.where("r >= title_rows and r < n - note_rows").withColumn("body", F.col("title_rows") + F.col("header_rows"))
    at = at.withColumn("kind", F.expr("""CASE WHEN r < body THEN 'head' WHEN array_contains(repeat_rows, CAST(r AS INT)) THEN 'repeat'
        WHEN array_contains(group_rows, CAST(r AS INT)) THEN 'group' WHEN c0 < header_cols THEN 'side' ELSE 'data' END"""))
    lead = F.expr("kind = 'group' AND NOT empty AND i = min(CASE WHEN kind = 'group' AND NOT empty THEN i END) OVER (PARTITION BY tbl, r)")
    at = at.withColumn("th", F.coalesce(F.when(F.col("kind") == "group", lead).otherwise(~F.col("empty") & (F.col("kind") != "data")), F.lit(False)))
    at = at.withColumn("scope", F.expr("CASE WHEN NOT th THEN NULL WHEN kind = 'side' THEN 'Row' WHEN kind IN ('head', 'repeat') AND c0 < header_cols THEN 'Both' ELSE 'Column' END"))
    hard = F.expr("kind = 'group' OR (kind = 'head' AND header_rows > 1 AND c1 - c0 > 1) OR (kind <> 'head' AND c0 < header_cols AND r1 - r > 1)")
    at = at.withColumn("hard", F.max(hard).over(every))
    at = at.withColumn("grp", F.max(F.when(F.col("kind") == "group", F.col("r"))).over(every.orderBy("r").rangeBetween(Window.unboundedPreceding, 0)))
    heads = at.where("th and kind in ('head', 'side', 'group')").select("tbl", *(F.col(c).alias("h_" + c) for c in ("r", "i", "c0", "c1", "r1", "kind")))
    need = at.where("hard and not empty and not th").select("tbl", "r", "i", "c0", "c1", "grp")
    near = need.join(heads, "tbl").where("""(h_kind = 'head' AND h_c0 < c1 AND c0 < h_c1) OR (h_kind = 'side' AND h_r <= r AND r < h_r1) OR (h_kind = 'group' AND h_r = grp)""")
    rank = F.expr("CASE h_kind WHEN 'head' THEN 0 WHEN 'side' THEN 1 ELSE 2 END").alias("k")
    lists = near.groupBy("tbl", "r", "i").agg(F.array_sort(F.collect_list(F.struct(rank, F.col("h_r").alias("r"), F.col("h_i").alias("i")))).alias("h"))
    lists = lists.select("tbl", "r", "i", F.transform("h", lambda x: F.struct(x["r"].alias("r"), x["i"].alias("i"))).alias("headers"))
    out = at.select("tbl", "r", "i", "th", "scope").join(lists, ["tbl", "r", "i"], "left")
    return out.withColumn("headers", F.coalesce("headers", F.array().cast("array<struct<r:bigint,i:bigint>>")))
