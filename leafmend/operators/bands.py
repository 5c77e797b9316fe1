"""Joins on nearness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, reach: float) -> DataFrame:
    """Pairs with equal keys and abs(x - y) <= reach, all columns of both (right's keys dropped).

    An equality join on bands of width reach, right standing in its own and
    the two beside, so no task gets the pairs of more than three bands. Null and non-finite values pair with nothing.
    """
    usable = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    band = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(reach)))
    a = left.where(usable(x)).withColumn("_band", band(x))
    b = right.where(usable(y)).withColumn("_band", F.explode(F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda i: band(y) + i)))
    return a.join(b, [*keys, "_band"]).where(F.abs(F.col(x) - F.col(y)) <= reach).drop("_band")
