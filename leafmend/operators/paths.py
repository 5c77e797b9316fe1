"""Paths one inside another, by equality on their prefixes.

A path lies inside another if that is one of its prefixes up to a slash. Each
path is exploded into its prefixes, as many as it has parts, and these meet the
paths that are there by equality, so no range or cross join is needed. A prefix
of very many paths is spread by a salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def prefixes(path: str):
    """The path's prefixes up to each slash but the last, shortest first, the path itself last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def inside(rows: DataFrame, path: str, holders: DataFrame, holder: str, salts: int = SALTS) -> DataFrame:
    """rows with each of the holders that they are the same as or lie inside: a row for each pair, holder's column beside.

    Null paths are in nothing. Holders are taken once each; the row's columns
    stay as they are.
    """
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(salts)).cast("int")
    each = rows.where(F.col(path).isNotNull()).withColumn("_salt", salt).withColumn("_prefix", F.explode(prefixes(path)))
    there = holders.where(F.col(holder).isNotNull()).select(F.col(holder).alias("_holder")).distinct().withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = each.join(there, (F.col("_prefix") == F.col("_holder")) & (F.col("_salt") == F.col("_at")))
    return met.select(*rows.columns, F.col("_holder").alias(holder if holder not in rows.columns else f"{holder}_holder"))


def related(rows: DataFrame, path: str) -> DataFrame:
    """(path, nearest, above, below): for each distinct path the longest other one that it lies inside, how many it lies inside, how many lie inside it.

    The counts are sums of prefixes, put together before they are sent.
    """
    names = rows.where(F.col(path).isNotNull()).select(path).distinct()
    up = inside(names, path, names.withColumnRenamed(path, "_other"), "_other").where(F.col("_other") != F.col(path))
    above = up.groupBy(path).agg(F.max_by("_other", F.length("_other")).alias("nearest"), F.count("*").alias("above"))
    below = names.select(F.explode(prefixes(path)).alias(path)).groupBy(path).agg((F.count("*") - 1).alias("below"))
    zero = F.lit(0).cast("long")
    out = names.join(above, path, "left").join(below, path, "left")
    return out.select(path, "nearest", F.coalesce("above", zero).alias("above"), F.coalesce("below", zero).alias("below"))
