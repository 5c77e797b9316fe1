"""A stored result that follows its table: only keys whose rows have changed are worked out again.

The result lies in parts by a hash of the key, with the fingerprint of the rows
that each key's result came from. A refresh compares fingerprints, builds the
changed keys anew, and writes the parts that hold any of them, or of keys that
are gone; all other parts stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import deleted, stored

PARTS = 64


class Refreshed(NamedTuple):
    """How many keys there are, were built anew, are gone; and parts written."""

    keys: int
    built: int
    gone: int
    parts: int


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mark): one value for the rows of a key, whatever their order; repeated rows count."""
    each = F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in rows.columns))
    marks = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(each.cast("decimal(38,0)")).alias("s"), F.bit_xor(each).alias("x"))
    return marks.select(*keys, F.concat_ws(":", "n", "s", "x").alias("_mark"))


def refresh(rows: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame], path: str, parts: int = PARTS) -> Refreshed:
    """Bring the view at path up to date with rows; build makes result rows, with the keys, of the rows of some keys.

    keys are not null. build must work key by key. A key of whose rows build
    makes nothing has no result, and is not built again while they stay. A
    view that isn't there yet is built whole. A refresh that is broken off
    leaves parts of both states, whose fingerprints say which keys to do again.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    now = fingerprints(rows, keys)
    old = _read(spark, path)
    if old is None:
        changed = stored(now, "changed")
        first = build_marked(rows, changed, keys, build)
        first.withColumn("_part", part).write.partitionBy("_part").parquet(path)
        first.limit(0).coalesce(1).write.parquet(f"{path}/_part=-1")  # the columns, should all keys go
        n = changed.count()
        return Refreshed(n, n, 0, spark.read.parquet(path).select("_part").distinct().count())
    known = old.select(*keys, F.col("_mark").alias("_was")).distinct()
    compared = now.join(known, keys, "full")
    compared = stored(compared.withColumn("_state", F.when(F.col("_mark").isNull(), "gone").when(F.col("_mark").eqNullSafe(F.col("_was")), "same").otherwise("new")).withColumn("_part", part), "compared")
    n = {r["_state"]: r["n"] for r in compared.groupBy("_state").agg(F.count("*").alias("n")).collect()}
    touched = [r["_part"] for r in compared.where("_state <> 'same'").select("_part").distinct().collect()]  # PARTS at most
    if touched:
        changed = compared.where("_state = 'new'").select(*keys, "_mark")
        fresh = build_marked(rows, changed, keys, build).withColumn("_part", part)
        stay = old.where(F.col("_part").isin(touched)).join(compared.where("_state = 'same'").select(*keys), keys, "left_semi")
        merged = stored(stay.unionByName(fresh), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
        for p in set(touched) - {r["_part"] for r in merged.select("_part").distinct().collect()}:
            deleted(spark, f"{path}/_part={p}")  # all its keys are gone
    return Refreshed(n.get("same", 0) + n.get("new", 0), n.get("new", 0), n.get("gone", 0), len(touched))


def build_marked(rows: DataFrame, changed: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build()'s rows of the changed keys with their fingerprints; a key without a result keeps its fingerprint in a row of its own."""
    made = build(rows.join(changed.select(*keys), keys, "left_semi"))
    return changed.join(made.withColumn("_result", F.lit(True)), keys, "left").withColumn("_result", F.coalesce("_result", F.lit(False)))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The view's result."""
    return spark.read.parquet(path).where("_result").drop("_mark", "_result", "_part")
