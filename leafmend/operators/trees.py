"""Trees given as child and parent, by pointer jumping: as many rounds as the logarithm of the depth, not the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import deleted, shared_path

DEEPEST = 64


def inherited(nodes: DataFrame, node: str, parent: str, value: str, deepest: int = DEEPEST) -> DataFrame:
    """(node, depth, inherited): depth 0 without a known parent; inherited is the node's own value or its nearest ancestor's that has one.

    nodes: of several rows of a node the smallest counts. Each round
    joins every node with the ancestor it has reached and takes that
    ancestor's reach, written to the shared folder so that lost executors cost
    one round. Rows that meet no root within deepest steps (cycles, too deep) have a null depth.
    """
    spark = nodes.sparkSession
    base = nodes.where(F.col(node).isNotNull()).groupBy(node).agg(F.min(F.struct(F.col(parent).alias("p"), F.col(value).alias("v"))).alias("s"))
    known = base.select(F.col(node).alias("_p"))
    at = base.join(known, F.col("s.p") == F.col("_p"), "left").select(F.col(node).alias("id"), F.col("_p").alias("up"), F.col("s.v").alias("v"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("d"))
    reach, before = 1, None
    while reach <= deepest:
        path = shared_path(spark, "tree")
        at.write.parquet(path)
        if before:
            deleted(spark, before)
        at, before = spark.read.parquet(path), path
        if at.where("up is not null").isEmpty():
            break
        above = at.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("v").alias("_v"), F.col("d").alias("_d"))
        at = at.join(above, F.col("up") == F.col("_id"), "left").select("id", F.col("_up").alias("up"), F.coalesce("v", "_v").alias("v"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"))
        reach *= 2
    return at.select(F.col("id").alias(node), F.when(F.col("up").isNull(), F.col("d")).alias("depth"), F.col("v").alias("inherited"))
