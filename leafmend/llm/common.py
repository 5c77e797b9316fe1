"""Pieces that several corpus operators share: shared storage, batches, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as white space between words: the six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor can reach.

    Where the session names none, a session on one machine (tests) gets a
    folder below the warehouse; on a cluster that would be some machine's own
    disk, so it is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return spark.conf.get("spark.checkpoint.dir", None) or found


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/leafmend-{what}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared place that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def components(edges: DataFrame, salts: int = 8, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an undirected graph of long ids.

    edges: columns a and b; self-loops and repeats are ignored. root is the
    smallest node that can be reached. Alternating large-star and small-star
    rounds, each cut by a checkpoint in the shared folder, so no component is
    gathered anywhere; minima are partial aggregates and their joins are
    salted, so a hub's edges are spread over tasks. An empty graph gives no
    rows.
    """
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), salt.alias("s"))

    def salted(e: DataFrame) -> DataFrame:
        return e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, state = kept(e), None
    for _ in range(most_rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
        if now == state or not now["n"]:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = salted(both).where("v > u").join(least(both), ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = salted(large).join(least(large), ["u", "s"])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = kept(small.where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def prefixed(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """rows with before_<column>: the sums of columns over all rows before each, in order (ascending, unique).

    Rows are dealt to ranges of the order and written once; the totals of the
    ranges, one row each, are summed ahead of them, so no task holds more than
    its range.
    """
    ranged = kept(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in columns))  # as many rows as ranges
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"before_{c}") for c in columns]
    return ranged.join(F.broadcast(starts), "_range").select(*rows.columns, *sums)
