"""Outcomes of steps as they arrive: states that never grow weaker, the latest row, one row of each key.

Each state is one aggregation of two or three greatest values, so it means the
same over a table and over a stream, and partial aggregation shrinks it first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: Outcomes that refuse a step, and those that end one.
REFUSALS = ("cap", "book", "credit")
ENDED = ("done", "started", "error", "lookup")


def outcome(rows: DataFrame, keys: list[str], seq: str, why: str) -> DataFrame:
    """(keys, outcome): a refusal stays against saved and not_run, an ended step against saved; else the latest holds.

    After the last row that is neither saved nor not_run (the firm one), a
    refusal keeps its place for good; an ended step does until a not_run, after which the latest row counts.
    """
    firm = ~F.col(why).isin("saved", "not_run")
    last = lambda when: F.max(F.when(when, F.struct(F.col(seq).alias("seq"), F.col(why).alias("why"))))
    s = rows.where(F.col(why).isNotNull()).groupBy(*keys).agg(last(firm).alias("f"), last(F.col(why) == "not_run").alias("n"), last(F.lit(True)).alias("l"))
    given_up = F.coalesce(F.col("n.seq") > F.col("f.seq"), F.lit(False))
    holds = F.coalesce(F.col("f.why").isin(*REFUSALS) | (F.col("f.why").isin(*ENDED) & ~given_up), F.lit(False))
    return s.select(*keys, F.when(holds, F.col("f.why")).otherwise(F.col("l.why")).alias("outcome"))


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the greatest seq of each key, columns as they were."""
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    top = rows.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_top"))
    return top.select(*(c if c in keys else F.col(f"_top.{c}").alias(c) for c in rows.columns))


def once(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; a repeat is known for as long as the watermark reaches back."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def drained(spark: SparkSession, source: DataFrame, state: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a stream holds now through an aggregating state: each batch writes the whole state anew, the last one is read.

    Batches are files of their own in the shared folder, so a batch that is run again replaces itself.
    """
    out, marks = shared_path(spark, "state"), shared_path(spark, "marks")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = state(source).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    number = (query.lastProgress or {}).get("batchId", 0)
    return spark.read.parquet(f"{out}/batch={number}")
