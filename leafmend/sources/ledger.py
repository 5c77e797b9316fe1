"""An append-only ledger of JSON lines, and the seed it starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "kind string, model string, prompt string, input_est long, input_billed long, output long, images long, forms long, date string, book string, pass string, attempt long"
KEY = ("kind", "book", "date", "pass", "attempt")


def valid() -> Column:
    """A usable row: kind, model and date given, counts positive."""
    return F.coalesce(F.expr("kind <> '' AND model <> '' AND date <> '' AND input_est > 0 AND input_billed > 0 AND output >= 0"), F.lit(False))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ledger with an explicit schema; malformed lines and unusable rows are skipped."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where(valid())


def rows(seed: DataFrame, ledger: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Seed and ledger as one, books renamed by labels (book, label): the first row of each KEY by its counts, without what the seed has by (date, counts)."""
    if labels is not None:
        names = labels.select(F.col("book").alias("_book"), F.col("label").alias("_label"))
        ledger = ledger.join(names, F.col("book") == F.col("_book"), "left").withColumn("book", F.coalesce("_label", "book")).drop("_book", "_label")
    w = Window.partitionBy(*KEY).orderBy("input_est", "input_billed", "output")
    once = ledger.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return seed.unionByName(once.join(seed, ["date", "input_est", "input_billed", "output"], "left_anti"))


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a ledger's folder; Spark's committer makes them seen all at once."""
    rows.write.mode("append").json(path)
