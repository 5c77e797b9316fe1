"""A corpus pipeline of five stages, each on all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents, whatever their names; rows are told apart by a
number of their own, so null and repeated doc_ids, repeated rows and columns
named like an operator's make no difference. A stage on an empty table returns
none. run() deletes a stage's folder as soon as the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmend.llm import mixing, packing, secrets, simhash, toxicity
from leafmend.llm.common import dropped, kept, new_path

#: The column that numbers rows; no table has it.
ROW = "_pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW, written once so that a row keeps its number."""
    return kept(docs.withColumn(ROW, F.monotonically_increasing_id()))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts as toxic go; all others stay as they are, null and empty texts too."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = docs.select(F.struct(*docs.columns).alias("document"), "text")
    return toxicity.scored(packed, model).where("predicted = 0").select("document.*")


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: that of the smallest doc_id, nulls last, and of its rows the first.

    Null and empty texts share a fingerprint, so one row of them stays.
    """
    rows = _numbered(docs)
    found = simhash.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"))
    named = found.select("component_id", F.col("doc_id").alias(ROW)).join(rows.select(ROW, "doc_id"), ROW)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    return rows.join(kept(first.select(f"first.{ROW}")), ROW, "left_semi").select(*docs.columns)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked, and n_chars (where there is one) follows the text."""
    packed = docs.select(F.struct(*docs.columns).alias("document"), "text")
    out = secrets.scanned(packed)
    same = F.col("clean_text").eqNullSafe(F.col("document.text"))
    n_chars = lambda: F.when(same, F.col("document.n_chars")).otherwise(F.length("clean_text").cast("long")).alias("n_chars")
    changed = {"text": lambda: F.col("clean_text").alias("text"), "n_chars": n_chars}
    return out.select(*(changed[c]() if c in changed else F.col(f"document.`{c}`") for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. Rows without words are never taken."""
    rows = _numbered(docs)
    plan = mixing.mixed(rows, row=F.col(ROW))
    copies = plan.where("copies > 0").select(F.col("row").alias(ROW), F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("_pipeline_copies"))
    return rows.join(copies, ROW).withColumn("_pipeline_copy", F.explode("_pipeline_copies")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row for each piece of each row; a null text is its end id alone."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash", near_copies_out),
    ("secrets", secrets_masked),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fingerprints, the classifier, guess costs and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            dropped(spark, before)
        before = path
    out = kept(STAGES[-1][1](spark, docs, sf_dir))
    dropped(spark, before)
    return out
