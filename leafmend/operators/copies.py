"""Runs of characters that texts share with items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.text import SPACES

#: Characters of a shared run, and of the blocks a text is cut into: any run holds a whole block.
RUN, BLOCK = 20, 10


def squashed(text: Column) -> Column:
    """Case folded and white space removed."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), f"[{SPACES}]+", "")


def shared_runs(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, shingles): rows of docs that share RUN characters in a row with an item, and how many different such runs.

    A text is cut into blocks of BLOCK characters, each with the one before and
    after it; an item into all its runs, each by every block that it may hold,
    with the block's place in the run. They meet by equal blocks, and a run is
    shared if it stands around the block too. Whether items are few enough to
    be broadcast is left to the planner, which knows their size. Null and short
    texts share nothing; rows of one id count as one.
    """
    letters = items.select(F.col("item_id").cast("long").alias("item_id"), F.split(squashed(F.col("text")), "").alias("c")).where(F.size("c") >= RUN)
    runs = F.transform(F.sequence(F.lit(1), F.size("c") - RUN + 1), lambda i: F.array_join(F.slice("c", i, RUN), ""))
    runs = letters.select("item_id", F.explode(runs).alias("run")).distinct()
    keyed = runs.select("item_id", "run", F.posexplode(F.array(*(F.substring("run", 1 + o, BLOCK) for o in range(RUN - BLOCK + 1)))).alias("ahead", "block"))
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(squashed(F.col("text")), F.lit(f"(?s).{{1,{BLOCK}}}"), 0).alias("b"))
    part = lambda i: F.coalesce(F.get("b", i), F.lit(""))
    around = F.transform(F.sequence(F.lit(0), F.size("b") - 1), lambda i: F.struct(part(i - 1).alias("before"), F.get("b", i).alias("block"), part(i + 1).alias("after")))
    blocks = blocks.where(F.size("b") > 0).select("doc_id", F.explode(around).alias("p")).select("doc_id", "p.*")
    met = blocks.join(keyed, "block")
    start = F.length("before") + 1 - F.col("ahead")
    same = (start >= 1) & (F.substring(F.concat("before", "block", "after"), start, F.lit(RUN)) == F.col("run"))
    return met.where(same).select("item_id", "doc_id", "run").distinct().groupBy("item_id", "doc_id").agg(F.count("*").alias("shingles"))
