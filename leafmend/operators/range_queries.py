"""Queries over few, large keys, by running sums over ranges, and their SQL by windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words
from ..plans.dialect import Duck, Spark
from ..sources.shared import spread
from .ranges import numbered, running


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranges_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive numbers as ranges."""
    rows = numbered(_table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"])
    islands = rows.groupBy("event_type", (F.col("event_id") - F.col("place")).alias("island"))
    return islands.agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n")).drop("island")


RANGES_COLLAPSE = """SELECT event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM (
    SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM events) GROUP BY event_type, island"""


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fortieth document of a language."""
    rows = numbered(_table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"])
    return rows.where("(place - 1) % 40 = 0").select("lang", "doc_id")


SYSTEMATIC_SAMPLE = "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE (rn - 1) % 40 = 0"


def chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of at most 150 forms, in order, within a source."""
    rows = numbered(_table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])
    chunks = rows.groupBy("source", F.expr("(place - 1) DIV 150").alias("chunk"))
    return chunks.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


CHUNKING = """SELECT source, chunk, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (
    SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 150) AS BIGINT) AS chunk FROM documents) GROUP BY source, chunk"""


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in date order until a status's budget is spent."""
    orders = _table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey", "o_totalprice")
    rows = running(orders, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    return rows.where("so_far_o_totalprice <= 5000000").select("o_orderstatus", "o_orderkey")


BUDGET_PREFIX = """SELECT o_orderstatus, o_orderkey FROM (
    SELECT o_orderstatus, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS so_far FROM orders) WHERE so_far <= 5000000"""


def peak_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most requests under way at once for each kind; one that ends where another begins isn't counted with it."""
    t = Spark().seconds("ts")
    steps = f"array(struct(round({t}, 3) AS t, 1L AS step), struct(round({t} + value * 60, 3) AS t, -1L AS step))"
    rows = _table(spark, sf_dir, "events").select("event_type", "event_id", F.explode(F.expr(steps)).alias("s")).select("event_type", "event_id", "s.*")
    return running(rows, ["event_type"], ["t", "step", "event_id"], ["step"]).groupBy("event_type").agg(F.max("so_far_step").alias("peak"))


_T = Duck().seconds("ts")
PEAK_IN_FLIGHT = f"""SELECT event_type, CAST(max(running) AS BIGINT) AS peak FROM (
    SELECT event_type, sum(step) OVER (PARTITION BY event_type ORDER BY t, step, event_id ROWS UNBOUNDED PRECEDING) AS running FROM (
      SELECT event_type, event_id, round({_T}, 3) AS t, 1 AS step FROM events UNION ALL SELECT event_type, event_id, round({_T} + value * 60, 3) AS t, -1 AS step FROM events)) GROUP BY event_type"""


def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place among the queued of a priority."""
    queued = _table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderpriority", "o_orderdate", "o_orderkey")
    return numbered(queued, ["o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "place")


QUEUE_POSITION = "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders WHERE o_orderstatus = 'O'"


def needs_person_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What needs a person: by rank, then the leading ones, then place."""
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN n_chars < 60 THEN 1 WHEN n_chars > 15000 THEN 2 END AS rnk", "doc_id % 2 AS later").where("rnk IS NOT NULL")
    return numbered(docs, [], ["rnk", "later", "doc_id"]).selectExpr("doc_id", "CASE rnk WHEN 1 THEN 'too short' ELSE 'too long' END AS issue", "place")


NEEDS_PERSON_RANK = """SELECT doc_id, issue, CAST(row_number() OVER (ORDER BY rnk, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END, doc_id) AS BIGINT) AS place FROM (
    SELECT doc_id, 'too short' AS issue, 1 AS rnk FROM documents WHERE n_chars < 60 UNION ALL SELECT doc_id, 'too long', 2 FROM documents WHERE n_chars > 15000)"""


def bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a document that the next of its source lacks or has too many of, in any order, for each of its own.

    The next one is found by ids alone; then each text meets its neighbour's in one join.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    places = numbered(docs.select("source", "doc_id"), ["source"], ["doc_id"])
    before = places.select("source", (F.col("place") + 1).alias("place"), F.col("doc_id").alias("earlier"))
    pairs = before.join(places, before["source"].eqNullSafe(places["source"]) & (before["place"] == places["place"])).select("earlier", "doc_id")
    with_text = pairs.join(docs.select("doc_id", F.col("text").alias("later")), "doc_id").where("later IS NOT NULL").select(F.col("earlier").alias("doc_id"), "later")
    rate = F.round(words.bag_gap("text", "later").cast("double") / F.greatest(F.length("text"), F.lit(1)), 6)
    pairs = spread(docs.join(with_text, "doc_id").select("doc_id", "text", "later"), "doc_id")
    return pairs.select("doc_id", rate.alias("rate"))


_D = Duck()
_GAP = "abs(length(text) - length(replace(text, c, '')) - length(later) + length(replace(later, c, '')))"
BAG_DIFF = f"""SELECT doc_id, round(CAST({_D.summed(_D.characters("concat(text, later)"), "c", _GAP)} AS DOUBLE) / greatest(length(text), 1), 6) AS rate
    FROM (SELECT doc_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS later FROM documents) WHERE later IS NOT NULL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (ranges_collapse, systematic_sample, chunking, budget_prefix, peak_in_flight, queue_position, needs_person_rank, bag_diff)}


def oracle_sql() -> dict[str, str]:
    return {
        "ranges_collapse": RANGES_COLLAPSE, "systematic_sample": SYSTEMATIC_SAMPLE, "chunking": CHUNKING, "budget_prefix": BUDGET_PREFIX, "peak_in_flight": PEAK_IN_FLIGHT,
        "queue_position": QUEUE_POSITION, "needs_person_rank": NEEDS_PERSON_RANK, "bag_diff": BAG_DIFF,
    }
