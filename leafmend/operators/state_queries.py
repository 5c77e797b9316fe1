"""Queries for budgets, refreshed views, nested paths and rules in order: whole tables in, SQL written apart from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Duck, Spark
from ..plans.given import values
from ..sources.shared import shared_path
from ..streaming import budget
from . import firstrule, paths, views


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _requests(events: DataFrame) -> DataFrame:
    return events.selectExpr(*_split(budget.REQUESTS.format(seconds=Spark().seconds("ts"))))


def _split(columns: str) -> list[str]:
    """Column expressions of a list, cut at commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i].strip())
            at = i + 1
    parts = [*out, columns[at:].strip()]
    return [p for p in parts if p]


def budget_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a request against its user's two limits: granted or refused by what, and what is spent and reserved then."""
    return budget.rounded(budget.decided(_requests(_table(spark, sf_dir, "events")), budget.LIMITS, budget.CALL_CAP))


def streamed_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the events."""
    events = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    return budget.rounded(budget.drained(spark, budget.streamed(_requests(events), budget.LIMITS, budget.CALL_CAP)))


BUDGET_DECISIONS = budget.sql(budget.REQUESTS.format(seconds=Duck().seconds("ts")))


def refreshed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer, as a view that was built before every hundredth order had changed and was then brought up to date."""
    orders = _table(spark, sf_dir, "orders")
    before = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    build = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last_order"))
    path = shared_path(spark, "view")
    for rows in (before, orders):
        views.refresh(rows, ["o_custkey"], build, path)
    return views.read(spark, path)


REFRESHED_CUSTOMERS = "SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey"

_PLAIN = r"^[A-Za-z]+://|[?#].*$|/+$"


def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' paths with the folders and hosts above them: what each lies inside, and how many lie inside it."""
    pages = _table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", _PLAIN, ""), _PLAIN, "").alias("path"))
    return paths.related(pages.select(F.explode(paths.prefixes("path")).alias("path")), "path")


NESTED_PATHS = f"""
    WITH given AS (SELECT regexp_replace(regexp_replace(url, '{_PLAIN}', '', 'g'), '{_PLAIN}', '', 'g') AS p FROM pages),
    p AS (SELECT DISTINCT array_to_string(string_split(p, '/')[1:n], '/') AS path FROM given, unnest(range(1, len(string_split(p, '/')) + 1)) AS e(n)),
    pairs AS (SELECT a.path, b.path AS above FROM p a JOIN p b ON starts_with(a.path, b.path || '/'))
    SELECT p.path, u.nearest, coalesce(u.n, 0) AS above, coalesce(d.n, 0) AS below FROM p LEFT JOIN (SELECT path, arg_max(above, length(above)) AS nearest, count(*) AS n FROM pairs GROUP BY path) u ON u.path = p.path
    LEFT JOIN (SELECT above AS path, count(*) AS n FROM pairs GROUP BY above) d ON d.path = p.path"""

#: rank, code, language (any if null), a word that the text has, a pattern.
RULES = [
    (1, "credential", None, "password", "(?i)password[\"']? *[:=]"), (2, "credential", None, "token", "(?i)token[\"']? *[:=]"), (3, "address", None, None, "[A-Za-z0-9.]+@[a-z]+[.][a-z]+"), (4, "license", "en", "license", None),
    (5, "license", None, "licensed", None), (6, "symbols", None, None, "[#$%&*]{3}"), (7, "short", None, None, "^[^ ]* ?[^ ]*$"), (8, "german", "de", "nicht", None), (9, "french", "fr", "nous", None), (10, "french", "fr", "pour", "pour [a-z]"),
    (11, "spanish", "es", "para", None), (12, "english", "en", "the", None), (13, "other", None, None, None),
]


def first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of RULES that holds of each document."""
    rules = spark.createDataFrame(RULES, "rank long, code string, scope string, word string, pattern string")
    return firstrule.first_rules(_table(spark, sf_dir, "documents"), "doc_id", "lang", "text", rules)


_RULES = values([tuple(v.replace("'", "''") if isinstance(v, str) else v for v in r) for r in RULES], "r", "rank, code, scope, word, pattern")
FIRST_RULES = f"""
    SELECT d.doc_id, min(r.rank) AS rank, arg_min(r.code, r.rank) AS code FROM documents d LEFT JOIN {_RULES} ON (r.scope IS NULL OR r.scope = d.lang) AND d.text IS NOT NULL
      AND (r.word IS NULL OR list_contains(regexp_extract_all(lower(d.text), '[\\pL\\pN_]+'), r.word)) AND (r.pattern IS NULL OR regexp_matches(d.text, r.pattern)) GROUP BY d.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (budget_decisions, streamed_budgets, refreshed_customers, nested_paths, first_rules)}


def oracle_sql() -> dict[str, str]:
    return {"budget_decisions": BUDGET_DECISIONS, "streamed_budgets": BUDGET_DECISIONS, "refreshed_customers": REFRESHED_CUSTOMERS, "nested_paths": NESTED_PATHS, "first_rules": FIRST_RULES}
