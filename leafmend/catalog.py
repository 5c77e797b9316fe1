"""All registered queries and their SQL: plans are SQL over the tables as views, the rest are operators on DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from .operators import queries as operators
from .operators import range_queries, state_queries, text_queries
from .plans import joins, language, names, pages, places, rules, stats, text, windows, workorders
from .plans.dialect import Duck, Spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Functions of families that are parts of queries only.
PARTS = {"passes", "lines", "steps", "cut_words", "classed_words"}
FAMILIES: tuple[ModuleType, ...] = (text, windows, joins, stats, rules, workorders, language, places, pages, names)


def plans() -> dict[str, Callable]:
    """Name to function of a dialect, for every plan of every family."""
    return {n: f for m in FAMILIES for n, f in vars(m).items() if not n.startswith("_") and n not in PARTS and callable(f) and getattr(f, "__module__", "") == m.__name__}


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Register the tables that a plan names; Spark prunes and pushes into their scans."""
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _query(plan: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = plan(Spark())
        views(spark, sf_dir, sql)
        return spark.sql(sql)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _query(f) for n, f in plans().items()} | operators.queries() | range_queries.queries() | text_queries.queries() | state_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {n: f(Duck()) for n, f in plans().items()} | operators.oracle_sql() | range_queries.oracle_sql() | text_queries.oracle_sql() | state_queries.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspect words by source."""
    return _query(text.text_quality_by_source)(spark, sf_dir)
