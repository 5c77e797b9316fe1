"""Each plan against the same plan in DuckDB."""

import math
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from leafmend import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating, Decimal)):
        return f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours = catalog.queries()[name](spark, SF).toPandas()
    theirs = duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda t: sorted(tuple(map(plain, r)) for r in t[columns].values.tolist())
    assert rows(ours) == rows(theirs)


def test_filters_reach_the_scan(spark):
    df = catalog.queries()["claimed_keys"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in plan and "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)]" in plan
    assert "text#" not in plan
