"""Every registered build-reuse query against its SQL twin."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from stillfresh.plans import answers, choices, copies, queries, reports  # noqa: F401  they add to the registered queries
from stillfresh.plans.fixtures import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return ""
    return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


def bag(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert bag(got, columns) == bag(want, columns)
