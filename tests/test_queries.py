"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from strandspark import queries, queries_models

QUERIES, SQL = queries.QUERIES | queries_models.QUERIES, queries.SQL | queries_models.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    ours, theirs = _sorted(QUERIES[name](spark, DATA).toPandas()), _sorted(duck.sql(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs) > 0
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=1e-9, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and len(df.limit(3).collect()) > 0
