"""Every registered query against its oracle on the small tables, and what must hold where there is none."""

import math

import duckdb
import pandas as pd
import pytest

from factloom.plans.catalog import ORACLE_SQL, QUERIES
from factloom.plans.fixtures import BASE


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return tuple(v)
    if pd.isna(v):
        return None
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else str(v)


def rows(df):
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def number(v):
    """A number written as text (decimals, counts) as a number; anything else as it is."""
    try:
        return float(v) if isinstance(v, str) else v
    except ValueError:
        return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [list(map(number, r)) for r in rows(got)] == [list(map(number, r)) for r in rows(want)]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
