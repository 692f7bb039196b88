"""Every query that SQL can say, against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from vellum.plans.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(f"{v:.10g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df):
    return sorted(repr(tuple(map(cell, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def test_every_oracle_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, D).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)
