"""Every query against its SQL in DuckDB on the smallest tables; queries without SQL must have rows and a stable schema."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and df[c].dtype != bool:
            df[c] = df[c].astype("float64").round(5) + 0.0
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, duck, name):
    got, expected = plain(QUERIES[name](spark, SF).toPandas()), plain(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(expected.columns)
    assert len(got) == len(expected)
    assert got.equals(expected), got[(got != expected).any(axis=1)].head()


@pytest.mark.parametrize("name", [n for n in OWN if n not in SQL])
def test_has_rows(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert len(rows)
    assert all(np.isfinite(rows[c]).all() for c in rows if rows[c].dtype.kind == "f")


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
