"""Every query with SQL gives DuckDB's rows on the same tables; every other one runs with a stable schema."""

import glob
import os

import duckdb
import numpy as np
import pytest

from factorloom import queries as engine

LLM_PREFIX = "op"


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind not in "fiub":
            df[c] = df[c].astype(str).str.replace(" 00:00:00", "")
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_oracle(spark, sf_dir, con, name):
    a, b = rows(engine.QUERIES[name](spark, sf_dir).toPandas()), rows(con.execute(engine.ORACLES[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "fiub" and b[c].dtype.kind in "fiub":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=2e-8)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all()


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_runs(spark, sf_dir, name):
    df = engine.QUERIES[name](spark, sf_dir)
    assert len(df.columns) and df.limit(5).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(engine.QUERIES) <= set(e.queries()) and set(engine.ORACLES) <= set(e.oracle_sql())
