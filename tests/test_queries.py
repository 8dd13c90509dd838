"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from barloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: v if v is None or isinstance(v, (str, bool)) else float(v) if isinstance(v, (int, float, np.number)) else str(v))
        elif df[c].dtype == bool or np.issubdtype(df[c].dtype, np.number):
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), kind="stable", key=lambda s: s.astype(str) if s.dtype == object else s.round(3)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = canon(catalog.queries()[name](spark, SF).toPandas()), canon(duck.execute(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        if got[c].dtype == float or want[c].dtype == float:
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=2e-6 if name else 0, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_entry_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
