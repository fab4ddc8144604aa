"""Every query with a DuckDB statement, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from panelwright.oracles import ORACLES
from panelwright.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert set(a) == set(b) and len(a) == len(b)
    cols = sorted(a, key=lambda c: (a[c].dtype.kind == "f", c))
    a, b = a[cols].sort_values(cols).reset_index(drop=True), b[cols].sort_values(cols).reset_index(drop=True)
    for c in cols:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-5, atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
