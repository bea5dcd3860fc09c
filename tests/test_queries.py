"""Every query of the library's own operators against DuckDB at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

from chronogrid.plans import catalog, catalog_plans  # noqa: F401  (registers more)

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(plain, r)) for r in pdf.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
