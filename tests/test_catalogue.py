"""Every query with an oracle gives the oracle's rows at the smallest scale."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from shapeminer.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _norm(v):
    return round(v, 9) if isinstance(v, float) else float(v) if isinstance(v, Decimal) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    oracle = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(oracle.columns) == cols
    at = [oracle.columns.index(c) for c in cols]
    assert got == sorted((tuple(_norm(r[k]) for k in at) for r in oracle.fetchall()), key=str)


def test_entry(spark):
    assert {r.path_id for r in catalogue.entry(spark, DATA).collect()} == {"$", "$[]", "$[].k"}
