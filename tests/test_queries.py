"""Every query with SQL equals DuckDB on the smallest tables; the others run."""

import decimal
import os

import duckdb
import pytest

from turnloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert isinstance(rows, list) and df.columns
        return
    want = oracle.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    got = sorted(repr([plain(r[c]) for c in names]) for r in rows)
    assert got == sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())
