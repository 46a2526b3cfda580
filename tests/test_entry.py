"""The driver's contract, and the engine's queries against DuckDB."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__
from braidwork import queries as core

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    names = sorted(df.columns)
    found = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=repr)
    cursor = duck.execute(core.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    expected = sorted(([plain(r[columns.index(c)]) for c in names] for r in cursor.fetchall()), key=repr)
    assert sorted(columns) == names and found == expected


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
