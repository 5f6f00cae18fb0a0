"""Every registered query against its SQL twin on the smallest table set."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools.compare import NAMES, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for n in NAMES:
        c.execute(f"create view {n} as select * from '{FOLDER}/{n}.parquet'")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "qty_a_pct" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, rel.fetchall())
