"""Every query with SQL gives the rows of its SQL, and every other one runs."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def shown(rows):
    return sorted(tuple("nan" if x != x else repr(x + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, data, db):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    want = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]})").fetchall()
    assert shown(tuple(r[c] for c in columns) for r in df.collect()) == shown(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
