"""Every registered query against its SQL twin in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import DATA


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_a_twin():
    assert set(entry.own_queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.own_queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    twin = db.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    mine = sorted(map(tuple, df.select(*columns).collect()))
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(twin.project(quoted).fetchall())
    assert len(mine) > 0
    assert mine == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["o_custkey", "o_orderkey"]
    assert df.count() > 0
