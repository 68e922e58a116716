"""Every query with a SQL form gives the same rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from parchwork.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tables")


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{FOLDER}/{file}')")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    other = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(mine, key=str) == sorted(other, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
