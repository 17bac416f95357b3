"""Every metafile query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from vectorloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF)
    cursor = tables.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert want and sorted(rows, key=repr) == sorted(want, key=repr)
