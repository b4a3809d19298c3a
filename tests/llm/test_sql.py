"""The queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from nestloom.llm import queries

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    got, want = queries.queries()[name](spark, SMALL), db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
