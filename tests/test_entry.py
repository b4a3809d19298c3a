import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
FEW = ["topk_orders", "where_boolean", "group_aggregates", "aggregate_global_empty", "enrich_optional", "within_enrich", "multi_join", "live_state", "set_bdiff", "set_diff", "enrich_none_is_anti", "enrich_many", "within_where_project", "key_get", "key_get_many", "scan_page", "partition_coverage", "scatter_scan_pages", "filter_order_by", "built_plan", "covered_keys", "covered_page", "budget_soft_stop", "group_pages", "algebra_match", "algebra_bound", "algebra_over_collections", "put_newest", "filter_as_algebra", "result_bytes", "last_complete_version", "small_sql", "sql_rewritten", "algebra_filter", "algebra_map"]


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", FEW)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    got = entry.queries()[name](spark, SMALL)
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name, table", [("pages_concatenated", "customer"), ("group_pages", "lineitem")])
def test_pages_put_together_are_one_table(spark, name, table):
    db = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = db.execute(entry.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*[d[0] for d in want.description]).collect())) == sorted(want.fetchall())
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
