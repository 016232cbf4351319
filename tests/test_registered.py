"""Registered queries against DuckDB on the smallest tables (check_queries.py runs all of them)."""

import os

import duckdb
import pytest

import __spark_entry__ as registered
from check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "links_summary",
    "anchor_candidates_links",
    "edge_cap_priority",
    "power_flags",
    "segment_metrics",
    "scenario_edges",
    "filter_urls",
    "depth_stats",
    "traffic_pareto",
    "category_table",
    "schema_checklist",
    "expand_finalize",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


def test_entry(spark):
    assert registered.entry(spark).count() == 20


def test_every_sql_form_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_kpis_are_one_json_row(spark):
    rows = registered.queries()["report_kpis_json"](spark, FOLDER).collect()
    assert len(rows) == 1 and "anchor_candidate_count" in rows[0]["kpis"]


@pytest.mark.parametrize("key", ["report_export_counts", "filtered_top_pages", "filtered_page", "report_kpis_json", "tree_json_scan"])
def test_report_part(spark, key):
    test_query(spark, key)


@pytest.mark.parametrize("key", SOME)
def test_query(spark, key):
    database = duckdb.connect()
    for table in TABLES.split():
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = registered.queries()[key](spark, FOLDER).toPandas()
    want = database.execute(registered.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
