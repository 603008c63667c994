"""Registered queries against their SQL on the smallest tables (tools/check.py runs all)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from factloom.plans.oracle import ORACLE
from factloom.plans.queries import QUERIES
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "scan_messages", "readable_sample", "json_length_profile", "gen_slots", "gen_multi_amounts", "record_earnings", "fact_examples", "generation_rejects",
    "train_eval_split", "dataset_summary", "preference_pairs", "degenerate_pairs", "prompt_split", "length_budget_documents",
    "extract_rule_based", "extract_plugged_model", "schema_violations", "typed_projection", "explode_metrics",
    "model_metrics", "metrics_by_scenario", "fact_unknowns", "fact_metrics", "conversation_ground_truth", "merge_model_results",
    "extract_absent_model", "stream_request_metrics", "scan_pairs_by_split", "model_coverage", "failure_sample", "series_levels", "latency_percentiles", "inflight_requests", "stream_extraction",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    rows = {r.model: r for r in entry_points.entry(spark).collect()}
    assert rows["clean"].entity_f1 == 1.0 and rows["truncated"].valid_json_rate < 0.5


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())
