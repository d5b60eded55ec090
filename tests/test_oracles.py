"""Registered queries against their SQL at the smallest scale.

A selection by default; LEADFLOW_ALL_QUERIES=1 runs all of them (minutes).
"""

import os

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SELECTED = [
    "html_text", "page_hosts", "usable_values", "brief_quarantine", "repaired_requests", "query_expansion", "unused_queries",
    "search_response_json", "unvisited_evidence", "candidates", "best_evidence", "grounded_dossiers", "follow_up",
    "qualify_reasons", "drafts", "miss_streak", "promote", "run_lookup", "upsert_runs", "shortlist_records", "run_responses",
    "landed_briefs", "memory_loaded", "campaign_iterations",
]


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", list(oracle_sql()) if os.environ.get("LEADFLOW_ALL_QUERIES") else SELECTED)
def test_query(spark, con, small, name):
    rows, diff = compare.differences(spark, con, queries()[name], oracle_sql()[name], small)
    assert rows > 0 and not diff


def test_sort_merge_joins_give_the_same(spark, con, small):
    """Without broadcasts, as for tables that are too large for them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        _, diff = compare.differences(spark, con, queries()["dossiers"], oracle_sql()["dossiers"], small)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert not diff


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["country", "outcome", "candidates", "total_score"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
