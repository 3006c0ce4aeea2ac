"""Registered queries against their SQL on the smallest tables. All of them with DELTION_ALL=1."""

import os

import pytest

from deltion.catalog import load
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
SAMPLE = [
    "i1_norm_text", "i3_parse_locale_number", "i6_parse_deadline", "a1_scan_candidate_report", "a5_extract_html_table_rows", "b1_upsert_replace", "b7_upsert_change_tracked",
    "c4_scope_match", "c6_works_gate", "d4_overlay_merge", "d11_suppress_linked_duplicates", "d15_evaluate_rules", "e4_tender_scores", "e9_validate_totals", "f3_best_line",
    "f4_source_health", "g4_attention_buckets", "h5_subset_test", "j2_change_preflight", "j3_preflight_stream", "k2_dashboard_funnel", "k9_digest",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLES) if os.environ.get("DELTION_ALL") else SAMPLE)
def test_query_equals_sql(spark, con, name):
    assert [p for p in compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) if p != "no rows"] == []


def test_every_query_is_named_once():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 200
