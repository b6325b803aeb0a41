"""Registered queries against their oracles on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from catalog import compare, load

SF = "/root/testdata/sf0.001"
NAMES = ["gap_key", "mapped_policies", "failed_row_sink", "health_mapping", "spelling_suggestions", "overlap_export_pivot", "policy_file_scan", "context_fill_down", "configured_rule_join", "cascading_facets",
         "health_upload_rejected", "motor_mapping", "run_summary", "conflict_true_counts", "rate_heatmap", "rule_dashboard", "regroup", "missing_make_model_groups", "rate_ingest", "stream_rate_ingest", "renewal_slot_assignment",
         "points_search_report", "eligible_motor_rates", "policy_file_scan", "health_upsert"]
if os.environ.get("ORACLES") == "all":  # takes about twenty minutes
    NAMES = sorted(load()[1])
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_oracle(spark, name):
    assert compare.check(spark, compare.connect(SF), name, SF) == ""


@needs_data
def test_entry_has_rows(spark):
    assert entry_module.entry(spark).limit(1).count() == 1


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
