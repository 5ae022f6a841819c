"""Registered queries against their SQL on the smallest folder; a spread of them, the tool runs all."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SPREAD = [
    "read_quotes", "validate_all", "request_contract", "fn_parse_basket", "asof_join", "asof_join_events", "rolling_history", "feature_table",
    "temporal_split_fallback", "rolling_audit", "target_distribution", "categorical_mix", "unseen_categories", "numeric_drift", "categorical_drift",
    "spearman", "selection_bias", "baseline_group_median", "prep_ordinal", "weighted_fold_mae", "bootstrap_blocks", "conformal_calibrate", "ood_flags",
    "coverage_check", "score_postprocess", "pruning_candidates",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return connect(FOLDER)


@pytest.mark.parametrize("name", SPREAD)
def test_query_matches_sql(spark, con, name):
    status, _, _, detail = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", detail


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert "realized_vol_63d_mean" in frame.columns and frame.limit(1).count() == 1
