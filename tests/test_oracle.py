"""Registered queries against DuckDB at sf0.01; all of them with ORACLE_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.01"
QUICK = [
    "encode_label", "case_label", "ordinal_codes", "static_view", "filter_cases", "temporal_split", "val_split_random",
    "stratified_folds", "every_nth_case", "pos_length_quantile", "case_length", "generate_prefixes_gap", "bucket_prefix_length",
    "encode_agg", "encoded_with_label", "log_statistics", "trace_variants", "profile_top_values", "derive_time_features",
    "cramers_v", "mutual_info_neighbours", "iqr_range", "auc_by_prefix", "best_params", "ale", "permutation_importance",
    "shap_local", "lime_stability", "compare_trials_boosted", "nearest_farthest", "timing_by_model",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUICK) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else QUICK)
def test_query(spark, con, name):
    problem, n = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None and n > 0


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "encoded_label" in df.columns
