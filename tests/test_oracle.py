"""A spread of registered queries against DuckDB at the smallest scale; tests/check_oracle.py runs all of them."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.check_oracle import compare, database

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_event_effect", "io7_fingerprint_audit", "pf8_text_funnel", "j1_many_to_one_enrichment", "j5_asof_both_ways", "w3_strict_rolling", "w7_frozen_sensor", "w9_gap_profile",
    "a2_group_quantiles", "a6_daily_event_rollup", "a17_error_metrics", "ts2_interpolate_forward", "ts6_imputation_policy", "ce3_master_calendar", "ce10_cross_source_duplicates",
    "rs4_correlation_pairs", "an5_autocorrelation", "an7_band_shares", "an12_spill_over", "st3_mann_whitney", "st11_diebold_mariano", "fe3_fit_params_by_fold", "fe10_fold_safe_blocks",
    "ml6_persistence_baseline", "ml14_shortlist", "ex1_stratified_sample", "ex5_importance",
]


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    assert not compare(spark, con, FOLDER, name).startswith("FAIL")


def test_contract():
    names = set(contract.queries())
    assert set(contract.oracle_sql()) <= names and contract.FLAGSHIP in names
