"""Registered queries against their SQL in DuckDB. FOLDWRIGHT_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "agg1_auc", "agg2_slice_auc", "agg5_kendall_tau_b", "agg12_binary_calibration", "agg21_world_posterior", "agg25_run_scorecard", "agg26_population_block",
    "agg42_leave_one_domain_out", "joi4_fold_safe_entity_aggregates", "joi5_strictly_earlier_history", "joi9_oof_honesty", "joi12_matched_negative_gate",
    "mlj1_simplex_blend_crossfit", "mlj3_histogram_calibration", "prj1_missing_profile", "prj16_token_leak_scan", "res4_matched_null_shuffle", "spl2_group_folds",
    "spl3_time_folds", "spl8_crossfit_plan", "src9_submission_validate", "str3_run_state_fold", "str7_token_budget_gate", "top1_utility_score", "top3_cell_elites",
    "win1_average_rank", "win8_hash_chain_verify", "win9_stagnation_runs",
)
NAMES = sorted(contract.oracle_sql()) if os.environ.get("FOLDWRIGHT_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, connection, name):
    line, _ = compare(name, spark, connection, FOLDER, contract.queries()[name], contract.oracle_sql()[name])
    assert line.startswith("match"), line


def test_entry_runs(spark):
    assert set(contract.entry(spark).columns) == {"lang", "n", "positives", "auc"}


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
