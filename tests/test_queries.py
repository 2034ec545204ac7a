"""Registered queries against their SQL texts. ALL_QUERIES=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from catalog.compare import connect, differences

CORE = """study_sizes time_and_pay session_times participants_within_setting prediction_summary long_pairs threshold_match
metric_bundle_by_type metric_pairs_by_type auc_by_setting beat_model perceived_vs_real_correlation confidence_shares
kruskal_perceived_by_confidence gap_given_model_accuracy rank_sum_by_bin influence_by_sign revision_stats revision_matrix
spearman_use_influence score_bands inconsistency_by_second thresholded_vs_binary time_concentration rank_by_correct
length_effect sampled_participant_boxes chisq_calibration_bins item_influence decision_matrix charge_table density_grid
histogram_event_value box_stats describe_with_missing arm_text_table""".split()

NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def duck(sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    assert differences(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name]) is None


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.oracle_sql())


def test_entry(spark, sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() == 12


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["metric_bundle_by_setting", "revision_stats", "gap_given_model_accuracy", "score_bands", "charge_table"])
def test_plans_stay_in_the_engine(spark, duck, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in text


def test_scans_read_only_the_columns_used(spark, duck, sf_dir):
    text = plan(entry.queries()["unassisted_baseline"](spark, sf_dir))
    assert "l_shipdate" not in text and "l_extendedprice" not in text and "o_totalprice" not in text
