"""Plan shapes that matter at scale."""

import pytest

import __spark_entry__ as entry
from cohortlane import sized

FOLDER = "/root/testdata/sf0.001"
RELATIONAL = [
    "combination_inventory", "purge_audits", "disjoint_test", "first_per_cluster", "month_folds", "year_folds", "cohort_counts", "protocol_cohorts",
    "auroc_auprc", "ece_sensitivity", "operating_points", "thresholds_m", "thresholds_r", "confusion_rates", "bootstrap_ci", "site_delta",
    "size_matched_rows", "bin_spectrum", "replicate_mean", "presence_qc", "release_checks", "tolerance_regression", "pattern_audit_texts",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_product_and_no_unbounded_window(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if " Window [" in line:
            # Every window has partition columns: the list after the functions is not empty.
            assert "], [], [" not in line, line


def test_date_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["first_per_cluster"](spark, FOLDER))
    assert "o_orderpriority" in plan and "o_totalprice" not in plan.split("ReadSchema")[1].split(">")[0]
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    inventory = plan_of(entry.queries()["combination_inventory"](spark, FOLDER))
    assert "l_quantity" not in inventory and "p_name" not in inventory


def test_score_table_is_shuffled_once(spark):
    df = entry.queries()["auroc_auprc"](spark, FOLDER)
    df.collect()
    assert "ReusedExchange" in plan_of(df)


def test_windowed_cohorts_need_no_shuffle(spark):
    assert "Exchange" not in plan_of(entry.queries()["protocol_cohorts"](spark, FOLDER))


def test_draws_are_not_broadcast(spark):
    plan = plan_of(entry.queries()["bootstrap_ci"](spark, FOLDER))
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert any("slot" in line for line in joins)


def test_collapsed_labels_are_not_dealt_again_for_features(spark):
    plan = plan_of(entry.queries()["collapsed_labels"](spark, FOLDER))
    assert "Join" not in plan.split("Aggregate")[0]


@pytest.mark.parametrize("name", ["presence_qc", "presence_by_semantics", "dense_peaks", "leakage_checks"])
def test_rows_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch, name):
    query = entry.queries()[name]
    before = sorted(map(str, query(spark, FOLDER).collect()))
    monkeypatch.setattr(sized, "TASK_ROWS", 100)
    df = query(spark, FOLDER)
    assert sorted(map(str, df.collect())) == before
    assert "REPARTITION_BY_NUM" in plan_of(df)
