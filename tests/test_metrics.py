import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlane.operators import metrics as M
from cohortlane.operators.ranked import exact_quantiles, running_totals, score_table

rng = random.Random(11)
GROUPS = {
    "tied": [(rng.randrange(2), round(rng.random(), 1)) for _ in range(400)],
    "fine": [(int(rng.random() < 0.3), rng.random()) for _ in range(300)],
    "narrow": [(int(rng.random() < 0.5), 0.001 + 1e-7 * rng.randrange(1000)) for _ in range(300)],
    "edges": [(rng.randrange(2), k / 10) for k in range(11) for _ in range(6)],
}


@pytest.fixture(scope="module")
def df(spark):
    rows = [(g, y, p) for g, items in GROUPS.items() for y, p in items] + [("single", 1, 0.2), ("single", 1, 0.4)]
    return spark.createDataFrame(rows, "task string, y int, score double")


def arrays(group):
    y, p = zip(*GROUPS[group], strict=True)
    return np.array(y), np.array(p, float)


def auroc(y, p):
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


def average_precision(y, p):
    total = 0.0
    for s in np.unique(p)[::-1]:
        hit = p >= s
        total += y[p == s].sum() / y.sum() * y[hit].mean()
    return total


def ece(y, p, bins=10):
    edges, error = np.linspace(0, 1, bins + 1), 0.0
    for i in range(bins):
        mask = (p >= edges[i]) & ((p < edges[i + 1]) if i < bins - 1 else (p <= 1))
        if mask.any():
            error += mask.mean() * abs(y[mask].mean() - p[mask].mean())
    return error


def test_score_metrics_against_brute_force(df):
    rows = {r.task: r for r in M.score_metrics(df, ["task"]).collect()}
    for g in GROUPS:
        y, p = arrays(g)
        r = rows[g]
        assert math.isclose(r.auroc, auroc(y, p), abs_tol=1e-12)
        assert math.isclose(r.auprc, average_precision(y, p), abs_tol=1e-12)
        assert math.isclose(r.brier, ((p - y) ** 2).mean(), abs_tol=1e-12)
        assert math.isclose(r.ece, ece(y, p), abs_tol=1e-12)
        assert math.isclose(r.auprc_lift, average_precision(y, p) / y.mean(), abs_tol=1e-9)
    assert rows["single"].auroc is None and rows["single"].auprc is None and rows["single"].brier is not None


def test_separate_calibration_error_agrees(df):
    a = {r.task: (r.brier, r.ece) for r in M.score_metrics(df, ["task"]).collect()}
    for r in M.calibration_error(df, ["task"]).collect():
        assert a[r.task] == pytest.approx((r.brier, r.ece), abs=1e-12)


def test_running_totals_with_next(df):
    leaf = score_table(df, ["task"])
    got = {(r.task, r.score): r for r in running_totals(leaf, ["task"], with_next=True).collect()}
    for g in GROUPS:
        y, p = arrays(g)
        scores = np.unique(p)[::-1]
        for i, s in enumerate(scores):
            r = got[(g, float(s))]
            assert (r.above_pos, r.above_neg) == ((y[p > s] == 1).sum(), (y[p > s] == 0).sum())
            assert (r["_next"]["at"] if r["_next"] else None) == (float(scores[i + 1]) if i + 1 < len(scores) else None)


def test_same_for_any_partitioning(df):
    one = sorted(map(tuple, M.score_metrics(df.coalesce(1), ["task"]).collect()))
    many = sorted(map(tuple, M.score_metrics(df.repartition(8), ["task"]).collect()))
    assert [r[0] for r in one] == [r[0] for r in many]
    for a, b in zip(one, many, strict=True):
        assert all(x == y or math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a[1:], b[1:], strict=True) if x is not None)


def test_exact_quantiles(df):
    leaf = df.groupBy("task", "score").agg(F.count(F.lit(1)).alias("n"))
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in exact_quantiles(leaf, ["task"], "score", "n", qs).collect():
        if r.task in GROUPS:
            assert r.quantiles == pytest.approx(list(np.quantile(arrays(r.task)[1], qs)), abs=1e-12)


def right_closed_ece(y, p, bins, strategy):
    if strategy == "equal_width":
        edges = np.linspace(0, 1, bins + 1)
    else:
        edges = np.quantile(p, np.linspace(0, 1, bins + 1))
        edges[0], edges[-1] = 0, 1
        edges = np.unique(edges)
    where = np.clip(np.digitize(p, edges[1:-1], right=True), 0, len(edges) - 2)
    return sum((where == b).mean() * abs(y[where == b].mean() - p[where == b].mean()) for b in np.unique(where))


def test_ece_sensitivity(spark, df):
    extra = spark.createDataFrame([("broken", 1, float("nan")), ("broken", 0, 0.5)], df.schema)
    rows = M.ece_sensitivity(df.unionByName(extra), ["task"]).collect()
    assert not [r for r in rows if r.task == "broken"]
    for r in rows:
        if r.task in GROUPS:
            assert math.isclose(r.ece, right_closed_ece(*arrays(r.task), r.bin_n, r.strategy), abs_tol=1e-9)


def test_thresholds_on_the_small_example(spark):
    small = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1], [0.05, 0.2, 0.4, 0.6, 0.8, 0.95])), "y int, score double").withColumn("task", F.lit("t"))
    r = M.thresholds_by_points(M.operating_points(small, ["task"]), ["task"]).first()
    assert (r.youden, r.sensitivity90, r.specificity90) == (0.6, 0.6, 0.6)
    r = M.thresholds_by_roc(small, ["task"]).first()
    assert (r.youden, r.sens90, r.spec90) == (0.6, 0.6, 0.6)


def roc_policy(y, p):
    scores = np.unique(p)[::-1]
    tp = np.array([((p >= s) & (y == 1)).sum() for s in scores])
    fp = np.array([((p >= s) & (y == 0)).sum() for s in scores])
    keep = np.r_[True, (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0), True] if len(scores) > 2 else np.ones(len(scores), bool)
    s, tpr, fpr = scores[keep], tp[keep] / (y == 1).sum(), fp[keep] / (y == 0).sum()
    spec = 1 - fpr
    a, b = np.flatnonzero(tpr >= 0.9), np.flatnonzero(spec >= 0.9)
    return (s[np.argmax(tpr - fpr)], s[a[np.argmax(spec[a])]], s[b[np.argmax(tpr[b])]] if len(b) else p.max() + 1e-9)


def test_threshold_policies_against_brute_force(df):
    by_roc = {r.task: (r.youden, r.sens90, r.spec90) for r in M.thresholds_by_roc(df, ["task"]).collect()}
    by_points = {r.task: (r.youden, r.sensitivity90, r.specificity90) for r in M.thresholds_by_points(M.operating_points(df, ["task"]), ["task"]).collect()}
    assert "single" not in by_roc and "single" not in by_points
    for g in GROUPS:
        y, p = arrays(g)
        assert by_roc[g] == pytest.approx(roc_policy(y, p), abs=1e-12)
        t = np.unique(np.r_[0.0, p, 1.0, np.nextafter(1, 2)])
        sens = np.array([((p >= x) & (y == 1)).sum() / (y == 1).sum() for x in t])
        spec = np.array([((p < x) & (y == 0)).sum() / (y == 0).sum() for x in t])
        j = sens + spec - 1
        assert by_points[g] == (t[np.flatnonzero(j == j.max())[-1]], t[sens >= 0.9].max(), t[spec >= 0.9].min())


def test_fixed_threshold_rates(spark):
    rows = spark.createDataFrame([("t", y, p) for y, p in zip([0, 0, 1, 1], [0.1, 0.7, 0.6, 0.9])], "task string, y int, score double")
    cut = spark.createDataFrame([("t", "x", 0.65), ("t", "none", 2.0)], "task string, threshold_name string, threshold double")
    got = {r.threshold_name: r for r in M.confusion_rates(rows, cut, ["task"]).collect()}
    assert (got["x"].sensitivity, got["x"].specificity) == (0.5, 0.5)
    assert got["none"].ppv is None and got["none"].npv == 0.5


def test_calibration_line_reaches_the_optimum(df):
    for r in M.calibration_line(df, ["task"]).collect():
        if r.task == "single":
            assert r.slope is None
            continue
        y, p = arrays(r.task)
        x = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
        mu = 1 / (1 + np.exp(-(r.slope * x + r.intercept)))
        gradient = np.array([((mu - y) * x).sum() + 1e-6 * r.slope, (mu - y).sum()])
        assert np.abs(gradient).max() < 1e-5, r.task


def test_inverted_scores_fail_the_guard(spark):
    rows = spark.createDataFrame([("t", i % 2, 0.8 - 0.5 * (i % 2) + 0.01 * (i % 7)) for i in range(80)] , "task string, y int, score double")
    noisy = rows.unionByName(spark.createDataFrame([("t", 1, 0.85), ("t", 0, 0.3)], rows.schema))
    fit = M.guarded_platt(noisy, ["task"])
    r = fit.first()
    assert r.platt_slope < 0 and (r.calibration_status, r.calibration_failure_reason) == ("failed", "nonpositive_platt_slope")
    assert M.apply_platt(noisy, fit, ["task"]).where("calibrated_probability is not null").count() == 0


def test_bundle_has_all_columns_without_calibration(df):
    b = M.metric_bundle(df.withColumn("c", F.lit(None).cast("double")), ["task"], raw="score", calibrated="c")
    assert {"raw_auroc", "calibrated_auroc", "calibrated_ece", "threshold_metrics_valid"} <= set(b.columns)
    assert all(r.calibrated_auroc is None and not r.threshold_metrics_valid for r in b.collect())


def test_precision_flags(spark):
    rows = [(150, 50, 100, 0.6, 0.9), (150, 50, 100, 0.7, 0.8), (50, 20, 30, 0.1, 0.9)]
    got = [r.precision_flag for r in M.precision_flags(spark.createDataFrame(rows, "n_test long, positive_n long, negative_n long, raw_auroc_ci_low double, raw_auroc_ci_high double")).collect()]
    assert got == ["wide_95pct_interval_over_0.20", "interval_width_at_or_below_0.20", "insufficient_class_support"]
