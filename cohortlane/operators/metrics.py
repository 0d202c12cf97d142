"""Evaluation metrics for any grouping: ranking, calibration error, thresholds, confusion rates.

All functions take a long table with a score in [0, 1] and a 0/1 label and return one row per
group (or group and threshold). A value that cannot be estimated is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.columns import clipped_logit, count_true, ratio, sigmoid
from cohortlane.operators.ranked import exact_quantiles, running_totals, score_table
from cohortlane.session import cut_lineage
from cohortlane.sized import checked_broadcast

THRESHOLD_NAMES = ("youden", "sensitivity90", "specificity90")
TARGET_RATE = 0.90
ABOVE_ONE = float(np.nextafter(1.0, 2.0))


def both_classes() -> Column:
    return (F.col("total_pos") > 0) & (F.col("total_neg") > 0)


def metrics_from_totals(ranked: DataFrame, keys: Sequence[str], score: str = "score", bins: int = 10) -> DataFrame:
    """Every score metric of a group in one pass over its running totals.

    AUROC counts ties half; AUPRC is average precision. A first aggregation per calibration bin
    carries the sums of all metrics, a second over at most ``bins`` rows finishes them.
    """
    keys = list(keys)
    below_neg = F.col("total_neg") - F.col("above_neg") - F.col("neg")
    pairs = F.col("pos") * (below_neg + F.col("neg") / 2)
    tp = F.col("above_pos") + F.col("pos")
    gain = ratio("pos", "total_pos") * ratio(tp, tp + F.col("above_neg") + F.col("neg"))
    p = F.col(score)
    per_bin = ranked.groupBy(*keys, left_closed_bin(p, equal_width_edges(bins)).alias("_bin")).agg(
        F.max("total_pos").alias("total_pos"), F.max("total_neg").alias("total_neg"),
        F.sum(pairs).alias("pairs"), F.sum(F.when(F.col("pos") > 0, gain).otherwise(0.0)).alias("ap"),
        F.sum("pos").alias("pos"), F.sum((F.col("pos") + F.col("neg")) * p).alias("wp"),
        F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p).alias("wb"),
    )
    out = per_bin.groupBy(*keys).agg(
        F.max("total_pos").alias("total_pos"), F.max("total_neg").alias("total_neg"),
        F.sum("pairs").alias("pairs"), F.sum("ap").alias("ap"), F.sum("wb").alias("wb"),
        F.sum(F.abs(F.col("pos") - F.col("wp"))).alias("gap"),
    )
    n = F.col("total_pos") + F.col("total_neg")
    auprc, baseline = F.when(both_classes(), F.col("ap")), ratio("total_pos", n)
    return out.select(
        *keys,
        F.col("total_pos").alias("positive_n"), F.col("total_neg").alias("negative_n"),
        F.when(both_classes(), ratio("pairs", F.col("total_pos").cast("double") * F.col("total_neg"))).alias("auroc"),
        auprc.alias("auprc"), baseline.alias("auprc_baseline"), F.try_divide(auprc, baseline).alias("auprc_lift"),
        ratio("wb", n).alias("brier"), ratio("gap", n).alias("ece"),
    )


def score_metrics(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """AUROC, AUPRC with baseline and lift, Brier score and ECE per group."""
    leaf = score_table(df, keys, score, y, weight)
    return metrics_from_totals(running_totals(leaf, keys, score), keys, score)


def equal_width_edges(bins: int) -> list[float]:
    """The bin edges as the floating-point values of an evenly spaced grid."""
    return [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]


def left_closed_bin(p: Column, edges: Sequence[float]) -> Column:
    """Bin ``[lo, hi)`` of an edge list, the last bin closed; edges are compared as they are."""
    inner = [F.when(p >= F.lit(e), 1).otherwise(0) for e in edges[1:-1]]
    return sum(inner, F.lit(0))


def calibration_error(
    df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y", weight: str | None = None, bins: int = 10
) -> DataFrame:
    """Brier score and equal-width ECE. One aggregation per (group, bin), one over at most ``bins`` rows."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    p, label = F.col(score), F.col(y).cast("double")
    per_bin = df.groupBy(*keys, left_closed_bin(p, equal_width_edges(bins)).alias("_bin")).agg(
        F.sum(w).alias("w"), F.sum(w * label).alias("wy"), F.sum(w * p).alias("wp"),
        F.sum(w * (p - label) * (p - label)).alias("wb"),
    )
    return per_bin.groupBy(*keys).agg(
        F.try_divide(F.sum("wb"), F.sum("w")).alias("brier"),
        F.try_divide(F.sum(F.abs(F.col("wy") - F.col("wp"))), F.sum("w")).alias("ece"),
    )


def ece_sensitivity(
    df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y", bin_counts: Sequence[int] = (5, 10)
) -> DataFrame:
    """ECE with right-closed bins, equal width and equal frequency, for several bin counts.

    Groups with a missing or non-finite score are left out. Quantile edges are exact and come from
    running counts; the edge table (one row per group and bin count) is joined after a size check.
    """
    keys = list(keys)
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    leaf = df.groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).cast("bigint").alias("pos"), F.max(bad).alias("_bad")
    )
    skipped = checked_broadcast(leaf.where("_bad").select(*keys).distinct())
    leaf = leaf.where(~F.col("_bad")).drop("_bad").join(skipped, keys, "left_anti")

    width = F.array(*[
        F.struct(F.lit(b).alias("bin_n"), F.lit("equal_width").alias("strategy"),
                 F.array(*[F.lit(e) for e in equal_width_edges(b)]).alias("edges"))
        for b in bin_counts
    ])
    points = [float(q) for b in bin_counts for q in np.linspace(0.0, 1.0, b + 1)[1:-1]]
    found = exact_quantiles(leaf, keys, score, "n", points)
    frequency, start = [], 1
    for b in bin_counts:
        inner = F.slice("quantiles", start, b - 1)
        edges = F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0)))))
        frequency.append(F.struct(F.lit(b).alias("bin_n"), F.lit("equal_frequency").alias("strategy"), edges.alias("edges")))
        start += b - 1
    table = checked_broadcast(found.select(*keys, F.explode(F.concat(width, F.array(*frequency))).alias("e")).select(*keys, "e.*"))
    inner_edges = F.slice("edges", 2, F.size("edges") - 2)
    bin_index = F.size(F.filter(inner_edges, lambda e: F.col(score) > e))
    group = [*keys, "bin_n", "strategy"]
    per_bin = leaf.join(table, keys).groupBy(*group, bin_index.alias("_bin")).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("n") * F.col(score)).alias("wp")
    )
    return per_bin.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("positive_n"), F.sum(F.col("n") - F.col("pos")).alias("negative_n"),
        F.try_divide(F.sum(F.abs(F.col("pos") - F.col("wp"))), F.sum("n")).alias("ece"),
    )


def operating_points(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """All operating points per two-class group: thresholds 0, every score, 1 and just above 1.

    ``tp`` and ``fp`` count the rows with a score at or above the threshold.
    """
    ranked = running_totals(score_table(df, keys, score, y), keys, score).where(both_classes())
    seen = ranked.select(
        *keys, F.col(score).alias("threshold"), (F.col("above_pos") + F.col("pos")).alias("tp"),
        (F.col("above_neg") + F.col("neg")).alias("fp"), "total_pos", "total_neg",
    )
    groups = ranked.groupBy(*keys).agg(
        F.max("total_pos").alias("total_pos"), F.max("total_neg").alias("total_neg"),
        *[F.sum(F.when(F.col(score) == 1.0, F.col(c)).otherwise(0)).alias(f"one_{c}") for c in ("pos", "neg")],
    )
    fixed = F.array(
        F.struct(F.lit(0.0).alias("threshold"), F.col("total_pos").alias("tp"), F.col("total_neg").alias("fp")),
        F.struct(F.lit(1.0).alias("threshold"), F.col("one_pos").alias("tp"), F.col("one_neg").alias("fp")),
        F.struct(F.lit(ABOVE_ONE).alias("threshold"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp")),
    )
    ends = groups.select(*keys, F.explode(fixed).alias("f"), "total_pos", "total_neg").select(*keys, "f.*", "total_pos", "total_neg")
    points = seen.where((F.col("threshold") != 0.0) & (F.col("threshold") != 1.0)).unionByName(ends)
    return points.select(
        *keys, "threshold", "tp", "fp", "total_pos", "total_neg",
        ratio("tp", "total_pos").alias("sensitivity"),
        ratio(F.col("total_neg") - F.col("fp"), "total_neg").alias("specificity"),
    )


def thresholds_by_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Policy over all operating points: highest Youden (ties: highest threshold), highest threshold
    with sensitivity >= 0.9, lowest threshold with specificity >= 0.9."""
    youden = F.col("sensitivity") + F.col("specificity") - 1.0
    t = F.col("threshold")
    return points.groupBy(*keys).agg(
        F.max(F.struct(youden.alias("j"), t.alias("t")))["t"].alias("youden"),
        F.max(F.when(F.col("sensitivity") >= TARGET_RATE, t)).alias("sensitivity90"),
        F.min(F.when(F.col("specificity") >= TARGET_RATE, t)).alias("specificity90"),
    )


def roc_vertices(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Points of the ROC curve, one per distinct score, without interior collinear points.

    A point lies inside a straight piece if the step to it and the step from it have the same
    positive and negative counts. The first and the last point always stay.
    """
    ranked = running_totals(score_table(df, keys, score, y), keys, score, with_next=True)
    same_step = (F.col("_next.pos") == F.col("pos")) & (F.col("_next.neg") == F.col("neg"))
    interior = F.col("_next").isNotNull() & (F.col("above_pos") + F.col("above_neg") > 0) & same_step
    return ranked.where(both_classes() & ~F.coalesce(interior, F.lit(False))).select(
        *keys, F.col(score).alias("threshold"),
        ratio(F.col("above_pos") + F.col("pos"), "total_pos").alias("tpr"),
        ratio(F.col("above_neg") + F.col("neg"), "total_neg").alias("fpr"),
    )


def thresholds_by_roc(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Policy over ROC vertices: first highest Youden; best specificity with tpr >= 0.9 (first);
    best tpr with specificity >= 0.9 (first). "First" is the highest threshold.

    Without a qualifying vertex the cut lies just outside the observed scores.
    """
    points = roc_vertices(df, keys, score, y)
    t, tpr, fpr = F.col("threshold"), F.col("tpr"), F.col("fpr")
    specificity = 1.0 - fpr
    best = lambda value, ok: F.max(F.when(ok, F.struct(value.alias("v"), t.alias("t"))))["t"]
    picked = points.groupBy(*keys).agg(
        F.max(F.struct((tpr - fpr).alias("v"), t.alias("t")))["t"].alias("youden"),
        best(specificity, tpr >= TARGET_RATE).alias("sens90"),
        best(tpr, specificity >= TARGET_RATE).alias("spec90"),
    )
    span = df.groupBy(*keys).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    return picked.join(span, list(keys)).select(
        *keys, "youden",
        F.coalesce("sens90", F.col("_low") - 1e-9).alias("sens90"),
        F.coalesce("spec90", F.col("_high") + 1e-9).alias("spec90"),
    )


def long_thresholds(wide: DataFrame, keys: Sequence[str], names: Sequence[str] = THRESHOLD_NAMES) -> DataFrame:
    return wide.unpivot(list(keys), list(names), "threshold_name", "threshold").where(F.col("threshold").isNotNull())


def confusion_rates(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Rates of each group at thresholds chosen elsewhere; ``thresholds`` is (keys, threshold_name, threshold).

    The threshold table (a few rows per group) is joined after a size check.
    """
    keys = list(keys)
    joined = df.select(*keys, F.col(score).alias("_p"), F.col(y).alias("_y")).join(checked_broadcast(thresholds), keys)
    predicted, positive = F.col("_p") >= F.col("threshold"), F.col("_y") == 1
    cells = joined.groupBy(*keys, "threshold_name", "threshold").agg(
        count_true(predicted & positive).alias("tp"), count_true(~predicted & ~positive).alias("tn"),
        count_true(predicted & ~positive).alias("fp"), count_true(~predicted & positive).alias("fn"),
    )
    return add_rates(cells)


def add_rates(cells: DataFrame) -> DataFrame:
    total = lambda a, b: F.col(a) + F.col(b)
    sensitivity, specificity = ratio("tp", total("tp", "fn")), ratio("tn", total("tn", "fp"))
    return cells.select(
        "*", sensitivity.alias("sensitivity"), specificity.alias("specificity"),
        ratio("tp", total("tp", "fp")).alias("ppv"), ratio("tn", total("tn", "fn")).alias("npv"),
        (1 - sensitivity).alias("false_susceptible_rate"), (1 - specificity).alias("false_resistant_rate"),
    )


# --- calibration -------------------------------------------------------------------------------

NEWTON_STEPS = 25
PRIOR_PRECISION = 1e-6
GROUPS_AT_ONCE = 20_000


def logistic_fit(df: DataFrame, keys: Sequence[str], x: Column, y: str = "y", weight: str | None = None) -> DataFrame:
    """Slope and intercept of y on one predictor per group, by Newton steps on aggregated sums.

    Rows are reduced to (group, x, pos, neg) once and stored. Every step is one aggregation of six
    sums per group for all groups together; the driver solves 2x2 systems, one per group. More than
    ``GROUPS_AT_ONCE`` groups are fitted in several rounds. The slope has a weak ridge penalty.
    Groups of one class give NULL. ``converged`` tells whether the last step was below 1e-10.
    """
    keys = list(keys)
    w = F.lit(1) if weight is None else F.col(weight)
    points = cut_lineage(
        df.groupBy(*keys, x.alias("_x")).agg(
            F.sum(F.when(F.col(y) == 1, w).otherwise(0)).cast("double").alias("_pos"),
            F.sum(F.when(F.col(y) == 0, w).otherwise(0)).cast("double").alias("_neg"),
        )
    )
    groups = points.groupBy(*keys).agg(F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg"))
    rounds = -(-groups.count() // GROUPS_AT_ONCE)
    part = F.pmod(F.xxhash64(*keys), F.lit(max(rounds, 1)))
    fits = [_newton(points.where(part == i), groups.where(part == i), keys) for i in range(max(rounds, 1))]
    result = fits[0]
    for fit in fits[1:]:
        result = result.unionByName(fit)
    return groups.select(*keys).join(result, keys, "left")


def _newton(points: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    spark = points.sparkSession
    wide = lambda *names: groups.select(*keys, *[F.lit(0.0).alias(n) for n in names]).schema
    current = {
        tuple(r[k] for k in keys): np.array([0.0, float(np.log(r["pos"] / r["neg"]))])
        for r in groups.where((F.col("pos") > 0) & (F.col("neg") > 0)).collect()
    }
    fitted: dict[tuple, np.ndarray] = {}
    last: dict[tuple, tuple[float, np.ndarray]] = {}
    for _ in range(NEWTON_STEPS):
        if not current:
            break
        rows = [(*k, float(b[0]), float(b[1])) for k, b in current.items()]
        parameters = spark.createDataFrame(rows, wide("_b", "_a"))
        eta = F.col("_b") * F.col("_x") + F.col("_a")
        mu, n = sigmoid(eta), F.col("_pos") + F.col("_neg")
        residual, curvature = n * mu - F.col("_pos"), n * mu * (1 - mu)
        softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        sums = points.join(F.broadcast(parameters), keys).groupBy(*keys).agg(
            F.sum(residual * F.col("_x")).alias("g1"), F.sum(residual).alias("g0"),
            F.sum(curvature * F.col("_x") * F.col("_x")).alias("h11"), F.sum(curvature * F.col("_x")).alias("h10"),
            F.sum(curvature).alias("h00"), F.sum(n * softplus - F.col("_pos") * eta).alias("loss"),
        )
        for r in sums.collect():
            key = tuple(r[k] for k in keys)
            b = current[key]
            loss = r["loss"] + 0.5 * PRIOR_PRECISION * b[0] ** 2
            if key in last:
                before, step = last[key]
                if loss > before + 1e-12 * abs(before) and np.abs(step).max() > 1e-12:
                    # The step went too far: go back half of it.
                    last[key] = (before, step / 2)
                    current[key] = b + step / 2
                    continue
            hessian = np.array([[r["h11"] + PRIOR_PRECISION, r["h10"]], [r["h10"], r["h00"]]])
            step = np.linalg.lstsq(hessian, np.array([r["g1"] + PRIOR_PRECISION * b[0], r["g0"]]), rcond=None)[0]
            last[key] = (loss, step)
            current[key] = b - step
            if np.abs(step).max() < 1e-10:
                fitted[key] = current.pop(key)
    rows = [(*k, float(b[0]), float(b[1]), done) for found, done in ((fitted, True), (current, False)) for k, b in found.items()]
    return spark.createDataFrame(rows, wide("slope", "intercept").add("converged", "boolean"))


def calibration_line(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Calibration slope and intercept: y on the clipped logit of the score."""
    return logistic_fit(df, keys, clipped_logit(score), y)


def guarded_platt(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y", *, on_logit: bool = True) -> DataFrame:
    """Platt parameters with an explicit guard: a slope that is not finite or not positive, or a fit without convergence, fails."""
    fit = logistic_fit(df, keys, clipped_logit(score) if on_logit else F.col(score), y)
    finite = F.col("slope").isNotNull() & ~F.isnan("slope") & (F.abs("slope") < float("inf"))
    status = F.when(~finite | (F.col("slope") <= 0) | ~F.col("converged"), "failed").otherwise("ok")
    reason = F.when(~finite, "nonfinite_platt_slope").when(F.col("slope") <= 0, "nonpositive_platt_slope").when(~F.col("converged"), "not_converged").otherwise("")
    return fit.select(
        *keys, F.col("slope").alias("platt_slope"), F.col("intercept").alias("platt_intercept"),
        status.alias("calibration_status"), reason.alias("calibration_failure_reason"),
    )


def apply_platt(df: DataFrame, parameters: DataFrame, keys: Sequence[str], score: str = "score", *, on_logit: bool = True) -> DataFrame:
    """Add ``calibrated_probability``; NULL where the calibration failed its guard. The raw score stays."""
    x = clipped_logit(score) if on_logit else F.col(score)
    joined = df.join(checked_broadcast(parameters), list(keys), "left")
    value = F.when(F.col("calibration_status") == "ok", sigmoid(F.col("platt_slope") * x + F.col("platt_intercept")))
    return joined.select(*df.columns, value.alias("calibrated_probability"))


def metric_bundle(
    df: DataFrame, keys: Sequence[str], *, raw: str = "raw_probability", calibrated: str | None = "calibrated_probability",
    y: str = "y", thresholds: DataFrame | None = None, calibration: bool = False,
) -> DataFrame:
    """All metrics of a group in one wide row; every column is present, NULL where not valid.

    Raw and calibrated scores are stacked so that one plan ranks both.
    """
    keys = list(keys)
    kinds = [("raw", raw)] + ([("calibrated", calibrated)] if calibrated else [])
    stacked = df.select(
        *keys, F.col(y).alias("y"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("score")) for k, c in kinds])).alias("s"),
    ).select(*keys, "y", "s.kind", "s.score")
    # A group whose calibrated score is missing anywhere has no calibrated metrics.
    gaps = stacked.where(F.col("score").isNull()).select(*keys, "kind").distinct()
    stacked = stacked.join(checked_broadcast(gaps), [*keys, "kind"], "left_anti")
    parts = score_metrics(stacked, [*keys, "kind"])
    names = ["auroc", "auprc", "auprc_lift", "brier", "ece"]
    if calibration:
        parts = parts.join(calibration_line(stacked, [*keys, "kind"]).drop("converged"), [*keys, "kind"], "left")
        parts = parts.withColumnsRenamed({"slope": "calibration_slope", "intercept": "calibration_intercept"})
        names += ["calibration_slope", "calibration_intercept"]
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}")
    wide = parts.groupBy(*keys).agg(
        F.max("positive_n").alias("positive_n"), F.max("negative_n").alias("negative_n"), F.max("auprc_baseline").alias("auprc_baseline"),
        *[pick(kind, c) for kind in ("raw", "calibrated") for c in names],
    )
    if thresholds is None or not calibrated:
        return wide.withColumn("threshold_metrics_valid", F.lit(False))
    rates = confusion_rates(df.where(F.col(calibrated).isNotNull()), thresholds, keys, calibrated, y)
    fields = ["threshold", "sensitivity", "specificity", "ppv", "npv", "false_susceptible_rate", "false_resistant_rate"]
    flat = rates.groupBy(*keys).agg(*[
        F.max(F.when(F.col("threshold_name") == n, F.col(f))).alias(f"{f}_{n}") for n in THRESHOLD_NAMES for f in fields
    ])
    valid = F.col("calibrated_auroc").isNotNull() & F.col("threshold_youden").isNotNull()
    joined = wide.join(flat, keys, "left").withColumn("threshold_metrics_valid", valid)
    blank = [c for c in flat.columns if c not in keys]
    return joined.select(*[F.when(valid, F.col(c)).alias(c) if c in blank else F.col(c) for c in joined.columns])


def guarded_rows(counts: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cohort counts with metrics where the support is adequate; other cohorts stay, with status and reason."""
    values = [c for c in metrics.columns if c not in (*keys, "positive_n", "negative_n")]
    joined = counts.join(metrics.select(*keys, *values), list(keys), "left")
    ok = F.col("support_status") == "adequate"
    return joined.select(
        *counts.columns, *[F.when(ok, F.col(v)).alias(v) for v in values], F.when(ok, "ok").otherwise(F.col("support_status")).alias("status")
    )


def precision_flags(metrics: DataFrame, *, n: str = "n_test", low: str = "raw_auroc_ci_low", high: str = "raw_auroc_ci_high") -> DataFrame:
    """Interval width, minimum-support flag and precision flag; insufficient support wins."""
    width = F.col(high) - F.col(low)
    met = (F.col(n) >= 100) & (F.least("positive_n", "negative_n") >= 20)
    return metrics.select(
        "*", width.alias("raw_auroc_ci_width"), met.alias("minimum_support_met"),
        F.when(met, "prespecified_support_adequate").otherwise("insufficient_support").alias("support_classification"),
        F.when(~met, "insufficient_class_support").when(width > 0.20, "wide_95pct_interval_over_0.20")
        .otherwise("interval_width_at_or_below_0.20").alias("precision_flag"),
    )
