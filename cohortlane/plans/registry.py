"""Named queries over the given tables; each takes a session and the table folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.functions import columns as X
from cohortlane.functions.identity import map_alias, normalize_identity
from cohortlane.operators import bootstrap as B
from cohortlane.operators import cohorts as C
from cohortlane.operators import compare as R
from cohortlane.operators import contracts as K
from cohortlane.operators import features as S
from cohortlane.operators import joins as J
from cohortlane.operators import labels as L
from cohortlane.operators import metrics as M
from cohortlane.operators import models as N
from cohortlane.operators import run_plan as P
from cohortlane.operators import sampling as Z
from cohortlane.plans import views as V
from cohortlane.plans.audit import collapsed_with_features, label_audit
from cohortlane.session import cut_lineage
from cohortlane.sized import dealt, spread
from cohortlane.sources.artifacts import PRIVATE_PATTERNS, artifact_manifest, pattern_audit, verify_manifest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED = 20260815
REPLICATES = 1000
BY_TASK = ["task"]
BY_SITE = ["task", "site_id"]
SCOPE = {"sites": ("A", "B"), "year_min": 1995, "year_max": 2001}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Round DOUBLE results so that the order of additions does not show.

    Values are moved off the half-way points first, which engines round in different directions.
    """
    nudge = 1.3e-9 if digits == 6 else 0.0
    return df.select(*[F.round(F.col(c) + nudge, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def scoped(spark: SparkSession, sf: str) -> DataFrame:
    return L.normalize_labels(L.scope_labels(V.ast_labels(spark, sf), **SCOPE))


def collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return collapsed_with_features(V.ast_labels(spark, sf), V.samples(spark, sf), V.LABEL_ORDER, **SCOPE)


# --- label audit -------------------------------------------------------------------------------

@query
def scope_normalized_labels(spark, sf):
    return scoped(spark, sf).select(
        "site_id", "sample_id", "year", "organism_key", "code_key", "name_key", "identity_complete", "combination_id",
        "sir_normalized", "source_conflict", "core_task_id",
        X.binary_endpoint("sir_normalized").alias("y_s_vs_ir"), X.binary_endpoint("sir_normalized", positive=("R",)).alias("y_si_vs_r"),
    )


@query
def collapsed_labels(spark, sf):
    return collapsed(spark, sf)


@query
def combination_inventory(spark, sf):
    return rounded(L.combination_inventory(collapsed(spark, sf), L.SupportThresholds()), ["positive_rate"])


@query
def support_funnel(spark, sf):
    return label_audit(V.ast_labels(spark, sf), V.samples(spark, sf), V.LABEL_ORDER, V.PANEL, **SCOPE).funnel


@query
def panel_mapping(spark, sf):
    return L.panel_mapping(L.combination_inventory(collapsed(spark, sf), L.SupportThresholds()), V.PANEL, "no documented rationale")


@query
def label_agreement(spark, sf):
    """Second label system: part of the rows uninterpreted, some recategorised, some without a binary value."""
    key = F.col("l_orderkey")
    sir = F.when(F.col("l_returnflag") == "N", "S").when(F.col("l_returnflag") == "A", "I").otherwise("R")
    other = F.when(key % 13 == 0, "").when(key % 7 == 0, "R").otherwise(sir)
    rows = V.table(spark, sf, "lineitem").select(
        F.concat(F.lit("supp_"), F.col("l_suppkey") % 10).alias("task_id"), sir.alias("historical_sir"), other.alias("harmonized_sir"),
        F.when(sir == "S", 0.0).otherwise(1.0).alias("historical_y"),
        F.when(key % 11 == 0, None).when(other == "S", 0.0).otherwise(1.0).alias("harmonized_y"),
        (F.when(key % 17 != 0, sir != other)).alias("reclassified"),
    )
    return rounded(L.label_agreement(rows), ["binary_agreement", "exact_agreement"])


@query
def alias_mapped(spark, sf):
    spellings = ("Cefepime", "  cefepime\t", "头孢吡肟", "ＣＥＦＥＰＩＭＥ", "Ceftazidime", "ceftazidime-avibactam", "头孢吡肟（马斯平）", "Gentamicin", "")
    pick = F.element_at(F.array(*[F.lit(s) for s in spellings]), (F.col("p_partkey") % len(spellings) + 1).cast("int"))
    rows = V.table(spark, sf, "part").select("p_partkey", pick.alias("reported"))
    return normalize_identity(rows, {"reported": "identity"}).select("p_partkey", "identity", map_alias("identity").alias("canonical"))


@query
def feature_available(spark, sf):
    """The three kinds of availability columns side by side."""
    key = F.col("sample_id")
    rows = V.samples(spark, sf).select(
        "sample_id", "feature_row", (F.when(key % 5 != 0, key % 3 == 0)).alias("flag"),
        F.element_at(F.array(*[F.lit(v) for v in ("yes", " No ", "", "0", "ready")]), (key % 5 + 1).cast("int")).alias("text"),
    )
    kinds = rows.schema
    return rows.select(
        "sample_id", *[X.availability_flag(c, kinds[c].dataType).alias(f"by_{c}") for c in ("feature_row", "flag", "text")],
        X.conflict_flag("text", kinds["text"].dataType).alias("conflict_text"), X.conflict_flag("feature_row", kinds["feature_row"].dataType).alias("conflict_number"),
    )


@query
def seeds(spark, sf):
    return V.table(spark, sf, "customer").select(
        "c_custkey", X.derived_seed(SEED, F.lit("analysis"), "c_custkey", "c_mktsegment").alias("seed"),
        X.combination_id("c_mktsegment", "c_name").alias("combination"),
    )


@query
def canonical_parameters(spark, sf):
    """Parameter JSON with sorted keys and the run note of each supplier row."""
    return V.table(spark, sf, "supplier").select(
        "s_suppkey", X.canonical_json(penalty=F.lit("l2"), C=F.col("s_nationkey").cast("int"), max_iter=F.lit(5000)).alias("parameters"),
        F.concat(F.lit("run_"), "s_name").alias("run_id"),
    )


# --- cohorts -----------------------------------------------------------------------------------

@query
def protocol_cohorts(spark, sf):
    return C.assign_windows(V.samples(spark, sf), V.DATES.protocols()).select("cohort", "role", "task", "sample_id", "d", "y")


@query
def regime_cohorts(spark, sf):
    return C.assign_windows(V.samples(spark, sf), V.DATES.regimes()).select("cohort", "role", "task", "sample_id", "d", "y")


@query
def protocols_disjoint(spark, sf):
    """One check for each protocol: rows that stand in its development and its test."""
    return C.windows_disjoint(V.samples(spark, sf), V.DATES.protocols())


@query
def date_window(spark, sf):
    orders = V.table(spark, sf, "orders")
    dates = C.normalize_dates(orders.select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_orderdate").cast("string").alias("accept_datetime"),
        F.concat(F.lit(" "), "o_custkey", F.lit(" ")).alias("cluster_id"),
    ))
    target = V.samples(spark, sf).select("sample_id", "task", "cluster_id")
    return C.filter_dates(C.attach_dates(target, dates), date(2000, 2, 1), date(2000, 6, 30), "target_date")


@query
def purge_audits(spark, sf):
    """Removal audit of the later test under the three purge modes."""
    base = V.samples(spark, sf)
    parts = [
        C.purge_audit(C.mark_purge(V.development(base), V.test_rows(base), BY_TASK, mode=mode), BY_TASK).withColumn("mode", F.lit(mode))
        for mode in ("strict", "annual", "simple")
    ]
    return K.all_checks(parts)


@query
def disjoint_test(spark, sf):
    base = V.samples(spark, sf)
    return C.purge(V.development(base), V.test_rows(base), mode="strict").select("sample_id", "cluster_id", "task", "d", "y")


@query
def first_per_cluster(spark, sf):
    rows = V.development(V.samples(spark, sf)).select("cluster_id", "sample_id", "d", "task", "y")
    return C.first_per_cluster(rows, ["d", "sample_id"])


@query
def latest_per_cluster(spark, sf):
    base = V.samples(spark, sf).where(X.usable("cluster_id")).select("task", "cluster_id", "sample_id", "d")
    return C.keep_extreme(base, ["task", "cluster_id"], ["d", "sample_id"], last=True)


def month_folds_of(spark: SparkSession, sf: str) -> DataFrame:
    return C.month_fold_rows(V.development(V.samples(spark, sf)).select("task", "sample_id", "cluster_id", "d", "y"))


@query
def first_per_cluster_protocol(spark, sf):
    """One record per cluster in every monthly fold and in the development/test pair (fold -1)."""
    base = V.samples(spark, sf).select("task", "sample_id", "cluster_id", "d", "y")
    folds = month_folds_of(spark, sf).select("task", "fold_index", "split", "sample_id", "cluster_id", "d", "y")
    whole = V.development(base).withColumn("split", F.lit("train")).unionByName(V.test_rows(base).withColumn("split", F.lit("validation")))
    rows = folds.unionByName(whole.withColumn("fold_index", F.lit(-1)).select(*folds.columns))
    keys = ["task", "fold_index"]
    _, _, audit = C.one_record_per_cluster(
        rows.where(F.col("split") == "train").drop("split"), rows.where(F.col("split") == "validation").drop("split"), keys, ["d", "sample_id"]
    )
    adequate = C.fold_adequate(("train_n", "train_positive_n", "train_negative_n"),
                               ("evaluation_n", "evaluation_positive_n", "evaluation_negative_n"), C.LARGE_FOLD)
    return audit.withColumn("status", F.when(adequate, "adequate").otherwise("insufficient"))


@query
def month_folds(spark, sf):
    return C.month_fold_audit(V.development(V.samples(spark, sf))).select(
        "task", *long("border_index"), "fold_note", "n_train", "train_positive_n", "train_negative_n",
        "n_validation", "validation_positive_n", "validation_negative_n", "adequate",
    )


@query
def month_fold_rows(spark, sf):
    return month_folds_of(spark, sf).select("task", *long("fold_index"), "fold_note", "split", "sample_id", "y")


@query
def year_folds(spark, sf):
    return C.year_fold_audit(V.samples(spark, sf))


@query
def year_fold_rows(spark, sf):
    base = V.samples(spark, sf)
    return C.year_fold_rows(base, C.year_fold_audit(base)).select("task", *long("fold_index"), "split", "sample_id", "y")


@query
def history_folds(spark, sf):
    """Folds of the current era from a fold table, without and with the earlier era in training."""
    base = V.samples(spark, sf).select("task", "sample_id", "cluster_id", "d", "y")
    current = base.where(F.col("d").between(F.lit(V.DATES.current_start), F.lit(V.DATES.current_end)))
    pre = base.where(F.col("d") < F.lit(V.DATES.transition_start))
    table = C.month_fold_rows(current).select("task", "fold_index", "sample_id", "split")
    parts = [
        C.fold_table_with_history(base, table, history)[1].withColumn("regime", F.lit(regime))
        for regime, history in (("current_workflow_only", None), ("pooled_pre_and_current", pre))
    ]
    return K.all_checks(parts).withColumn("fold_index", F.col("fold_index").cast("bigint"))


@query
def cohort_counts(spark, sf):
    cohorts = C.assign_windows(V.samples(spark, sf), V.DATES.protocols())
    return rounded(C.cohort_counts(cohorts, ["cohort", "role", "task", "site_id"]), ["positive_rate"])


@query
def support_status(spark, sf):
    """The three support vocabularies on small groups of very different size."""
    groups = V.samples(spark, sf).groupBy("task", (F.col("sample_id") % 97).alias("cell")).agg(
        X.count_true(F.col("y") == 1).alias("p"), X.count_true(F.col("y") == 0).alias("q")
    ).withColumn("n", F.col("p") + F.col("q"))
    out = groups
    for mode in ("graded", "annual", "contract"):
        status, reason = C.support_status(mode, F.col("n"), F.col("p"), F.col("q"), 30, 8)
        out = out.withColumn(f"{mode}_status", status).withColumn(f"{mode}_reason", reason)
    return out


@query
def row_ordinal(spark, sf):
    return R.row_ordinal(V.samples(spark, sf).select("task", "sample_id", "d"), BY_TASK, "d", "sample_id")


@query
def group_attach(spark, sf):
    """Group rows for one task only (odd samples) and for every task (NULL or blank task)."""
    base = V.samples(spark, sf)
    key = F.col("sample_id")
    groups = base.where(key % 7 != 0).select(
        "sample_id", F.when(key % 2 == 1, F.col("task")).when(key % 3 == 0, "").alias("task"), F.concat(F.lit("g"), key % 50).alias("cluster_id"),
        F.concat(F.lit("e"), key % 20).alias("episode_id"),
    )
    return C.attach_groups(base.select("sample_id", "task", "y"), groups)


@query
def episode_first_rows(spark, sf):
    flagged = V.samples(spark, sf).withColumn("episode_first", F.when(F.col("sample_id") % 6 != 0, F.col("sample_id") % 4 == 1))
    return C.episode_first(flagged).select("sample_id", "cluster_id", "task")


def eras(spark: SparkSession, sf: str) -> DataFrame:
    """Pools of the two eras with usable clusters, test era excluded."""
    before, now = F.col("d") < F.lit(V.DATES.transition_start), F.col("d").between(F.lit(V.DATES.current_start), F.lit(V.DATES.current_end))
    base = V.samples(spark, sf).where(X.usable("cluster_id") & (before | now))
    era = F.when(before, Z.PRE_ERA).otherwise(Z.CURRENT_ERA)
    return base.select("task", "sample_id", "cluster_id", "y", "d", era.alias("era"))


@query
def class_caps(spark, sf):
    return Z.class_caps(eras(spark, sf))


@query
def size_matched_rows(spark, sf):
    cells = Z.size_matched_cells(eras(spark, sf), repeats=2, seed=SEED)
    return cells.select("task", *long("repeat_index"), "learning_fraction", "training_regime", "era", "y", "sample_id")


@query
def size_matched_cells(spark, sf):
    audit = Z.cell_audit(Z.size_matched_cells(eras(spark, sf), repeats=3, seed=SEED))
    return audit.withColumn("repeat_index", F.col("repeat_index").cast("bigint"))


# --- features ----------------------------------------------------------------------------------

@query
def bin_spectrum(spark, sf):
    return rounded(S.bin_spectra(V.peaks(spark, sf)), ["value"])


@query
def replicate_mean(spark, sf):
    return rounded(S.replicate_mean(S.bin_spectra(V.peaks(spark, sf)), V.spectra(spark, sf)), ["value"])


@query
def peak_presence(spark, sf):
    return S.presence(S.bin_spectra(V.peaks(spark, sf)), "spectrum_id")


@query
def sample_presence(spark, sf):
    return S.sample_presence(S.bin_spectra(V.peaks(spark, sf)), V.spectra(spark, sf))


@query
def replicate_statistics(spark, sf):
    return S.spectra_per_sample(V.spectra(spark, sf))


@query
def presence_qc(spark, sf):
    """Presence from peaks above two intensity cuts against presence from all peaks."""
    peaks = dealt(V.peaks(spark, sf), "spectrum_id")
    frozen = S.presence(S.bin_spectra(peaks), "spectrum_id")
    cuts = F.explode(F.array(*[F.struct(F.lit(f"above_{c}").alias("variant"), F.lit(float(c)).alias("cut")) for c in (5, 25)]))
    kept = peaks.select("*", cuts.alias("c")).where(F.col("intensity") > F.col("c.cut"))
    axis = S.BinAxis()
    observed = kept.where(axis.covers(F.col("mz"))).select("c.variant", "spectrum_id", axis.bin(F.col("mz")).alias("bin"))
    rows = V.spectra(spark, sf).select(
        F.explode(F.array(F.lit("above_5"), F.lit("above_25"))).alias("variant"), "spectrum_id"
    )
    summary = S.presence_summary(S.presence_overlap(observed, frozen, rows, "spectrum_id"))
    return rounded(summary, ["detected_median", "detected_q25", "detected_q75", "exact_match_rate", "jaccard_median"])


@query
def feature_equivalence(spark, sf):
    """Rebuilt sample features against a released single-precision copy with a few disturbed rows."""
    rebuilt = S.replicate_mean(S.bin_spectra(V.peaks(spark, sf)), V.spectra(spark, sf))
    disturbed = F.when(F.col("sample_id") % 50 == 3, F.col("value") + 0.001).otherwise(F.col("value"))
    released = rebuilt.select("sample_id", "bin", disturbed.cast("float").alias("value"))
    rows = V.spectra(spark, sf).select("sample_id").distinct()
    return rounded(S.equivalence_summary(S.feature_equivalence(rebuilt, released, rows, "sample_id")), ["max_abs_difference"])


@query
def matrix_scan(spark, sf):
    items = V.table(spark, sf, "lineitem").select(
        "l_linestatus", (F.col("l_quantity") > 25).cast("int").alias("a"),
        F.when(F.col("l_orderkey") % 400 == 0, 2).otherwise(F.col("l_linenumber") % 2).alias("b"),
        F.when(F.col("l_orderkey") % 900 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("c"),
    )
    return K.binary_scan(items, ["a", "b", "c"], ["l_linestatus"])


@query
def dense_peaks(spark, sf):
    return S.profile_presence(V.profiles(spark, sf))


@query
def dense_variants(spark, sf):
    """All extraction variants in one pass and their agreement with the default extraction."""
    points = V.profiles(spark, sf)
    bins = cut_lineage(S.profile_presence(points, S.PROFILE_VARIANTS))  # the extraction feeds both sides below
    default = bins.where(F.col("variant") == "public_rebuild_default").drop("variant")
    names = F.explode(F.array(*[F.lit(n) for n in S.PROFILE_VARIANTS]))
    rows = V.profile_list(spark, sf).select(names.alias("variant"), "spectrum_id")
    return rounded(S.presence_summary(S.presence_overlap(bins, default, rows, "spectrum_id")), ["exact_match_rate", "jaccard_median"])


@query
def presence_by_semantics(spark, sf):
    spectra = V.profile_list(spark, sf).withColumn(
        "source_semantics", F.when(F.col("spectrum_id") % 2 == 0, S.PEAK_LIST).otherwise(S.DENSE_PROFILE)
    )
    return S.presence_by_semantics(V.profiles(spark, sf), spectra)


# --- evaluation --------------------------------------------------------------------------------

METRIC_COLUMNS = ["auroc", "auprc", "auprc_baseline", "auprc_lift", "brier", "ece"]


@query
def auroc_auprc(spark, sf):
    return rounded(M.score_metrics(V.samples(spark, sf), BY_SITE, "raw"), METRIC_COLUMNS).drop("brier", "ece")


@query
def brier_ece(spark, sf):
    return rounded(M.calibration_error(V.samples(spark, sf), BY_SITE, "calibrated"), ["brier", "ece"])


@query
def ece_sensitivity(spark, sf):
    out = rounded(M.ece_sensitivity(V.samples(spark, sf), BY_SITE, "raw"), ["ece"])
    return out.withColumn("bin_n", F.col("bin_n").cast("bigint"))


@query
def operating_points(spark, sf):
    points = M.operating_points(V.samples(spark, sf), BY_TASK, "raw")
    return rounded(points, ["sensitivity", "specificity"]).drop("total_pos", "total_neg")


@query
def thresholds_m(spark, sf):
    return M.thresholds_by_points(M.operating_points(V.samples(spark, sf), BY_SITE, "raw"), BY_SITE)


@query
def thresholds_r(spark, sf):
    return rounded(M.thresholds_by_roc(V.samples(spark, sf), BY_SITE, "alt"), ["youden", "sens90", "spec90"], 9)


def source_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds chosen on the development rows of the first site."""
    source = V.development(V.samples(spark, sf)).where(F.col("site_id") == "A")
    return M.long_thresholds(M.thresholds_by_points(M.operating_points(source, BY_TASK, "calibrated"), BY_TASK), BY_TASK)


RATES = ["sensitivity", "specificity", "ppv", "npv", "false_susceptible_rate", "false_resistant_rate"]


@query
def confusion_rates(spark, sf):
    rates = M.confusion_rates(V.test_rows(V.samples(spark, sf)), source_thresholds(spark, sf), BY_TASK, "calibrated")
    return rounded(rates, ["threshold", *RATES])


@query
def metric_bundle(spark, sf):
    bundle = M.metric_bundle(
        V.test_rows(V.samples(spark, sf)), BY_TASK, raw="raw", calibrated="calibrated", thresholds=source_thresholds(spark, sf)
    )
    return rounded(bundle, [c for c, t in bundle.dtypes if t == "double"])


@query
def guarded_rows(spark, sf):
    """Metrics only where the support is adequate; small cells stay with their status."""
    cells = V.test_rows(V.samples(spark, sf)).withColumn("cell", F.when(F.col("sample_id") % 40 == 0, "small").otherwise("large"))
    keys = ["task", "cell"]
    out = M.guarded_rows(C.cohort_counts(cells, keys), M.score_metrics(cells, keys, "raw"), keys)
    return rounded(out, ["positive_rate", *METRIC_COLUMNS])


@query
def bootstrap_ci(spark, sf):
    out = B.bootstrap_intervals(V.samples(spark, sf), BY_TASK, ["raw", "alt"], replicates=REPLICATES, seed=SEED)
    return rounded(out, ["ci_low", "ci_high", "bootstrap_median"])


@query
def site_delta(spark, sf):
    out = B.site_differences(
        V.samples(spark, sf), BY_TASK, ["raw"], site="site_id", source="A", target="B", replicates=REPLICATES, seed=SEED
    )
    return rounded(out, ["source_estimate", "target_estimate", "delta_target_minus_source", "ci_low", "ci_high", "bootstrap_median"])


@query
def paired_delta(spark, sf):
    """Three regimes of predictions of the same test rows, aligned first."""
    regimes = ("current", "pre", "pooled")
    rows = V.test_rows(V.samples(spark, sf)).where(X.usable("cluster_id")).select(
        "task", "sample_id", "cluster_id", "y",
        F.explode(F.create_map(F.lit("current"), F.col("raw"), F.lit("pre"), F.col("alt"), F.lit("pooled"), F.col("calibrated") * F.col("alt"))).alias("regime", "score"),
    )
    aligned = R.align_regimes(rows, ["task", "sample_id", "cluster_id", "y"], "regime", regimes, "score")
    out = B.paired_differences(aligned, BY_TASK, regimes, "current", replicates=REPLICATES, seed=SEED)
    return rounded(out, ["delta_comparator_minus_reference", "ci_low", "ci_high", "bootstrap_median"])


@query
def median_transport(spark, sf):
    out = B.median_transport(
        V.samples(spark, sf), task="task", site="site_id", source="A", target="B", score="raw", task_n=5, replicates=REPLICATES, seed=SEED
    )
    return rounded(out, ["estimate", "ci_low", "ci_high", "bootstrap_median"])


@query
def precision_flags(spark, sf):
    """Precision flags of monthly cells, with a width from a normal approximation of the AUROC error."""
    cells = V.samples(spark, sf).withColumn("cell", F.date_format("d", "yyyy-MM"))
    scores = M.score_metrics(cells, ["task", "cell"], "raw").where(F.col("auroc").isNotNull())
    n = F.col("positive_n") + F.col("negative_n")
    half = F.lit(1.0) / F.sqrt(F.least("positive_n", "negative_n").cast("double"))
    table = scores.select(
        "task", "cell", n.alias("n_test"), "positive_n", "negative_n", F.col("auroc").alias("raw_auroc"),
        (F.col("auroc") - half).alias("raw_auroc_ci_low"), (F.col("auroc") + half).alias("raw_auroc_ci_high"),
    )
    return rounded(M.precision_flags(table), ["raw_auroc", "raw_auroc_ci_low", "raw_auroc_ci_high", "raw_auroc_ci_width"])


# --- selection, sampling comparisons, regression ------------------------------------------------

@query
def tuning_selection(spark, sf):
    """Candidates are powers of two scores over yearly folds; the best one per task is picked."""
    base = V.samples(spark, sf)
    candidates = F.posexplode(F.array("raw", "alt", "calibrated", F.col("raw") * F.col("alt"))).alias("candidate_index", "score")
    rows = base.select("task", F.col("year").alias("fold_index"), "y", candidates)
    keys = ["task", "candidate_index", "fold_index"]
    best = R.best_candidate(R.tuning_summary(M.score_metrics(rows, keys), BY_TASK), BY_TASK)
    out = rounded(best, ["median_auroc", "median_auprc", "objective"])
    return out.withColumn("candidate_index", F.col("candidate_index").cast("bigint"))


@query
def delta_summary(spark, sf):
    """Scores of repeats, each with more of a second score, on one fixed test, compared between regimes and summarised."""
    base = V.test_rows(V.samples(spark, sf))
    score = {Z.REGIMES[0]: F.col("raw"), Z.REGIMES[1]: F.col("alt"), Z.REGIMES[2]: F.col("raw") * F.col("alt")}
    parts = F.explode(F.array(*[F.struct(F.lit(r).alias("training_regime"), s.alias("score")) for r, s in score.items()]))
    repeats = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("repeat_index")
    rows = base.select("task", "sample_id", "y", "alt", parts.alias("p"), repeats)
    keys = ["task", "repeat_index", "training_regime"]
    score = F.col("p.score") * F.lit(0.5) + F.col("alt") * F.col("repeat_index") * F.lit(0.125)
    scores = M.score_metrics(rows.select("task", "repeat_index", "y", "p.training_regime", score.alias("score")), keys)
    metrics = scores.select(
        *keys, F.lit(1.0).alias("learning_fraction"), F.lit("ok").alias("status"), F.lit("fixed").alias("fixed_test_signature"),
        (F.col("positive_n") + F.col("negative_n")).alias("n_test"), F.lit(100).alias("n_development"),
        F.lit(50).alias("development_positive_n"), F.lit(50).alias("development_negative_n"),
        F.col("auroc").alias("raw_auroc"), F.col("auprc").alias("raw_auprc"),
    )
    out = Z.summarize_deltas(Z.paired_deltas(metrics))
    return rounded(out, ["delta_mean", "delta_median", "delta_sd", "repeat_distribution_q025", "repeat_distribution_q975"])


@query
def regime_summary(spark, sf):
    """Median metrics by protocol cohort over tasks with adequate support."""
    cohorts = C.assign_windows(V.samples(spark, sf), V.DATES.protocols()).where(F.col("role") == "test")
    keys = ["cohort", "task", "site_id"]
    scores = M.guarded_rows(C.cohort_counts(cohorts, keys), M.score_metrics(cohorts, keys, "raw"), keys)
    ok = scores.where(F.col("status") == "ok").groupBy("cohort", "site_id").agg(
        F.count_distinct("task").alias("task_n"), F.median("auroc").alias("median_auroc"), F.median("auprc").alias("median_auprc")
    )
    return rounded(ok, ["median_auroc", "median_auprc"])


@query
def tolerance_regression(spark, sf):
    """Yearly metrics against a disturbed copy: a count off by one, a metric off, a missing value, a missing key."""
    scores = M.score_metrics(V.samples(spark, sf), ["task", "year"], "raw").select(
        "task", "year", "positive_n", "negative_n", "auroc", "brier", F.concat(F.lit("note_"), F.col("year")).alias("note")
    )
    frozen = scores.where(F.col("year") != 1995).select(
        "task", "year", (F.col("positive_n") + F.when(F.col("year") == 1996, 1).otherwise(0)).alias("positive_n"), "negative_n",
        (F.col("auroc") + F.when(F.col("year") == 1997, 1e-3).otherwise(0.0)).alias("auroc"),
        F.when(F.col("year") != 1998, F.col("brier")).alias("brier"),
        F.when(F.col("year") == 1999, "other").otherwise(F.col("note")).alias("note"),
    )
    out = R.tolerance_regression(
        scores, frozen, ["task", "year"], metrics=["auroc", "brier"], counts=["positive_n", "negative_n"], texts=["note"],
        corrected=(F.col("field") == "positive_n") & (F.col("year") == 1996),
    )
    finite = F.when(F.col("absolute_difference") < float("inf"), F.col("absolute_difference")).otherwise(-1.0)
    out = out.withColumn("absolute_difference", F.when(F.col("absolute_difference").isNotNull(), finite))
    return rounded(out, ["frozen_value", "reproduced_value", "absolute_difference"]).drop("tolerance")


@query
def calibration_parameters(spark, sf):
    """Evaluation rows joined to one parameter row per task; repeated parameter rows are reduced first."""
    parameters = V.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("task"), F.round("s_acctbal", 2).alias("platt_slope"), F.col("s_suppkey").alias("line")
    )
    one = C.keep_extreme(parameters, ["task"], ["line"]).select("task", "platt_slope")
    rows = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("task"), F.col("n_name").alias("cohort_id"))
    return rows.join(one, "task", "left")


# --- checks and artifacts ----------------------------------------------------------------------

@query
def release_checks(spark, sf):
    """Release checks on labels per (sample, combination) with deliberately broken splits."""
    base = V.samples(spark, sf)
    labels = base.select("site_id", "sample_id", "task", "sir", "y")
    tasks = base.where(F.col("task") != "5-LOW").select("task").distinct()
    splits = base.select(
        F.lit("p").alias("protocol"), "site_id", "task", F.when(F.col("sample_id") % 500 == 0, F.col("sample_id") + 1).otherwise(F.col("sample_id")).alias("sample_id"),
        F.when(F.col("sample_id") % 700 == 0, "holdout").when(F.col("year") < 2000, "train").otherwise("test").alias("split"),
    )
    return K.release_checks(base.select("site_id", "sample_id", "feature_row"), labels, tasks, splits)


@query
def leakage_checks(spark, sf):
    base = V.samples(spark, sf)
    folds = month_folds_of(spark, sf).select("task", "fold_index", "split", "sample_id", "cluster_id", "y")
    evaluation = base.where((F.col("d") >= F.lit(date(1999, 12, 20))))
    return K.development_contract(V.development(base), folds, evaluation, sample_n=base.count())


@query
def label_sample_join(spark, sf):
    """Every label row with the feature row of its sample; both must exist."""
    labels = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_linenumber", F.col("l_returnflag").alias("category"))
    return J.many_to_one(labels, V.samples(spark, sf).select("sample_id", "site_id", "feature_row"), ["sample_id"])


@query
def score_pairs(spark, sf):
    """Two scores of the same test rows, joined one to one."""
    base = V.test_rows(V.samples(spark, sf))
    return J.one_to_one(base.select("task", "sample_id", "raw"), base.select("task", "sample_id", "alt"), ["task", "sample_id"])


@query
def split_rows(spark, sf):
    """Labels of the rows that a split table lists."""
    base = V.samples(spark, sf)
    splits = base.where(F.col("year") >= 1998).select("task", "sample_id", F.when(F.col("year") < 2000, "train").otherwise("test").alias("split"))
    return J.split_join(base.select("task", "sample_id", "y", "d"), splits, ["task", "sample_id"])


@query
def join_findings(spark, sf):
    """What the join checks report: samples without labels, labels of unknown samples, repeated keys."""
    labels = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"))
    known = V.samples(spark, sf).where(F.col("sample_id") % 97 != 0).select("sample_id")
    return K.all_checks([J.join_checks(labels, known, ["sample_id"], "m:1", "labels"), J.join_checks(labels.distinct(), V.samples(spark, sf).select("sample_id"), ["sample_id"], "1:1", "samples")])


@query
def union_of_parts(spark, sf):
    """Rows of two sources with different columns, one row per key."""
    base = V.samples(spark, sf)
    return J.union_parts([base.where("site_id = 'A'").select("task", "sample_id", "raw"), base.where("site_id = 'B'").select("task", "sample_id", "alt")], ["task", "sample_id"])


@query
def contiguous_rows(spark, sf):
    rows = V.samples(spark, sf).select("task", "sample_id", "d")
    numbered = R.row_ordinal(rows, BY_TASK, "d", "sample_id")
    broken = numbered.where((F.col("task") != "2-HIGH") | (F.col("row_order") != 7))
    return K.row_numbers_contiguous(broken, "row_order", "task", "row_numbers")


@query
def preflight(spark, sf):
    """Findings with a JSON detail: date coverage, purge audit and support per task."""
    base = V.samples(spark, sf)
    marked = C.mark_purge(V.development(base), V.test_rows(base), BY_TASK, mode="strict")
    audit = C.purge_audit(marked, BY_TASK)
    detail = F.to_json(F.struct(*[F.col(c) for c in sorted(audit.columns) if c != "insufficient_reason"]))
    purge = audit.select(F.lit("test_disjoint_support").alias("gate"), "task", F.col("purge_status").alias("status"), detail.alias("detail"))
    counts = C.cohort_counts(C.assign_windows(base, V.DATES.protocols()), ["cohort", "role", "task"])
    support = counts.select(
        F.concat(F.lit("cohort_support:"), "cohort", F.lit(":"), "role").alias("gate"), "task",
        F.when(F.col("support_status") == "adequate", "PASS").otherwise("WARN").alias("status"), F.col("insufficient_reason").alias("detail"),
    )
    missing = base.where(F.col("site_id") == "B").join(
        V.table(spark, sf, "orders").where(F.month("o_orderdate") != 2).select(F.col("o_orderkey").alias("sample_id")), "sample_id", "left_anti"
    )
    coverage = missing.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("target_date_coverage").alias("gate"), F.lit("ALL").alias("task"), F.when(F.col("n") == 0, "PASS").otherwise("WARN").alias("status"),
        F.concat(F.lit("labelled_samples_without_target_date="), F.col("n")).alias("detail"),
    )
    return K.all_checks([purge, support, coverage])


@query
def task_support(spark, sf):
    """Minimum support of a task: 100/20 in development, 30/10 in the test; failing tasks stay as rows."""
    base = V.samples(spark, sf)
    parts = []
    for role, rows, total, minimum in (("development", V.development(base), 100, 20), ("test", V.test_rows(base), 30, 10)):
        counts = C.class_counts(rows, BY_TASK)
        status, reason = C.support_status("annual", F.col("n"), F.col("positive_n"), F.col("negative_n"), total, minimum)
        parts.append(counts.select(F.lit(role).alias("role"), "*", status.alias("status"), reason.alias("reason")))
    return K.all_checks(parts)


@query
def membership_hash(spark, sf):
    rows = V.samples(spark, sf)
    return R.membership_digest(rows, ["task", "year"], ["sample_id", "cluster_id", "y"], "d", "sample_id")


@query
def fold_hash(spark, sf):
    """Digest of the fold membership of each task."""
    return R.fold_digest(month_folds_of(spark, sf), BY_TASK)


@query
def membership_hash_large(spark, sf):
    """Digest of whole tasks, above the size that is hashed as one text."""
    return R.tree_digest(V.samples(spark, sf), ["site_id"], R.row_text(["sample_id", "cluster_id", "y"], "|"))


# the fixed patterns, and two that occur in the given texts
TEXT_PATTERNS = PRIVATE_PATTERNS | {"email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+", "digit_groups": r"[0-9]{3}-[0-9]{3,4}"}


@query
def pattern_audit_texts(spark, sf):
    documents = pattern_audit(spread(V.table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", TEXT_PATTERNS).select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("row_id"), "pattern", "match_n"
    )
    pages = pattern_audit(spread(V.table(spark, sf, "pages").select("page_id", "html")), "page_id", "html", TEXT_PATTERNS).select(
        F.lit("pages").alias("source"), F.col("page_id").alias("row_id"), "pattern", "match_n"
    )
    return documents.unionByName(pages)


@query
def manifest_of_tables(spark, sf):
    return artifact_manifest(spark, sf, "*.parquet")


@query
def manifest_check(spark, sf):
    """The manifest of the table folder checked against itself with one changed and one absent entry."""
    files = artifact_manifest(spark, sf, "*.parquet")
    expected = files.select("relative_path", F.when(F.col("relative_path") == "part.parquet", "0").otherwise(F.col("sha256")).alias("sha256"))
    found = files.where(F.col("relative_path") != "nation.parquet")
    return verify_manifest(found, expected)


@query
def calibration_slope(spark, sf):
    return rounded(M.calibration_line(V.samples(spark, sf), BY_SITE, "raw"), ["slope", "intercept"])


@query
def platt_calibration(spark, sf):
    """Platt parameters fitted on development rows, guarded, and applied to the test rows."""
    base = V.samples(spark, sf)
    fitted = M.guarded_platt(V.development(base), BY_TASK, "raw")
    scored = M.apply_platt(V.test_rows(base), fitted, BY_TASK, "raw")
    return rounded(
        scored.groupBy("task").agg(
            F.count(F.lit(1)).alias("n"), F.count("calibrated_probability").alias("calibrated_n"), F.avg("calibrated_probability").alias("mean_probability")
        ).join(fitted, "task"),
        ["mean_probability", "platt_slope", "platt_intercept"],
    )


# --- models ------------------------------------------------------------------------------------

def embedding_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Development, folds, test and features of the embedding table: block f validates after blocks < f."""
    rows = V.embeddings(spark, sf)
    base = rows.drop("values")
    development = base.where(F.col("block") < 4)
    fold = F.explode(F.array(*[F.lit(f) for f in (1, 2, 3)])).alias("fold_index")
    folds = development.select("task", "sample_id", "y", "block", fold).where(F.col("block") <= F.col("fold_index")).withColumn(
        "split", F.when(F.col("block") < F.col("fold_index"), "train").otherwise("validation")
    ).drop("block")
    test = base.where(F.col("block") == 4).withColumn("cohort_id", F.lit("test"))
    return development.drop("block"), folds, test.drop("block"), rows.select("sample_id", "values")


@query
def logistic_tuned(spark, sf):
    """Scores of all logistic candidates on all folds."""
    _, folds, _, values = embedding_tables(spark, sf)
    learner = N.LogisticLearner()
    return N.tune(folds, N.as_sparse(values), learner, learner.grid(), SEED)[0]


@query
def logistic_protocol(spark, sf):
    """Tune, out-of-fold scores, Platt, thresholds, refit and the metric bundle of the test cohort."""
    development, folds, test, values = embedding_tables(spark, sf)
    run = N.run_protocol(development, folds, test, N.as_sparse(values), N.LogisticLearner(), SEED, policy="roc")
    return N.evaluate_run(run, calibration=True)


@query
def logistic_intervals(spark, sf):
    """Bootstrap intervals of the bundle, raw and calibrated, of all test rows and of entity-disjoint rows."""
    development, folds, test, values = embedding_tables(spark, sf)
    run = N.run_protocol(development, folds, test, N.as_sparse(values), N.LogisticLearner(), SEED, fixed={"emb": {"C": 0.1, "class_weight": None}})
    run.predictions = run.predictions.unionByName(N.disjoint_predictions(run, development).withColumn("cohort_id", F.lit("test_disjoint")))
    return N.interval_table(run, REPLICATES, SEED)


@query
def tree_tuned(spark, sf):
    """All boosted-tree candidates on all folds, with few rounds."""
    _, folds, _, values = embedding_tables(spark, sf)
    learner = N.TreeLearner(rounds=TREE_ROUNDS)
    return N.tune(folds, N.as_vectors(values), learner, learner.grid(), SEED)[1]


TREE_ROUNDS = 5


AXIS = S.BinAxis()  # 6,000 bins, in all runs


def spectrum_features(spark: SparkSession, sf: str) -> DataFrame:
    """Binned spectra (6,000 bins) with the nonzero places of each; every order has a row, also one without a peak."""
    binned = N.G.sparse_from_bins(S.bin_spectra(V.peaks(spark, sf), AXIS), "spectrum_id")
    rows = V.spectra(spark, sf).select("spectrum_id").join(binned, "spectrum_id", "left")
    return rows.select(
        F.col("spectrum_id").alias("sample_id"), F.coalesce("idx", F.array().cast("array<int>")).alias("idx"), F.coalesce("val", F.array().cast("array<double>")).alias("val")
    )


def purged_folds(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Adequate monthly folds of ``rows`` without validation rows of training entities; ``history`` joins every training part."""
    needed = ["task", "sample_id", "cluster_id", "d", "y"]
    everything = rows.select(*needed) if history is None else rows.select(*needed).unionByName(history.select(*needed))
    table = C.month_fold_rows(rows.select(*needed)).select("task", "fold_index", "sample_id", "split")
    folds, audit = C.fold_table_with_history(everything, table, None if history is None else history.select(*needed))
    adequate = audit.where(F.col("status") == "adequate").select("task", "fold_index")
    return folds.join(adequate, ["task", "fold_index"], "left_semi").select("task", "fold_index", "split", "sample_id", "cluster_id", "y")


@query
def source_only_sites(spark, sf):
    """Models of the first site's development rows, evaluated on later rows of both sites.

    Folds and the first site's test are entity-disjoint; calibration uses the raw probability.
    """
    base = V.samples(spark, sf).select("task", "sample_id", "site_id", "cluster_id", "d", "y")
    development = V.development(base).where(F.col("site_id") == "A").drop("site_id")
    later = V.test_rows(base)
    source = C.purge(development, later.where(F.col("site_id") == "A"), BY_TASK).withColumn("cohort_id", F.lit("source"))
    target = later.where(F.col("site_id") == "B").withColumn("cohort_id", F.lit("target"))
    evaluation = source.unionByName(target).drop("site_id", "d")
    run = N.run_protocol(development.drop("d"), purged_folds(development), evaluation, spectrum_features(spark, sf), N.LogisticLearner(dims=AXIS.n_bins), SEED,
                         platt_on_logit=False, disjoint_cohorts=["source"])
    counts = C.cohort_counts(run.predictions, ["task", "cohort_id"])
    return M.guarded_rows(counts, N.evaluate_run(run), ["task", "cohort_id"])


TASKS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query
def size_matched_run(spark, sf):
    """Models of size-matched training cells of three regimes on one entity-disjoint test, compared in pairs: 20 repeats of 4 fractions."""
    pools = eras(spark, sf)
    rows = cut_lineage(Z.sampled_rows(pools, seed=SEED).select("task", "sample_id", "y", "era", "places")).where(F.size("places") > 0)
    audit = cut_lineage(Z.cell_audit(Z.listed_cells(rows)))
    sizes = {(r["task"], r["repeat_index"], r["learning_fraction"], r["training_regime"]): (r["development_negative_n"], r["development_positive_n"]) for r in audit.collect()}
    tasks, places = sorted({k[0] for k in sizes}), Z.cell_places(20)
    named = [(len(places) * t + i, task, *place) for t, task in enumerate(tasks) for i, place in enumerate(places)]
    first = F.create_map(*[F.lit(x) for t, task in enumerate(tasks) for x in (task, len(places) * t)])[F.col("task")]
    members = rows.select("sample_id", "y", F.transform("places", lambda p: p + first).alias("cells"))
    test = cut_lineage(C.purge(pools, V.test_rows(V.samples(spark, sf)), BY_TASK).select("task", "sample_id", "cluster_id", "y"))
    counts = {(task, cell): sizes.get((task, *place), (0, 0)) for cell, task, *place in named}
    scored = N.fit_numbered_cells(members, counts, test, spectrum_features(spark, sf), N.LogisticLearner(dims=AXIS.n_bins), {"C": 0.1, "class_weight": None})
    scores = M.score_metrics(scored.select("cell", "y", "raw_probability"), ["cell"], "raw_probability")
    signature = R.tree_digest(test, BY_TASK, R.row_text(["sample_id", "cluster_id", "y"], "|")).select(
        "task", F.col("tree_sha256").alias("fixed_test_signature"), F.col("n").alias("n_test")
    )
    cells = spark.createDataFrame(named, "cell bigint, task string, repeat_index int, learning_fraction double, training_regime string")
    metrics = cells.join(scores.select("cell", F.col("auroc").alias("raw_auroc"), F.col("auprc").alias("raw_auprc")), "cell").drop("cell").join(
        audit, ["task", "repeat_index", "learning_fraction", "training_regime"]
    ).join(signature, "task")
    return Z.paired_deltas(metrics)


REGIMES = ("pre_marker_history_only", "current_workflow_only", "pooled_pre_and_current")


def regime_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Development and purged folds per training regime, and the common test: entity-disjoint and all rows."""
    base = V.samples(spark, sf).where(X.usable("cluster_id")).select("task", "sample_id", "cluster_id", "d", "y")
    windows = [w for w in V.DATES.regimes() if w.role == "development"]
    training = C.assign_windows(base, windows).select("task", F.col("cohort").alias("training_regime"), "sample_id", "cluster_id", "d", "y").distinct()
    later = V.test_rows(base)
    rows = {r: training.where(F.col("training_regime") == r).drop("training_regime") for r in REGIMES}
    parts = {
        REGIMES[0]: purged_folds(rows[REGIMES[0]]), REGIMES[1]: purged_folds(rows[REGIMES[1]]), REGIMES[2]: purged_folds(rows[REGIMES[1]], rows[REGIMES[0]]),
    }
    folds = K.all_checks([p.withColumn("training_regime", F.lit(r)) for r, p in parts.items()])
    return training.drop("d"), folds, C.purge(training, later, BY_TASK).drop("d"), later.drop("d")


def history_protocol(spark: SparkSession, sf: str) -> N.ProtocolRun:
    """One run over all (task, regime) pairs with fixed parameters: calibration, thresholds and scores of the common test per regime."""
    training, folds, test, _ = regime_tables(spark, sf)
    pair = F.concat_ws("|", "task", "training_regime").alias("task")
    cells = training.select("task", "training_regime").distinct()
    common = test.join(cells, "task").withColumn("cohort_id", F.lit("common_test"))
    fixed = {f"{t}|{r}": {"C": 0.1, "class_weight": None} for t in TASKS for r in REGIMES}
    return N.run_protocol(
        training.select(pair, "sample_id", "cluster_id", "y"), folds.select(pair, "fold_index", "split", "sample_id", "cluster_id", "y"),
        common.select(pair, "cohort_id", "sample_id", "cluster_id", "y"), spectrum_features(spark, sf), N.LogisticLearner(dims=AXIS.n_bins), SEED, fixed=fixed,
        disjoint_cohorts=["common_test"],
    )


def split_pair(df: DataFrame) -> DataFrame:
    at = lambda i: F.split("task", r"\|")[i]
    return df.select(at(0).alias("task"), at(1).alias("training_regime"), *[c for c in df.columns if c != "task"])


@query
def history_bundle(spark, sf):
    """The metric bundle of the common test per task and training regime, with that regime's calibration and thresholds."""
    return split_pair(N.evaluate_run(history_protocol(spark, sf), calibration=True))


@query
def history_run(spark, sf):
    """One common test, models of three training regimes with fixed parameters, paired bootstrap of the differences."""
    scored = split_pair(history_protocol(spark, sf).predictions)
    aligned = R.align_regimes(scored, ["task", "sample_id", "cluster_id", "y"], "training_regime", REGIMES, "raw_probability")
    return B.paired_differences(aligned, BY_TASK, REGIMES, "current_workflow_only", replicates=REPLICATES, seed=SEED)


@query
def annual_cells(spark, sf):
    """Tune on adequate yearly folds of all years before the last, test on the last year, all and entity-disjoint; cells that fail the gate keep a status row."""
    base = V.samples(spark, sf).select("task", "sample_id", "cluster_id", "d", "year", "y")
    development, last = base.where(F.col("year") < 2000), base.where(F.col("year") == 2000)
    folds = C.year_fold_rows(development, C.year_fold_audit(development)).select("task", "fold_index", "split", "sample_id", "y")
    everything = last.withColumn("cohort_id", F.lit("all_samples"))
    disjoint = C.purge(development, last, BY_TASK, mode="annual").withColumn("cohort_id", F.lit("entity_disjoint"))
    evaluation = everything.unionByName(disjoint).drop("d", "year")
    spine = spine_of(spark, "annual", TASKS, ("2000",), {"all_samples": True, "entity_disjoint": False}, "development_and_primary").drop("family", "cell")
    plan = cut_lineage(P.run_plan(spine, development, folds, evaluation, BY_TASK))
    fits = plan.where("fits").select("task").distinct()
    only = lambda df: df.join(fits, "task", "left_semi")
    run = N.run_protocol(only(development).drop("d", "year"), only(folds), only(evaluation), spectrum_features(spark, sf), N.LogisticLearner(dims=AXIS.n_bins), SEED)
    bundle = N.evaluate_run(run)
    ok, values = F.col("status") == "ok", [c for c in bundle.columns if c not in ("task", "cohort_id", "positive_n", "negative_n")]
    return plan.join(bundle, ["task", "cohort_id"], "left").select(*plan.columns, *[F.when(ok, F.col(v)).alias(v) for v in values])


# --- three families of protocols in one plan -----------------------------------------------------

PLAN_YEARS = (1996, 1997, 1998, 1999, 2000, 2001, 2002)
SITE_COHORTS = {"source_entity_disjoint": True, "source_all_samples": False, "target_primary": False, "target_full_period": False}


def spine_of(spark: SparkSession, family: str, tasks, cells, cohorts: dict[str, bool], gate: str) -> DataFrame:
    rows = [(family, t, c, k, primary, gate) for t in tasks for c in cells for k, primary in cohorts.items()]
    return spark.createDataFrame(rows, "family string, task string, cell string, cohort_id string, is_primary boolean, gate string")


def family_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Spine, development, folds and evaluation of the annual, training-history and cross-site families."""
    base = V.samples(spark, sf).select("task", "sample_id", "site_id", "cluster_id", "d", "year", "y")
    spine = K.all_checks([
        spine_of(spark, "annual", TASKS, [str(y) for y in PLAN_YEARS], {"entity_disjoint": True, "all_samples": False}, "development_and_primary"),
        spine_of(spark, "training_history", TASKS, REGIMES, {"common_entity_disjoint": True, "common_all_samples": False}, "development"),
        spine_of(spark, "cross_site", TASKS, ("source",), SITE_COHORTS, "development"),
    ])
    columns = ["family", "task", "cell", "sample_id", "cluster_id", "y"]

    def of(df: DataFrame, family: str, cell, *more: str) -> DataFrame:
        return df.withColumn("family", F.lit(family)).withColumn("cell", cell).select(*columns[:3], *more, *columns[3:])

    # annual: every year tests once; the folds of a test year are the adequate years before it
    later_years = F.explode(F.array(*[F.lit(y) for y in PLAN_YEARS])).alias("test_year")
    test_year = F.col("test_year").cast("string")
    annual_dev = base.select("*", later_years).where(F.col("year") < F.col("test_year"))
    audit = C.year_fold_audit(base)
    year_folds = C.year_fold_rows(base, audit).select("*", later_years).where(F.col("fold_index") < F.col("test_year"))
    tested = base.where(F.col("year").isin(*PLAN_YEARS)).withColumn("test_year", F.col("year"))
    first = base.groupBy("task", "cluster_id").agg(F.min("year").alias("_first")).withColumnRenamed("cluster_id", "_c")
    unseen = tested.join(first.withColumnRenamed("task", "_t"), (F.col("task") == F.col("_t")) & (F.col("cluster_id") == F.col("_c")), "left")
    unseen = unseen.where(X.usable("cluster_id") & (F.coalesce("_first", "year") >= F.col("year"))).drop("_t", "_c", "_first")

    training, history_folds, common, common_all = regime_tables(spark, sf)
    regime = F.col("training_regime")
    tests = training.select("task", "training_regime").distinct()
    source = V.development(base).where(F.col("site_id") == "A")
    later = V.test_rows(base)
    of_site = lambda df, name: of(df.withColumn("cohort_id", F.lit(name)), "cross_site", F.lit("source"), "cohort_id")
    as_cohort = lambda df, family, cell, name: of(df.withColumn("cohort_id", F.lit(name)), family, cell, "cohort_id")
    development = K.all_checks([
        of(annual_dev, "annual", test_year), of(training, "training_history", regime), of(source, "cross_site", F.lit("source")),
    ])
    fold = lambda df, family, cell: of(df.withColumn("fold_index", F.col("fold_index").cast("int")), family, cell, "fold_index", "split")
    folds = K.all_checks([
        fold(year_folds, "annual", test_year), fold(history_folds, "training_history", regime), fold(purged_folds(source), "cross_site", F.lit("source")),
    ])
    evaluation = K.all_checks([
        as_cohort(unseen, "annual", test_year, "entity_disjoint"), as_cohort(tested, "annual", test_year, "all_samples"),
        as_cohort(common.join(tests, "task"), "training_history", regime, "common_entity_disjoint"),
        as_cohort(common_all.join(tests, "task"), "training_history", regime, "common_all_samples"),
        of_site(C.purge(source, later.where(F.col("site_id") == "A"), BY_TASK), "source_entity_disjoint"),
        of_site(later.where(F.col("site_id") == "A"), "source_all_samples"),
        of_site(later.where(F.col("site_id") == "B"), "target_primary"), of_site(base.where(F.col("site_id") == "B"), "target_full_period"),
    ])
    return spine, development, folds, evaluation


@query
def sensitivity_plan(spark, sf):
    """What the logistic sensitivity over three protocol families would fit, and why not, before any fit."""
    return P.run_plan(*family_tables(spark, sf))


@query
def sensitivity_run(spark, sf):
    """The planned logistic models of all families, tuned, refitted and evaluated together; one row per planned cohort."""
    spine, *rows = family_tables(spark, sf)
    development, folds, evaluation = (cut_lineage(df) for df in rows)  # the plan, the fits and the scores read them
    plan = P.run_plan(spine, development, folds, evaluation)
    return P.run_cells(plan, development, folds, evaluation, spectrum_features(spark, sf), N.LogisticLearner(dims=AXIS.n_bins), SEED, replicates=REPLICATES)[0]
