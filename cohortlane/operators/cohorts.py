"""Cohorts without leakage: windows, rolling-origin folds, entity purge, first records, support."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.functions.columns import count_true, ratio, usable
from cohortlane.operators.contracts import all_checks, require_columns, rows_where
from cohortlane.sized import checked_broadcast

DAY = timedelta(days=1)


@dataclass(frozen=True)
class TimeWindow:
    """An inclusive date window of a cohort; an open end is None. ``hole`` is excluded (inclusive)."""

    cohort: str
    role: str
    start: date | None
    end: date | None
    hole: tuple[date, date] | None = None

    def covers(self, day: Column) -> Column:
        inside = F.lit(True)
        if self.start is not None:
            inside = inside & (day >= F.lit(self.start))
        if self.end is not None:
            inside = inside & (day <= F.lit(self.end))
        if self.hole is not None:
            inside = inside & ~day.between(F.lit(self.hole[0]), F.lit(self.hole[1]))
        return inside


@dataclass(frozen=True)
class ProtocolDates:
    """Borders of the three temporal protocols; the defaults are the benchmark's fixed dates."""

    transition_start: date = date(2025, 6, 23)
    transition_end: date = date(2025, 6, 30)
    current_start: date = date(2025, 7, 1)
    current_end: date = date(2026, 2, 28)
    test_start: date = date(2026, 3, 1)
    test_end: date = date(2026, 6, 9)

    def __post_init__(self) -> None:
        if not self.transition_start <= self.transition_end < self.current_start <= self.current_end < self.test_start <= self.test_end:
            raise ValueError(f"protocol dates are not in order: {self}")

    def protocols(self) -> list[TimeWindow]:
        hole = (self.transition_start, self.transition_end)
        return [
            TimeWindow("A_pre_marker_to_post_marker", "development", None, self.transition_start - DAY),
            TimeWindow("A_pre_marker_to_post_marker", "test", self.current_start, self.test_end),
            TimeWindow("B_post_marker_current_temporal", "development", self.current_start, self.current_end),
            TimeWindow("B_post_marker_current_temporal", "test", self.test_start, self.test_end),
            TimeWindow("C_pooled_history_temporal", "development", None, self.test_start - DAY, hole),
            TimeWindow("C_pooled_history_temporal", "test", self.test_start, self.test_end),
        ]

    def regimes(self) -> list[TimeWindow]:
        pre = (None, self.transition_start - DAY)
        return [
            TimeWindow("pre_marker_history_only", "development", *pre),
            TimeWindow("current_workflow_only", "development", self.current_start, self.current_end),
            TimeWindow("pooled_pre_and_current", "development", *pre),
            TimeWindow("pooled_pre_and_current", "development", self.current_start, self.current_end),
            TimeWindow("common_test", "test", self.test_start, self.test_end),
        ]


def assign_windows(df: DataFrame, windows: Sequence[TimeWindow], day: str = "d") -> DataFrame:
    """Add ``cohort`` and ``role``; a row appears once per cohort and role with a window that covers its date.

    The windows are a fixed list, so membership is computed within the row: no join, no shuffle.
    """
    hits = F.array_distinct(F.array_compact(
        F.array(*[
            F.when(w.covers(F.col(day)), F.struct(F.lit(w.cohort).alias("cohort"), F.lit(w.role).alias("role")))
            for w in windows
        ])
    ))
    return df.withColumn("_w", F.explode(hits)).select(*df.columns, "_w.cohort", "_w.role")


def windows_disjoint(df: DataFrame, windows: Sequence[TimeWindow], day: str = "d", sample: str = "sample_id") -> DataFrame:
    """One check per cohort: rows that its development and its test both cover."""
    checks = []
    for cohort in dict.fromkeys(w.cohort for w in windows):
        sides = []
        for role in ("development", "test"):
            inside = F.lit(False)
            for w in windows:
                inside = inside | w.covers(F.col(day)) if (w.cohort, w.role) == (cohort, role) else inside
            sides.append(inside)
        checks.append(rows_where(df.where(F.col(day).isNotNull()), sides[0] & sides[1], sample, f"disjoint:{cohort}"))
    return all_checks(checks)


def filter_dates(df: DataFrame, start: date, end: date, day: str = "d") -> DataFrame:
    """Rows with a date in the window, both ends included."""
    if start > end:
        raise ValueError(f"date window starts after it ends: {start} > {end}")
    return df.where(F.to_date(day).between(F.lit(start), F.lit(end)))


def normalize_dates(df: DataFrame, *, sample: str = "sample_id", cluster: str = "cluster_id") -> DataFrame:
    """One date per sample from the first present date column.

    Text that is no date, a missing sample id and an id on several rows fail the job.
    """
    source = next((c for c in ("collection_date", "accept_datetime") if c in df.columns), None)
    if source is None:
        raise ValueError("date table needs collection_date or accept_datetime")
    require_columns(df, (sample,), "date table")
    parsed = F.to_date(F.try_to_timestamp(F.col(source).cast("string")))
    bad = F.raise_error(F.concat(F.lit(f"unparseable or missing {source}: "), F.coalesce(F.col(source).cast("string"), F.lit("NULL"))))
    value = [F.coalesce(parsed, bad.cast("date")).alias("target_date")]
    if cluster in df.columns:
        value.append(F.trim(F.col(cluster).cast("string")).alias(cluster))
    once = df.groupBy(F.trim(F.col(sample).cast("string")).alias(sample)).agg(F.first(F.struct(*value)).alias("_v"), F.count(F.lit(1)).alias("_n"))
    wrong = F.raise_error(F.concat(F.lit("missing or repeated sample in the date table: "), F.coalesce(sample, F.lit("NULL")))).cast("string")
    key = F.when((F.col("_n") == 1) & usable(sample), F.col(sample)).otherwise(wrong)
    return once.select(key.alias(sample), "_v.*")


def attach_dates(df: DataFrame, dates: DataFrame, *, sample: str = "sample_id") -> DataFrame:
    """Left join of the date column only, so that no other column is duplicated."""
    right = dates.select(F.col(sample).alias("_sample"), "target_date")
    return df.join(right, F.col(sample).cast("string") == F.col("_sample"), "left").drop("_sample")


# --- support -----------------------------------------------------------------------------------

def class_counts(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), count_true(F.col(y) == 1).alias("positive_n"), count_true(F.col(y) == 0).alias("negative_n")
    )


def support_status(
    mode: str, n: Column, positive: Column, negative: Column, minimum_total: int = 100, minimum_class: int = 20
) -> tuple[Column, Column]:
    """Status and reason in one of three vocabularies.

    ``graded``: a two-class cohort below the minimum stays usable as exploratory, all reasons listed.
    ``annual``: first reason only, row minimum before single class, empty is ``absent``.
    ``contract``: first reason only, single class before row minimum, empty is ``insufficient``.
    """
    low_n, low_class = F.lit(f"n<{minimum_total}"), F.lit(f"min_class<{minimum_class}")
    few, thin = n < minimum_total, F.least(positive, negative) < minimum_class
    single = F.least(positive, negative) == 0
    if mode == "graded":
        status = (
            F.when((n == 0) | single, "insufficient").when(~few & ~thin, "adequate").otherwise("exploratory_or_insufficient")
        )
        reason = (
            F.when(n == 0, "no_samples").when(single, "single_class")
            .otherwise(F.concat_ws(";", F.when(few, low_n), F.when(thin, low_class)))
        )
        return status, reason
    if mode == "annual":
        status = F.when(n == 0, "absent").when(few | single | thin, "insufficient").otherwise("adequate")
        reason = (
            F.when(n == 0, "no_split_rows").when(few, low_n).when(single, "single_class").when(thin, low_class).otherwise("")
        )
        return status, reason
    if mode == "contract":
        status = F.when((n == 0) | single | few | thin, "insufficient").otherwise("adequate")
        reason = (
            F.when(n == 0, "no_samples").when(single, "single_class").when(few, low_n).when(thin, low_class).otherwise("")
        )
        return status, reason
    raise ValueError(f"unknown support mode {mode}")


def cohort_counts(df: DataFrame, keys: Sequence[str], *, sample: str = "sample_id", cluster: str = "cluster_id") -> DataFrame:
    """Rows, distinct samples and clusters, classes, rate and graded support per cohort.

    Distinct counts go through a first aggregation per cohort and sample, and one per cohort and
    cluster, so a cohort may hold any share of the rows.
    """
    has = usable(cluster)
    kinds = F.array(
        F.struct(F.lit("s").alias("k"), F.col(sample).cast("string").alias("v")),
        F.struct(F.lit("c").alias("k"), F.when(has, F.col(cluster).cast("string")).alias("v")),
    )
    is_sample = F.col("k") == "s"
    out = (
        df.withColumn("_kind", F.explode(kinds))
        .select(*keys, "y", "_kind.k", "_kind.v")
        .groupBy(*keys, "k", "v")
        .agg(F.count(F.lit(1)).alias("n"), count_true(F.col("y") == 1).alias("p"), count_true(F.col("y") == 0).alias("q"))
        .groupBy(*keys)
        .agg(
            F.sum(F.when(is_sample, F.col("n")).otherwise(0)).alias("n_rows"),
            count_true(is_sample & F.col("v").isNotNull()).alias("unique_sample_n"),
            F.sum(F.when(is_sample, F.col("p")).otherwise(0)).alias("positive_n"),
            F.sum(F.when(is_sample, F.col("q")).otherwise(0)).alias("negative_n"),
            count_true(~is_sample & F.col("v").isNotNull()).alias("cluster_n"),
            F.sum(F.when(~is_sample & F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing_cluster_n"),
        )
        .withColumn("positive_rate", ratio("positive_n", "n_rows"))
    )
    status, reason = support_status("graded", F.col("n_rows"), F.col("positive_n"), F.col("negative_n"))
    return out.withColumn("support_status", status).withColumn("insufficient_reason", reason)


# --- entity purge ------------------------------------------------------------------------------

def _purge_keys(mode: str, cluster: str) -> tuple[Column, Column, Column]:
    """(missing on the evaluation side, key to look up or NULL, training key or NULL) of a purge mode."""
    text = F.col(cluster).cast("string")
    if mode == "strict":
        return ~usable(cluster), F.when(usable(cluster), text), F.when(usable(cluster), text)
    if mode == "annual":
        return ~usable(cluster), F.coalesce(text, F.lit("")), text
    if mode == "simple":
        return text.isNull(), text, text
    raise ValueError(f"unknown purge mode {mode}")


def mark_purge(
    training: DataFrame, evaluation: DataFrame, keys: Sequence[str] = (), *,
    mode: str = "strict", sample: str = "sample_id", cluster: str = "cluster_id",
) -> DataFrame:
    """Evaluation rows with ``cluster_missing``, ``cluster_overlap`` and ``kept``.

    ``strict`` treats blank as missing on both sides. ``annual`` treats blank as missing, but a
    blank in training also counts as overlap. ``simple`` treats only NULL as missing. Rows without
    a key to look up join on their own sample id, which spreads them over the partitions and
    cannot match a training key.
    """
    missing, lookup, train_key = _purge_keys(mode, cluster)
    seen = (
        training.select(*[F.col(k).alias(f"_t_{k}") for k in keys], train_key.alias("_t_key"))
        .where(F.col("_t_key").isNotNull())
        .distinct()
        .withColumn("_t_real", F.lit(True))
    )
    marked = (
        evaluation.withColumn("cluster_missing", missing)
        .withColumn("_real", lookup.isNotNull())
        .withColumn("_key", F.coalesce(lookup, F.col(sample).cast("string")))
    )
    condition = (F.col("_key") == F.col("_t_key")) & (F.col("_real") == F.col("_t_real"))
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_t_{k}"))
    joined = marked.join(seen, condition, "left").withColumn("cluster_overlap", F.col("_t_real").isNotNull())
    return joined.withColumn("kept", ~F.col("cluster_missing") & ~F.col("cluster_overlap")).select(
        *evaluation.columns, "cluster_missing", "cluster_overlap", "kept"
    )


def purge(training: DataFrame, evaluation: DataFrame, keys: Sequence[str] = (), **options: str) -> DataFrame:
    """Only the evaluation rows whose entity is known and absent from training."""
    return mark_purge(training, evaluation, keys, **options).where("kept").select(*evaluation.columns)


def purge_audit(marked: DataFrame, keys: Sequence[str], minimum_total: int = 100, minimum_class: int = 20) -> DataFrame:
    """Before/after counts, both removal counts and graded support, from one pass over marked rows."""
    kept = F.col("kept")
    out = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_before"),
        count_true(F.col("y") == 1).alias("positive_before_n"),
        count_true(F.col("y") == 0).alias("negative_before_n"),
        count_true(F.col("cluster_overlap")).alias("removed_overlap_n"),
        count_true(F.col("cluster_missing")).alias("removed_missing_cluster_n"),
        count_true(kept).alias("n_after"),
        count_true(kept & (F.col("y") == 1)).alias("positive_after_n"),
        count_true(kept & (F.col("y") == 0)).alias("negative_after_n"),
    )
    status, reason = support_status(
        "graded", F.col("n_after"), F.col("positive_after_n"), F.col("negative_after_n"), minimum_total, minimum_class
    )
    return out.select(
        "*", status.alias("support_status"), reason.alias("insufficient_reason"),
        F.when(status == "adequate", "PASS").otherwise("FAIL").alias("purge_status"),
    )


# --- first records -----------------------------------------------------------------------------

def keep_extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, last: bool = False) -> DataFrame:
    """The first (or last) row per key in a total order.

    Done as an aggregation instead of a window: rows of a hot key combine before the shuffle. The
    whole row is the aggregated value, so select the wanted columns before the call.
    """
    rest = F.struct(*[F.col(c) for c in df.columns])
    pick = (F.max_by if last else F.min_by)(rest, F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(pick.alias("_row")).select("_row.*")


def first_per_cluster(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), cluster: str = "cluster_id") -> DataFrame:
    """Earliest row of every cluster; rows with a NULL cluster are dropped."""
    return keep_extreme(df.where(F.col(cluster).isNotNull()), [*keys, cluster], order)


def episode_first(df: DataFrame, cluster: str = "cluster_id", flag: str = "episode_first") -> DataFrame:
    """Rows flagged as the first of their episode that have a cluster."""
    return df.where(F.col(cluster).isNotNull() & F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def one_record_per_cluster(
    training: DataFrame, evaluation: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First training row per cluster; evaluation rows of unseen clusters, then their first row.

    ``keys`` may include the fold, so all folds run in one plan. Returns (training, evaluation, audit).
    """
    train = first_per_cluster(training, order, keys)
    marked = mark_purge(train, evaluation, keys, mode="simple")
    test = first_per_cluster(marked.where("kept").select(*evaluation.columns), order, keys)
    counts = [
        class_counts(training, keys).select(*keys, F.col("n").alias("train_input_n")),
        class_counts(train, keys).select(
            *keys, F.col("n").alias("train_n"), F.col("positive_n").alias("train_positive_n"),
            F.col("negative_n").alias("train_negative_n"),
        ),
        marked.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("evaluation_input_n"), count_true(~F.col("kept")).alias("removed_seen_n")
        ),
        class_counts(test, keys).select(
            *keys, F.col("n").alias("evaluation_n"), F.col("positive_n").alias("evaluation_positive_n"),
            F.col("negative_n").alias("evaluation_negative_n"),
        ),
    ]
    audit = counts[0]
    for part in counts[1:]:
        audit = audit.join(part, list(keys), "left")
    return train, test, audit.na.fill(0)


def fold_adequate(
    train: tuple[str, str, str], validation: tuple[str, str, str], sizes: tuple[int, int, int, int]
) -> Column:
    """Both parts have the required rows and rows per class; ``sizes`` = (train n, class, validation n, class)."""
    return (
        (F.col(train[0]) >= sizes[0]) & (F.least(*train[1:]) >= sizes[1])
        & (F.col(validation[0]) >= sizes[2]) & (F.least(*validation[1:]) >= sizes[3])
    )


# Fixed values: (train rows, train class, validation rows, validation class) of the two adequacy sizes.
LARGE_FOLD = (50, 10, 20, 5)
SMALL_FOLD = (20, 10, 10, 5)


# --- rolling-origin folds ----------------------------------------------------------------------

MONTH_FRACTIONS = (0.50, 0.67, 0.84)
MINIMUM_MONTHS = 4


def latest_rows(df: DataFrame, task: str, sample: str, day: str) -> DataFrame:
    """Dated rows, the latest one per task and sample; rows of one day are ordered by their other columns."""
    rest = [c for c in df.columns if c not in (task, sample, day)]
    return keep_extreme(df.where(F.col(day).isNotNull()), [task, sample], [day, *rest], last=True)


def month_fold_audit(df: DataFrame, *, task: str = "task", sample: str = "sample_id", day: str = "d") -> DataFrame:
    """Borders, note, counts and adequacy of the monthly rolling-origin folds, at most four per task.

    Counts per task and observed month are enough to build the folds, so the rows are read once
    and only one small row per month reaches the fold construction.
    """
    total = lambda items, f: F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, m: acc + m[f])
    needed = df.select(task, sample, day, "y")
    per_month = class_counts(latest_rows(needed, task, sample, day).withColumn("month", F.trunc(day, "MM")), [task, "month"])
    months = per_month.groupBy(task).agg(
        F.array_sort(F.collect_list(F.struct("month", "n", "positive_n", "negative_n"))).alias("months")
    )
    n = F.size("months")
    cuts = [F.greatest(F.lit(2), F.floor(n * F.lit(f)).cast("int")) for f in MONTH_FRACTIONS]
    borders = F.array_sort(F.array_distinct(F.array(*cuts, n)))
    pairs = F.transform(
        F.slice(borders, 1, F.size(borders) - 1),
        lambda start, i: F.struct(start.alias("lo"), F.element_at(borders, i + 2).alias("hi")),
    )
    head, block = F.slice("months", 1, F.col("p.lo")), F.slice("months", F.col("p.lo") + 1, F.col("p.hi") - F.col("p.lo"))
    text = lambda month: F.date_format(month, "yyyy-MM")
    folds = (
        months.where(n >= MINIMUM_MONTHS)
        .select(task, "months", F.posexplode(pairs).alias("border_index", "p"))
        .select(task, "border_index", head.alias("head"), block.alias("block"))
        .select(
            task, "border_index",
            F.col("block")[0]["month"].alias("valid_from"), F.element_at("block", -1)["month"].alias("valid_to"),
            F.concat(F.lit("train_through="), text(F.element_at("head", -1)["month"]), F.lit(";validation="),
                     text(F.col("block")[0]["month"]), F.lit(".."), text(F.element_at("block", -1)["month"])).alias("fold_note"),
            total("head", "n").alias("n_train"),
            total("head", "positive_n").alias("train_positive_n"),
            total("head", "negative_n").alias("train_negative_n"),
            total("block", "n").alias("n_validation"),
            total("block", "positive_n").alias("validation_positive_n"),
            total("block", "negative_n").alias("validation_negative_n"),
        )
    )
    return folds.withColumn(
        "adequate",
        fold_adequate(("n_train", "train_positive_n", "train_negative_n"),
                      ("n_validation", "validation_positive_n", "validation_negative_n"), LARGE_FOLD),
    )


def month_fold_rows(df: DataFrame, *, task: str = "task", sample: str = "sample_id", day: str = "d") -> DataFrame:
    """Long fold table of the adequate monthly folds: earlier months train, the next block validates.

    The fold table has at most four rows per task and is broadcast after a size check, so the rows
    are not shuffled by task.
    """
    audit = month_fold_audit(df, task=task, sample=sample, day=day).where("adequate")
    folds = checked_broadcast(
        audit.select(F.col(task).alias("_task"), F.col("border_index").alias("fold_index"), "valid_from", "valid_to", "fold_note")
    )
    month = F.trunc(day, "MM")
    return (
        latest_rows(df, task, sample, day)
        .join(folds, (F.col(task) == F.col("_task")) & (month <= F.col("valid_to")))
        .select(*df.columns, "fold_index", "fold_note", F.when(month < F.col("valid_from"), "train").otherwise("validation").alias("split"))
    )


def year_fold_audit(df: DataFrame, keys: Sequence[str] = ("task",), *, year: str = "year", cluster: str = "cluster_id") -> DataFrame:
    """Audit of yearly rolling-origin folds with the annual purge, one row per year but the first.

    A validation row overlaps exactly if its cluster occurs in an earlier year, so the folds need
    no copies of the rows: counts per (cluster, year) and the first year of each cluster suffice.
    The window below runs over those counts, at most one row per year and cluster.
    """
    keys = list(keys)
    text = F.col(cluster).cast("string")
    counts = (
        df.where(F.col(year).isNotNull())
        .groupBy(*keys, F.coalesce(text, F.lit("")).alias("_key"), text.isNull().alias("_null"), F.col(year).alias("_year"))
        .agg(F.count(F.lit(1)).alias("n"), count_true(F.col("y") == 1).alias("p"), count_true(F.col("y") == 0).alias("q"))
    )
    same_cluster = Window.partitionBy(*keys, "_key")
    counts = counts.withColumn("_first", F.min(F.when(~F.col("_null"), F.col("_year"))).over(same_cluster))
    missing = F.trim("_key") == ""
    overlap = F.coalesce(F.col("_first") < F.col("_year"), F.lit(False))
    kept = ~missing & ~overlap
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    per_year = counts.groupBy(*keys, "_year").agg(
        F.sum("n").alias("all_n"), F.sum("p").alias("all_p"), F.sum("q").alias("all_q"),
        total("n", overlap).alias("removed_overlap_n"), total("n", missing).alias("removed_missing_cluster_n"),
        total("n", kept).alias("n_validation"), total("p", kept).alias("validation_positive_n"),
        total("q", kept).alias("validation_negative_n"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    out = per_year.select(
        *keys, F.col("_year").cast("int").alias("validation_year"),
        F.min("_year").over(earlier).cast("int").alias("train_year_min"),
        F.max("_year").over(earlier).cast("int").alias("train_year_max"),
        F.sum("all_n").over(earlier).alias("n_train"),
        F.sum("all_p").over(earlier).alias("train_positive_n"),
        F.sum("all_q").over(earlier).alias("train_negative_n"),
        F.col("all_n").alias("n_validation_before_purge"),
        "removed_overlap_n", "removed_missing_cluster_n", "n_validation", "validation_positive_n", "validation_negative_n",
    ).where(F.col("n_train").isNotNull())
    train = support_status("annual", F.col("n_train"), F.col("train_positive_n"), F.col("train_negative_n"), SMALL_FOLD[0], SMALL_FOLD[1])
    valid = support_status(
        "annual", F.col("n_validation"), F.col("validation_positive_n"), F.col("validation_negative_n"), SMALL_FOLD[2], SMALL_FOLD[3]
    )
    adequate = (train[0] == "adequate") & (valid[0] == "adequate")
    reasons = F.concat_ws(";", *[F.when(r != "", r) for r in (train[1], valid[1])])
    return out.withColumn("status", F.when(adequate, "adequate").otherwise("insufficient")).withColumn("insufficient_reason", reasons)


def year_fold_rows(
    df: DataFrame, audit: DataFrame, *, task: str = "task", year: str = "year", sample: str = "sample_id", cluster: str = "cluster_id"
) -> DataFrame:
    """Long table of the adequate yearly folds: all earlier rows train, purged rows of the year validate."""
    folds = checked_broadcast(
        audit.where(F.col("status") == "adequate").select(F.col(task).alias("_task"), F.col("validation_year").alias("fold_index"))
    )
    rows = df.join(folds, (F.col(task) == F.col("_task")) & (F.col(year) <= F.col("fold_index"))).drop("_task")
    train = rows.where(F.col(year) < F.col("fold_index"))
    validation = purge(train, rows.where(F.col(year) == F.col("fold_index")), [task, "fold_index"],
                       mode="annual", sample=sample, cluster=cluster)
    return train.withColumn("split", F.lit("train")).unionByName(validation.withColumn("split", F.lit("validation")))


def fold_table_with_history(
    rows: DataFrame, folds: DataFrame, history: DataFrame | None = None, *, task: str = "task", sample: str = "sample_id"
) -> tuple[DataFrame, DataFrame]:
    """Rolling-origin folds from a given fold table, optionally with earlier history in every training part.

    ``folds`` is ``(task, fold_index, sample_id, split)``. A training row that is also in the
    history counts once. Returns the purged long fold table and its audit.
    """
    columns = rows.columns
    joined = folds.select(task, "fold_index", sample, "split").join(rows, [task, sample])
    train = joined.where(F.col("split") == "train").select(*columns, "fold_index")
    if history is not None:
        fold_ids = checked_broadcast(folds.groupBy(F.col(task).alias("_task"), "fold_index").agg(F.lit(1)).select("_task", "fold_index"))
        earlier = history.select(*columns).join(fold_ids, F.col(task) == F.col("_task")).select(*columns, "fold_index")
        train = keep_extreme(
            earlier.withColumn("_late", F.lit(0)).unionByName(train.withColumn("_late", F.lit(1))),
            [task, "fold_index", sample], ["_late"], last=True,
        ).drop("_late")
    marked = mark_purge(train, joined.where(F.col("split") == "validation").select(*columns, "fold_index"),
                        [task, "fold_index"], mode="annual", sample=sample)
    kept = F.col("kept")
    right = marked.groupBy(task, "fold_index").agg(
        F.count(F.lit(1)).alias("n_validation_before_purge"),
        count_true(F.col("cluster_overlap")).alias("removed_overlap_n"),
        count_true(F.col("cluster_missing")).alias("removed_missing_cluster_n"),
        count_true(kept).alias("n_validation"),
        count_true(kept & (F.col("y") == 1)).alias("validation_positive_n"),
        count_true(kept & (F.col("y") == 0)).alias("validation_negative_n"),
    )
    left = class_counts(train, [task, "fold_index"]).select(
        task, "fold_index", F.col("n").alias("n_train"), F.col("positive_n").alias("train_positive_n"),
        F.col("negative_n").alias("train_negative_n"),
    )
    adequate = fold_adequate(("n_train", "train_positive_n", "train_negative_n"),
                             ("n_validation", "validation_positive_n", "validation_negative_n"), SMALL_FOLD)
    audit = left.join(right, [task, "fold_index"], "full").na.fill(0).withColumn(
        "status", F.when(adequate, "adequate").otherwise("insufficient")
    )
    table = train.withColumn("split", F.lit("train")).unionByName(
        marked.where("kept").select(*columns, "fold_index").withColumn("split", F.lit("validation"))
    )
    return table, audit


# --- group attachment --------------------------------------------------------------------------

def attach_groups(
    df: DataFrame, groups: DataFrame | None, *, task: str = "task", sample: str = "sample_id",
    fields: Sequence[str] = ("cluster_id", "episode_id"),
) -> DataFrame:
    """Left attach of group columns; a group row applies to its own task or, without a task, to all.

    A sample with several rows for a task, or with a task row and a global row, has no unique group and fails the job.
    """
    if groups is None:
        return df.select("*", *[F.lit(None).cast("string").alias(f) for f in fields])

    def single(rows: DataFrame, names: dict[str, str], out: str) -> DataFrame:
        found = rows.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.first(F.struct(*fields)).alias("_v"), F.count(F.lit(1)).alias("_n"))
        repeated = F.raise_error(F.concat(F.lit("repeated grouping rows for sample "), F.col(names[sample]).cast("string")))
        return found.select(*names.values(), F.when(F.col("_n") == 1, F.col("_v")).otherwise(repeated.cast(found.schema["_v"].dataType)).alias(out))

    groups = groups.where(F.col(sample).isNotNull())
    own = single(groups.where(usable(task)), {sample: "_s1", task: "_t1"}, "_own")
    shared = single(groups.where(~usable(task)), {sample: "_s2"}, "_shared")
    joined = df.join(own, (F.col(sample) == F.col("_s1")) & (F.col(task) == F.col("_t1")), "left").join(
        shared, F.col(sample) == F.col("_s2"), "left"
    )
    both = F.raise_error(F.concat(F.lit("duplicate grouping rows for sample "), F.col(sample).cast("string")))
    chosen = F.when(F.col("_own").isNotNull() & F.col("_shared").isNotNull(), both.cast(joined.schema["_own"].dataType)).otherwise(
        F.coalesce("_own", "_shared")
    )
    return joined.withColumn("_g", chosen).select(*df.columns, *[F.col(f"_g.{f}").alias(f) for f in fields])
