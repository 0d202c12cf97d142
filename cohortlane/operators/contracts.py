"""Contracts and checks. Every check is a row ``(check_name, violations, status, examples)``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.functions.columns import count_true, usable
from cohortlane.sized import dealt

# Tokens that mark a column name as private.
PRIVATE_COLUMN_TOKENS = ("private", "patient_id", "sample_id_private", "event_id", "absolute_path")
SPLIT_VALUES = ("train", "validation", "test", "early_70", "late_30")
FOLD_SPLITS = ("train", "validation")
EXAMPLE_LIMIT = 5


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    """Fail with the full list of missing columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing columns: {missing}")
    return df


def private_columns(df: DataFrame) -> list[str]:
    """Columns whose lower-cased name contains a private token."""
    return [c for c in df.columns if any(token in c.lower() for token in PRIVATE_COLUMN_TOKENS)]


def _finding(name: str, violations: DataFrame, count: Column, example: Column) -> DataFrame:
    """One row from violating rows: the number and the first few ids in order.

    The examples come from a top-k, so the violating rows are never gathered.
    """
    firsts = violations.select(example.cast("string").alias("e")).distinct().orderBy("e").limit(EXAMPLE_LIMIT)
    parts = violations.agg(count.cast("bigint").alias("n")).select("n", F.lit(None).cast("string").alias("e")).unionByName(
        firsts.select(F.lit(None).cast("bigint").alias("n"), "e")
    )
    summary = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations"),
        F.array_join(F.array_sort(F.collect_list("e")), ",").alias("examples"),
    )
    return summary.select(
        F.lit(name).alias("check_name"), "violations",
        F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), "examples",
    )


def duplicate_keys(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Rows that share a key with another row, with the first ids."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    return _finding(name, repeated, F.sum("_rows"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]))


def unknown_keys(df: DataFrame, key: str, known: DataFrame, known_key: str, name: str) -> DataFrame:
    """Distinct keys of ``df`` that ``known`` does not contain."""
    left = df.select(F.col(key).alias("_key")).distinct()
    right = known.select(F.col(known_key).alias("_key")).distinct()
    return _finding(name, left.join(right, "_key", "left_anti"), F.count(F.lit(1)), F.col("_key"))


def shared_keys(left: DataFrame, right: DataFrame, key: str, name: str, *, ignore_missing: bool = False) -> DataFrame:
    """Distinct keys present on both sides (leakage)."""
    if ignore_missing:
        left, right = left.where(usable(key)), right.where(usable(key))
    shared = left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")
    return _finding(name, shared, F.count(F.lit(1)), F.col(key))


def rows_where(df: DataFrame, condition: Column, example: str, name: str) -> DataFrame:
    """Rows for which ``condition`` (a violation) is true or unknown."""
    return _finding(name, df.where(F.coalesce(condition, F.lit(True))), F.count(F.lit(1)), F.col(example))


def row_numbers_contiguous(df: DataFrame, row: str, group: str, name: str) -> DataFrame:
    """Row numbers must be exactly 0..n-1 per group: as many distinct as rows, lowest 0, highest n-1."""
    numbers = df.groupBy(group, row).agg(F.count(F.lit(1)).alias("_n"))
    bounds = numbers.groupBy(group).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("distinct"), F.min(row).alias("low"), F.max(row).alias("high")
    )
    broken = ~((F.col("n") == F.col("distinct")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1))
    return _finding(name, bounds.where(F.coalesce(broken, F.lit(True))), F.count(F.lit(1)), F.col(group))


def binary_scan(df: DataFrame, values: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Counts of values that are not finite or not 0/1 over listed numeric columns."""
    out = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        reduce(lambda a, b: a + b, [count_true(~_finite(c)) for c in values]).alias("nonfinite_n"),
        reduce(lambda a, b: a + b, [count_true(~(F.coalesce(F.col(c).isin(0, 1), F.lit(False)))) for c in values]).alias("nonbinary_n"),
    )
    clean = (F.col("nonfinite_n") == 0) & (F.col("nonbinary_n") == 0)
    return out.withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))


def _finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def all_checks(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """The only action of this module: raise if a check failed. Reads one row per check."""
    failed = checks.where(F.col("status") == "FAIL").orderBy("check_name").collect()
    if failed:
        raise ValueError("; ".join(f"{r.check_name}: n={r.violations} [{r.examples}]" for r in failed))


def release_checks(samples: DataFrame, labels: DataFrame, tasks: DataFrame, splits: DataFrame, prefix: str | None = None) -> DataFrame:
    """Keys, values and references of a release made of samples, labels, a task list and splits."""
    require_columns(samples, ("site_id", "sample_id", "feature_row"), "samples")
    require_columns(labels, ("site_id", "sample_id", "task", "sir", "y"), "labels")
    require_columns(splits, ("protocol", "site_id", "task", "sample_id", "split"), "splits")
    private = private_columns(labels)
    if private:
        raise ValueError(f"private-looking label columns: {private}")
    checks = [
        duplicate_keys(samples, ["sample_id"], "sample_key"),
        duplicate_keys(labels, ["site_id", "sample_id", "task"], "label_key"),
        duplicate_keys(splits, ["protocol", "site_id", "task", "sample_id"], "split_key"),
        rows_where(labels, ~F.col("sir").isin("S", "I", "R"), "sample_id", "label_category"),
        rows_where(labels.where(F.col("y").isNotNull()), ~F.col("y").isin(0, 1), "sample_id", "label_binary"),
        rows_where(splits, ~F.col("split").isin(*SPLIT_VALUES), "sample_id", "split_value"),
        unknown_keys(labels, "sample_id", samples, "sample_id", "label_sample_known"),
        unknown_keys(splits, "sample_id", samples, "sample_id", "split_sample_known"),
        unknown_keys(labels, "task", tasks, "task", "label_task_known"),
    ]
    if prefix is not None:
        checks.append(rows_where(labels, ~F.col("sample_id").cast("string").startswith(prefix), "sample_id", "sample_id_prefix"))
    return all_checks(checks)


def _check_rows(names: Sequence[str], violations: DataFrame) -> DataFrame:
    """One row per check from violating cases ``(check_name, n, example)``: the sum of ``n`` and the first few examples in order."""
    cases = violations.groupBy("check_name", "example").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("check_name").orderBy("example")
    # examples read the numbers too, so that both parts read the same shuffled cases
    examples = cases.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= EXAMPLE_LIMIT).groupBy("check_name").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("example")))), ",").alias("examples")
    )
    listed = violations.sparkSession.createDataFrame([(n,) for n in names], "check_name string")
    return listed.join(cases.groupBy("check_name").agg(F.sum("n").alias("violations")), "check_name", "left").join(examples, "check_name", "left").select(
        "check_name", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"),
        F.when(F.col("violations").isNull(), "PASS").otherwise("FAIL").alias("status"), F.coalesce("examples", F.lit("")).alias("examples"),
    )


def _cases(df: DataFrame, example: Column, checks: dict[str, Column]) -> DataFrame:
    """``(check_name, n, example)`` for each row of ``df`` and check whose number is above zero."""
    numbers = F.array(*[F.struct(F.lit(name).alias("check_name"), n.cast("bigint").alias("n")) for name, n in checks.items()])
    return df.select(F.explode(F.filter(numbers, lambda x: x["n"] > 0)).alias("x"), example.alias("example")).select("x.check_name", "x.n", "example")


def development_contract(development: DataFrame, folds: DataFrame, evaluation: DataFrame, *, disjoint_clusters: bool | None = None,
                         sample_n: int | None = None) -> DataFrame:
    """Leakage contract per task: unique development rows, folds inside development, disjoint splits,
    each validation sample in one fold, both classes everywhere, at least two folds.

    ``folds`` is the long table ``(task, fold_index, split, sample_id, y)``. With ``disjoint_clusters`` no usable cluster of a
    task may stand on both sides either: development and evaluation must have ``cluster_id``, and folds without it take it from
    development. With False clusters are not looked at; by default they are if all three tables have the column.

    All rows of a sample, and of a cluster, meet in one aggregation, from which all checks read. ``sample_n`` is the number of
    samples, if it is known: they are then dealt to as many tasks as they need.
    """
    if disjoint_clusters:
        require_columns(development, ["cluster_id"], "development")
        require_columns(evaluation, ["cluster_id"], "evaluation")
        if "cluster_id" not in folds.columns:
            folds = folds.join(development.select("task", "sample_id", "cluster_id").dropDuplicates(["task", "sample_id"]), ["task", "sample_id"], "left")
    index = folds.schema["fold_index"].dataType
    no_fold = (F.lit(None).cast(index).alias("fold_index"), F.lit(None).cast("string").alias("split"))

    def met(unit: str, tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Numbers of rows per (task, unit, fold), and per (task, unit)."""
        kinds = [t.select("task", unit, *fold, F.lit(kind).alias("_kind")) for kind, t, fold in zip(
            ("development", "fold", "test"), tables, (no_fold, ("fold_index", F.col("split").cast("string").alias("split")), no_fold)
        )]
        rows = all_checks(kinds)
        if sample_n is not None:
            rows = dealt(rows, "task", unit, rows=sample_n)
        of_kind, in_fold = (lambda k: F.col("_kind") == k), F.col("_kind") == "fold"
        known = F.coalesce(F.col("split").isin(*FOLD_SPLITS), F.lit(False))
        cells = rows.groupBy("task", unit, "fold_index").agg(
            F.count_if(of_kind("development")).alias("d"), F.count_if(in_fold).alias("f"), F.count_if(of_kind("test")).alias("e"),
            F.count_if(in_fold & (F.col("split") == "train")).alias("t"), F.count_if(in_fold & (F.col("split") == "validation")).alias("v"),
            F.count_if(in_fold & ~known).alias("bad"),
        )
        both = F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("both")
        return cells, cells.groupBy("task", unit).agg(*(F.sum(c).alias(c) for c in ("d", "f", "e", "v", "bad")), both)

    number = lambda condition, n=1: F.when(condition, F.lit(n) if n == 1 else F.col(n)).otherwise(0)
    d, f, e = F.col("d") > 0, F.col("f") > 0, F.col("e") > 0
    text = lambda *columns: F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    checks = {
        "development_key": number(F.col("d") > 1, "d"), "fold_split_value": F.col("bad"), "fold_inside_development": number(f & ~d),
        "train_validation_disjoint": F.col("both"), "validation_once": number(F.col("v") > 1, "v"),
        "development_evaluation_disjoint": number(d & e), "fold_evaluation_disjoint": number(f & e),
    }
    names, violations = list(checks), _cases(met("sample_id", [development, folds, evaluation])[1], text("task", "sample_id"), checks)
    if disjoint_clusters is not False and all("cluster_id" in t.columns for t in (development, folds, evaluation)):
        cells, units = met("cluster_id", [t.where(usable("cluster_id")) for t in (development, folds, evaluation)])
        within = {"train_validation_clusters_disjoint": number((F.col("t") > 0) & (F.col("v") > 0))}
        across = {"development_evaluation_clusters_disjoint": number(d & e), "fold_evaluation_clusters_disjoint": number(f & e)}
        names += [*within, *across]
        violations = violations.unionByName(_cases(cells, text("task", "fold_index", "cluster_id"), within)).unionByName(_cases(units, text("task", "cluster_id"), across))

    per_split = (
        folds.groupBy("task", "fold_index", "split")
        .agg(F.min("y").alias("low"), F.max("y").alias("high"))
        .withColumn("_cell", text("task", "fold_index", "split"))
    )
    dev_class = development.groupBy("task").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    fold_n = development.select("task").distinct().join(
        folds.groupBy("task", "fold_index").agg(F.count(F.lit(1)).alias("_n")).groupBy("task").agg(F.count(F.lit(1)).alias("folds")),
        "task", "left",
    )
    return all_checks([
        _check_rows(names, violations),
        rows_where(dev_class, ~((F.col("low") == 0) & (F.col("high") == 1)), "task", "development_both_classes"),
        rows_where(fold_n, F.coalesce(F.col("folds"), F.lit(0)) < 2, "task", "at_least_two_folds"),
        rows_where(per_split, ~((F.col("low") == 0) & (F.col("high") == 1)), "_cell", "fold_both_classes"),
    ])
