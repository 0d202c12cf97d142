"""Regression of reproduced tables against frozen ones, membership digests, tuning summaries, ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.functions.columns import count_true
from cohortlane.session import cut_lineage
from cohortlane.sized import checked_broadcast

METRIC_TOLERANCE = 1e-10


def _fields_long(df: DataFrame, keys: Sequence[str], numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("number"), F.lit(None).cast("string").alias("text")) for c in numbers
    ] + [
        F.struct(F.lit(c).alias("field"), F.lit(None).cast("double").alias("number"), F.col(c).cast("string").alias("text")) for c in texts
    ]
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def tolerance_regression(
    reproduced: DataFrame, frozen: DataFrame, keys: Sequence[str], *, metrics: Sequence[str] = (), counts: Sequence[str] = (),
    texts: Sequence[str] = (), tolerance: float = METRIC_TOLERANCE, corrected: Column | None = None,
) -> DataFrame:
    """Field-by-field comparison: counts exactly, metrics within ``tolerance``, text by equality.

    Both missing passes; one missing (also a key on one side only) is an infinite difference and
    fails. ``corrected`` marks failing rows that a documented correction explains.
    """
    keys = list(keys)
    numbers = [*counts, *metrics]
    left = _fields_long(reproduced, keys, numbers, texts).withColumnsRenamed({"number": "reproduced_value", "text": "reproduced_text"})
    right = _fields_long(frozen, keys, numbers, texts).withColumnsRenamed({"number": "frozen_value", "text": "frozen_text"})
    joined = left.join(right, [*keys, "field"], "full")
    a, b = F.col("reproduced_value"), F.col("frozen_value")
    missing = lambda c: c.isNull() | F.isnan(c)
    difference = (
        F.when(missing(a) & missing(b), 0.0).when(missing(a) | missing(b), float("inf")).otherwise(F.abs(a - b))
    )
    limit = F.when(F.col("field").isin(*counts), 0.0).otherwise(float(tolerance)) if counts else F.lit(float(tolerance))
    is_text = F.col("field").isin(*texts) if texts else F.lit(False)
    passed = F.when(is_text, F.col("reproduced_text").eqNullSafe(F.col("frozen_text"))).otherwise(difference <= limit)
    status = F.when(passed, "PASS")
    if corrected is not None:
        status = status.when(corrected, "CORRECTED_FROZEN_METADATA")
    return joined.select(
        *keys, "field", "frozen_value", "reproduced_value", "frozen_text", "reproduced_text",
        F.when(~is_text, difference).alias("absolute_difference"), F.when(~is_text, limit).alias("tolerance"),
        status.otherwise("FAIL").alias("status"),
    )


def regression_status(comparison: DataFrame) -> DataFrame:
    """Roll-up: FAIL if any field fails, else PASS, with counts per status."""
    return comparison.agg(
        F.count(F.lit(1)).alias("fields_n"), count_true(F.col("status") == "PASS").alias("pass_n"),
        count_true(F.col("status") == "CORRECTED_FROZEN_METADATA").alias("corrected_n"), count_true(F.col("status") == "FAIL").alias("fail_n"),
    ).withColumn("status", F.when(F.col("fail_n") > 0, "FAIL").otherwise("PASS"))


def align_regimes(df: DataFrame, index: Sequence[str], regime: str, regimes: Sequence[str], value: str) -> DataFrame:
    """One row per index with a column per regime; a regime missing for any row fails the job."""
    wide = df.groupBy(*index).agg(*[F.max(F.when(F.col(regime) == r, F.col(value))).alias(r) for r in regimes])
    gap = F.raise_error(F.lit("prediction rows are not aligned across training regimes")).cast("double")
    return wide.select(*index, *[F.coalesce(F.col(r), gap).alias(r) for r in regimes])


def tuning_summary(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median fold metrics and objective per candidate; a candidate has one row per fold."""
    out = scores.groupBy(*keys, "candidate_index").agg(
        F.count_distinct("fold_index").alias("folds"), F.median("auroc").alias("median_auroc"), F.median("auprc").alias("median_auprc")
    )
    return out.withColumn("objective", F.col("median_auroc") + 0.05 * F.col("median_auprc"))


def best_candidate(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest objective, then AUROC, then AUPRC, then the lowest index.

    Values are compared to 12 digits, so that the order of additions cannot decide between equals.
    """
    rest = F.struct(*[F.col(c) for c in summary.columns if c not in keys])
    values = [F.round(c, 12).alias(c) for c in ("objective", "median_auroc", "median_auprc")]
    order = F.struct(*values, (-F.col("candidate_index")).alias("i"))
    return summary.groupBy(*keys).agg(F.max_by(rest, order).alias("_b")).select(*keys, "_b.*")


# --- digests -----------------------------------------------------------------------------------

def row_text(columns: Sequence[str], separator: str = "\t") -> Column:
    return F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in columns]), separator)


def tree_digest(df: DataFrame, keys: Sequence[str], payload: Column) -> DataFrame:
    """SHA-256 of the multiset of row texts of each group, for groups of any size.

    Row hashes are combined by their first four, then two, hex digits, then per group. Equal
    membership gives equal digests; a task only ever sees about 1/65536 of a group.
    """
    keys = list(keys)
    hashed = df.select(*keys, F.sha2(payload, 256).alias("_h")).withColumn("_p4", F.substring("_h", 1, 4))
    node = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    low = hashed.groupBy(*keys, "_p4").agg(node("_h").alias("_d"), F.count(F.lit(1)).alias("_n"))
    middle = low.groupBy(*keys, F.substring("_p4", 1, 2).alias("_p2")).agg(
        node(F.concat("_p4", "_d")).alias("_d"), F.sum("_n").alias("_n")
    )
    return middle.groupBy(*keys).agg(node(F.concat("_p2", "_d")).alias("tree_sha256"), F.sum("_n").alias("n"))


def membership_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], day: str, sample: str, *, separator: str = "\t") -> DataFrame:
    """Digest of the rows of each group in the order of (day, sample id), for groups of any size.

    A row's text begins with its position, so equal digests mean equal rows in equal order.
    """
    placed = row_ordinal(df, keys, day, sample, "_place")
    return tree_digest(placed, keys, row_text(["_place", *columns], separator))


def fold_digest(folds: DataFrame, keys: Sequence[str], sample: str = "sample_id") -> DataFrame:
    """Digest of the (fold, split, sample) membership of each group; the order of the rows does not count."""
    return tree_digest(folds, keys, row_text(["fold_index", "split", sample]))


# --- ordinals ----------------------------------------------------------------------------------

PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits


def row_ordinal(df: DataFrame, keys: Sequence[str], day: str, sample: str, out: str = "row_order") -> DataFrame:
    """0-based position by (day, sample id) within each group, for groups of any size.

    The rows are range-partitioned by the whole order, so a group or a day with a third of all rows is
    spread over many tasks, and stored. A position is the row's place in its stored partition plus
    the rows of its group in earlier partitions; there is one small row per partition and group.
    """
    keys = list(keys)
    bad = F.raise_error(F.lit("row without a date")).cast(df.schema[day].dataType)
    order = [*keys, day, sample]
    dated = df.withColumn(day, F.coalesce(F.col(day), bad))
    ordered = dated.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    stored = cut_lineage(ordered).withColumn("_part", F.shiftright("_place", PARTITION_SHIFT))
    parts = stored.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_start"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "_part", "_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    placed = stored.join(checked_broadcast(starts), [*keys, "_part"])
    return placed.select(*df.columns, (F.col("_before") + F.col("_place") - F.col("_start")).alias(out))
