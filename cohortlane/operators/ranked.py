"""Exact running totals along a score without ever gathering a whole group in one task.

A group (say, one task with a third of all predictions) can have any number of distinct scores.
Scores are first reduced to one row per distinct value, then cut into nested equal-width buckets.
A running total is the total of the buckets above at each level plus the running total inside
the innermost bucket; each window sees either one bucket's scores or at most a few thousand buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of the score used by each bucket level: 2^12 buckets per group, each cut into 2^12 again.
BUCKET_BITS = (12, 24)


def checked_score(score: str, y: str) -> Column:
    """The score, failing the job where it is missing or outside [0, 1] or the label is not 0 or 1."""
    valid = F.coalesce((F.col(score) >= 0) & (F.col(score) <= 1) & F.col(y).isin(0, 1), F.lit(False))  # NaN is above every number
    message = F.concat(F.lit("score outside [0, 1] or label outside 0/1: "), F.coalesce(F.col(score).cast("string"), F.lit("NULL")), F.lit(", "), F.coalesce(F.col(y).cast("string"), F.lit("NULL")))
    return F.when(valid, F.col(score)).otherwise(F.raise_error(message).cast("double"))


def score_table(
    df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y", weight: str | Column | None = None
) -> DataFrame:
    """One row per group and distinct score with (weighted) positive and negative counts; a bad score or label fails."""
    w = F.lit(1) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    return df.groupBy(*keys, checked_score(score, y).alias(score)).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(y) == 0, w).otherwise(0)).cast("bigint").alias("neg"),
    )


def running_totals(
    leaf: DataFrame, keys: Sequence[str], score: str = "score", measures: Sequence[str] = ("pos", "neg"),
    *, with_next: bool = False, bits: Sequence[int] = BUCKET_BITS,
) -> DataFrame:
    """Add ``above_<m>`` (total over higher scores) and ``total_<m>`` (group total) to a score table.

    ``leaf`` has one row per (keys, score) with scores in [0, 1]. ``with_next`` adds the struct
    ``_next``: the measures at the next lower distinct score.
    """
    keys = list(keys)
    levels = [f"_bucket{i}" for i in range(len(bits))]
    # Bucket numbers are never NULL, so the joins below add no filter that differs between branches
    # and the exchange of the score table is computed once.
    base = leaf
    for name, b in zip(levels, bits, strict=True):
        base = base.withColumn(name, F.coalesce(F.floor(F.col(score) * F.lit(float(2**b))), F.lit(-1)))
    point = F.struct(F.col(score).alias("at"), *[F.col(m) for m in measures])
    base = base.withColumn("_head", point)

    def within(table: DataFrame, parent: Sequence[str], order: str, suffix: str) -> DataFrame:
        ordered = Window.partitionBy(*parent).orderBy(F.col(order).desc())
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        columns = [F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_above_{m}_{suffix}") for m in measures]
        if with_next:
            columns.append(F.lead("_head").over(ordered).alias(f"_next_{suffix}"))
        return table.select("*", *columns)

    # Bucket tables from the innermost level outwards.
    tables = []
    child = base
    for depth in reversed(range(len(levels))):
        child = child.groupBy(*keys, *levels[: depth + 1]).agg(
            *[F.sum(m).alias(m) for m in measures],
            F.max("_head").alias("_head"),
        )
        tables.append((depth, child))

    outer = None
    for depth, table in reversed(tables):
        ranked = within(table, [*keys, *levels[:depth]], levels[depth], str(depth))
        if depth == 0:
            whole = Window.partitionBy(*keys)
            ranked = ranked.select("*", *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures])
        carried = [c for c in ranked.columns if c.startswith(("_above_", "_next_", "total_"))]
        ranked = ranked.select(*keys, *levels[: depth + 1], *carried)
        outer = ranked if outer is None else ranked.join(outer, [*keys, *levels[:depth]])
    leaf_ranked = within(base, [*keys, *levels], score, "leaf")
    joined = leaf_ranked.join(outer, [*keys, *levels])

    suffixes = ["leaf", *[str(d) for d in reversed(range(len(levels)))]]
    out = [F.col(c) for c in leaf.columns]
    for m in measures:
        total = F.col(f"_above_{m}_leaf")
        for s in suffixes[1:]:
            total = total + F.col(f"_above_{m}_{s}")
        out += [total.alias(f"above_{m}"), F.col(f"total_{m}")]
    if with_next:
        out.append(F.coalesce(*[F.col(f"_next_{s}") for s in suffixes]).alias("_next"))
    return joined.select(*out)


def exact_quantiles(leaf: DataFrame, keys: Sequence[str], score: str, count: str, quantiles: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles per group as array ``quantiles``, from a table of (score, count).

    Each wanted order statistic is the one score whose running count covers its rank, so nothing
    but at most two scores per quantile reaches the final aggregation.
    """
    ranked = running_totals(leaf, keys, score, [count])
    n = F.col(f"total_{count}")
    # 0-based ascending rank of the first row at this score.
    first = n - F.col(f"above_{count}") - F.col(count)
    last = first + F.col(count) - 1
    aggregates = []
    for i, q in enumerate(quantiles):
        position = (n - 1) * F.lit(float(q))
        low, high = F.floor(position), F.ceil(position)
        aggregates += [
            F.max(F.when((first <= low) & (low <= last), F.col(score))).alias(f"_lo{i}"),
            F.max(F.when((first <= high) & (high <= last), F.col(score))).alias(f"_hi{i}"),
            F.max(position - low).alias(f"_w{i}"),
        ]
    wide = ranked.groupBy(*keys).agg(*aggregates)
    # Weight 0 keeps the order statistic itself; both forms of the interpolation agree with it.
    value = lambda i: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")
    return wide.select(*keys, F.array(*[value(i) for i in range(len(quantiles))]).alias("quantiles"))
