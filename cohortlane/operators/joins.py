"""Joins that check their keys: each fails the job, or reports, where rows are missing or repeated."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.operators.contracts import all_checks, duplicate_keys, rows_where

RELATIONS = ("1:1", "m:1")


def _text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<NA>")) for k in keys])


def _fail(message: str, keys: Sequence[str], kind) -> Column:
    return F.raise_error(F.concat(F.lit(f"{message}: "), _text(keys))).cast(kind)


def _one_per_key(df: DataFrame, keys: Sequence[str], out: str, name: str) -> DataFrame:
    """One row per key with the other columns as a struct; a repeated key fails. Aggregation combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.first(F.struct(*rest, F.lit(True).alias("_there"))).alias("_v"), F.count(F.lit(1)).alias("_n"))
    value = F.when(F.col("_n") == 1, F.col("_v")).otherwise(_fail(f"repeated key in {name}", keys, grouped.schema["_v"].dataType))
    return grouped.select(*keys, value.alias(out))


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], *, required: bool = True) -> DataFrame:
    """All rows of ``left`` with the columns of ``right``, whose keys must be unique.

    With ``required`` a row without a partner fails the job, else it gets NULLs. A NULL key has no partner.
    """
    keys = list(keys)
    clash = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if clash:
        raise ValueError(f"columns on both sides of a join: {clash}")
    found = left.join(_one_per_key(right, keys, "_right", "the right side"), keys, "left")
    value = F.col("_right")
    if required:
        value = F.when(value.isNotNull(), value).otherwise(_fail("row without a partner", keys, found.schema["_right"].dataType))
    checked = found.withColumn("_right", value)
    return checked.select(*left.columns, *[F.col(f"_right.{c}").alias(c) for c in right.columns if c not in keys])


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides joined on unique keys; a key on one side only, repeated or NULL fails the job."""
    keys = list(keys)
    clash = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if clash:
        raise ValueError(f"columns on both sides of a join: {clash}")
    both = _one_per_key(left, keys, "_left", "the left side").join(_one_per_key(right, keys, "_right", "the right side"), keys, "full")
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.col("_left").isNotNull() & F.col("_right").isNotNull())
    checked = both.withColumn("_left", F.when(whole, F.col("_left")).otherwise(_fail("key without a partner", keys, both.schema["_left"].dataType)))
    columns = [F.col(f"_left.{c}").alias(c) for c in left.columns if c not in keys] + [F.col(f"_right.{c}").alias(c) for c in right.columns if c not in keys]
    return checked.select(*keys, *columns)


def join_checks(left: DataFrame, right: DataFrame, keys: Sequence[str], relation: str, name: str) -> DataFrame:
    """Check rows for a join of ``relation`` 1:1 or m:1: repeated keys, and keys without a partner."""
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation: {relation}")
    keys = list(keys)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys, "full")
    counts = counts.withColumn("_key", _text(keys))
    checks = [rows_where(counts.where(F.col("_l").isNotNull()), F.col("_r").isNull(), "_key", f"{name}:left_without_right"), duplicate_keys(right, keys, f"{name}:right_key")]
    if relation == "1:1":
        checks += [duplicate_keys(left, keys, f"{name}:left_key"), rows_where(counts.where(F.col("_r").isNotNull()), F.col("_l").isNull(), "_key", f"{name}:right_without_left")]
    return all_checks(checks)


def split_join(rows: DataFrame, splits: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Rows with their split. Every split row must find its row, every split key be unique; rows outside the split table are left out."""
    chosen = splits.select(*keys, split)
    return many_to_one(chosen, rows, keys)


def union_parts(parts: Sequence[DataFrame], keys: Sequence[str], schema: str | None = None) -> DataFrame:
    """Union of tables that may lack columns (NULL there); a key in two rows fails the job.

    No parts give an empty table of ``schema``.
    """
    if not parts:
        if schema is None:
            raise ValueError("no parts and no schema")
        from pyspark.sql import SparkSession

        return SparkSession.active().createDataFrame([], schema)
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _one_per_key(whole, list(keys), "_v", "the union").select(*[c if c in keys else F.col(f"_v.{c}").alias(c) for c in whole.columns])
