"""Scalar column builders: usable text, flags, endpoints, seeds, ids, clipped logit, safe ratios."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mean "no feature available" and "conflict" in text flags.
UNAVAILABLE_WORDS = ("", "0", "false", "no", "n", "missing", "unavailable")
CONFLICT_WORDS = ("1", "true", "yes", "y", "conflict")
SIR_VALUES = ("S", "I", "R")
LOGIT_CLIP = 1e-6
SEED_RANGE = 1_000_000


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def usable(value: str | Column) -> Column:
    """True where a text key is neither NULL nor blank."""
    text = col(value).cast("string")
    return F.coalesce(F.trim(text) != "", F.lit(False))


def text_or_empty(value: str | Column) -> Column:
    return F.coalesce(F.trim(col(value).cast("string")), F.lit(""))


def susceptibility(value: str | Column) -> Column:
    """Trimmed upper-case category text; NULL becomes blank."""
    return F.upper(text_or_empty(value))


def binary_endpoint(sir: str | Column, *, positive: tuple[str, ...] = ("I", "R")) -> Column:
    """0/1 endpoint: listed categories are positive, the other S/I/R values negative, the rest NULL."""
    value = susceptibility(sir)
    negative = [c for c in SIR_VALUES if c not in positive]
    return F.when(value.isin(*positive), F.lit(1)).when(value.isin(*negative), F.lit(0))


def availability_flag(value: str | Column, dtype: T.DataType) -> Column:
    """Feature availability by column type: booleans as they are, row numbers >= 0, text not a 'no' word."""
    value = col(value)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(value >= 0, F.lit(False))
    return ~F.lower(text_or_empty(value)).isin(*UNAVAILABLE_WORDS)


def conflict_flag(value: str | Column, dtype: T.DataType) -> Column:
    """Source conflict by column type: booleans, non-zero numbers, or a 'yes' word."""
    value = col(value)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(value != 0, F.lit(False))
    return F.lower(text_or_empty(value)).isin(*CONFLICT_WORDS)


def combination_id(*keys: str | Column) -> Column:
    """Short stable id of an identity triple: prefix and 16 hex digits of its SHA-256."""
    joined = F.concat_ws("\x1f", *[col(k) for k in keys])
    return F.concat(F.lit("cmb_"), F.substring(F.sha2(joined, 256), 1, 16))


def derived_seed(seed: int, *parts: str | Column) -> Column:
    """Seed per row from a base seed and key columns."""
    digest = F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.lit(seed).cast("bigint") + number % SEED_RANGE


def derived_seed_value(seed: int, *parts: object) -> int:
    """The same seed for driver-side use (model constructors)."""
    digest = hashlib.sha256("|".join(str(p) for p in parts).encode("utf-8")).hexdigest()
    return seed + int(digest[:8], 16) % SEED_RANGE


def clipped_logit(probability: str | Column) -> Column:
    p = F.greatest(F.lit(LOGIT_CLIP), F.least(F.lit(1 - LOGIT_CLIP), col(probability)))
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient as DOUBLE, NULL (not estimable) for a zero denominator."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def joined_unique(values: Column, separator: str = "|") -> Column:
    """Distinct, trimmed, non-blank values of an array, sorted without case first, joined as text."""
    cleaned = F.filter(
        F.transform(values, lambda v: F.trim(v.cast("string"))), lambda v: v.isNotNull() & (v != "")
    )
    keyed = F.array_sort(F.array_distinct(F.transform(cleaned, lambda v: F.struct(F.lower(v).alias("k"), v.alias("v")))))
    return F.array_join(F.transform(keyed, lambda s: s["v"]), separator)


def canonical_json(**fields: Column) -> Column:
    """JSON text with the fields in key order."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def count_true(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
