"""Rules over text counts with cutoffs that keep false rejections within a stated risk, per stratum.

A quarter of the labelled clean documents (by hash) fixes a ladder of ever stricter cutoffs. On the first rungs each rule rejects
above a multiple of the largest value of that quarter, which few other clean documents reach; on the later ones above its (1 - RUNGS[k] / number of
rules) quantile. On the other three quarters rungs are tested from the mildest on: the exact binomial (Clopper-Pearson) upper
bound of the share of clean documents that any rule rejects must not exceed ``RISK``. Testing stops at the first rung that fails
(fixed-sequence testing, which needs no correction along the ladder), and the error level is divided by the number of tests (Bonferroni).
Strata that could not prove the risk even without one rejection are tested as one pooled stratum; that is decided by
numbers of labels alone. With confidence 1 - ``LEVEL`` no stratum, and not the pooled one, loses more than ``RISK`` of its clean documents to the
rules. Where no rung passes, and in strata without a label, everything stays that the fixed base rules keep.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, textstats

RISK = 0.02
LEVEL = 0.05
MULTIPLES = (8.0, 4.0, 2.0, 1.5, 1.25)
LEAST_CUT = 0.01  # multiples are taken of no less than this
RUNGS = (0.0005, 0.001, 0.002, 0.004, 0.006, 0.008, 0.01, 0.012, 0.014, 0.016, 0.018)
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

#: Ratios that are larger in worse texts.
RULES = {
    "symbols_per_word": "n_symbols / n_words",
    "symbol_words": "n_symbol_words / n_words",
    "shouts_per_word": "n_shout / n_words",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "bars_per_word": "n_bars / n_words",
    "same_next": "n_same_next / n_words",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / n_words",
}


def upper_bound(rejected: int, n: int, level: float) -> float:
    """Clopper-Pearson: the share p at which ``rejected`` or fewer of ``n`` has probability ``level``."""
    if n == 0 or rejected >= n:
        return 1.0

    def at_most(p: float) -> float:
        log_p, log_q = math.log(p), math.log1p(-p)
        top = math.lgamma(n + 1)
        terms = [top - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * log_p + (n - k) * log_q for k in range(rejected + 1)]
        most = max(terms)
        return math.exp(most) * sum(math.exp(t - most) for t in terms)

    low, high = rejected / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if middle <= 0 or at_most(middle) > level else (low, middle)
    return high


def _ratio(rule: str) -> Column:
    return F.when(F.col("n_words") > 0, F.expr(RULES[rule])).otherwise(F.lit(0.0)).cast("double")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _grouped(held_out: DataFrame, risk: float, level: float) -> DataFrame:
    """stratum, tested_as: a stratum with enough held-out documents stands for itself, the others are pooled (``*``)."""
    sizes = held_out.groupBy("stratum").agg(F.count("*").alias("n"))
    strata = sizes.agg(F.count("*").alias("strata"))  # one row
    enough = F.ceil(F.log(F.lit(level) / F.col("strata")) / math.log1p(-risk))
    return sizes.join(F.broadcast(strata)).select("stratum", F.when(F.col("n") >= enough, F.concat(F.lit("="), "stratum")).otherwise("*").alias("tested_as"))


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, rungs: tuple[float, ...] = RUNGS,
            multiples: tuple[float, ...] = MULTIPLES) -> DataFrame:
    """stratum, tested_as, rung, clean, rejected, cut_<rule>…: one row per stratum for which a rung passed.

    ``counted`` has doc_id, stratum and the counts; ``labels`` doc_id and clean (boolean). Documents that fail
    the fixed base rules are left out, because they are rejected anyway. Several labels of a document count as clean only if all are.
    ``clean`` and ``rejected`` count the held-out clean documents of the test.
    """
    names, steps = list(RULES), len(multiples) + len(rungs)
    told = labels.dropna().groupBy("doc_id").agg(F.bool_and("clean").alias("clean")).filter("clean")
    clean = shared.stored(
        counted.filter(~base_failed()).join(told, "doc_id").select(
            "stratum", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0).alias("tuning"), *(_ratio(r).alias(r) for r in names)
        )
    )
    groups = shared.stored(_grouped(clean.filter("not tuning"), risk, level))
    clean = clean.join(groups, "stratum")
    shares = F.array(*(F.lit(1 - r / len(names)) for r in rungs))
    ladder = clean.filter("tuning").groupBy("tested_as").agg(
        *(F.concat(F.array(*(m * F.greatest(F.max(r), F.lit(LEAST_CUT)) for m in multiples)), F.percentile_approx(r, shares, 20_000)).alias(f"cut_{r}") for r in names)
    )
    rejecting = F.array(*(F.greatest(*(F.when(F.col(r) > F.col(f"cut_{r}")[k], 1).otherwise(0) for r in names)) for k in range(steps)))
    # rungs are nested, so the number of rungs that reject says which
    held = (
        clean.filter("not tuning").join(ladder, "tested_as")
        .select("tested_as", F.aggregate(rejecting, F.lit(0), lambda a, x: a + x).alias("rejecting_rungs"))
        .groupBy("tested_as").agg(F.count("*").alias("clean"), *(F.sum((F.col("rejecting_rungs") >= steps - k).cast("long")).alias(f"rejected_{k}") for k in range(steps)))
    )
    tests = F.broadcast(held.agg(F.count("*").alias("tests")))  # one row

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            passed = []
            for row in frame.itertuples(index=False):
                rung, rejected = -1, 0
                for k in range(steps):
                    if upper_bound(int(getattr(row, f"rejected_{k}")), int(row.clean), level / int(row.tests)) > risk:
                        break
                    rung, rejected = k, int(getattr(row, f"rejected_{k}"))
                passed.append((row.tested_as, rung, row.clean, rejected))
            yield pd.DataFrame(passed, columns=["tested_as", "rung", "clean", "rejected"])

    picked = held.join(tests).mapInPandas(chosen, "tested_as string, rung int, clean long, rejected long").filter("rung >= 0")
    return groups.join(picked.join(ladder, "tested_as"), "tested_as").select(
        "stratum", "tested_as", "rung", "clean", "rejected", *(F.col(f"cut_{r}")[F.col("rung")].alias(f"cut_{r}") for r in names)
    )


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang",
          label_column: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, stratum, rung, tested_as of every row of ``docs``.

    Null and empty texts have no words and fail the base rules. A null stratum is the stratum ''. A stratum without cutoffs has
    rung and tested_as null and keeps what passes the base rules. Rows with a null id are judged, but never labelled. Other columns are not read.
    """
    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_column).cast("string"), F.lit("")).alias("stratum"), F.col(text_column).alias("text")
    )
    counted = shared.stored(textstats.with_counts(source, "text", ["doc_id", "stratum"]))
    told = labels.select(F.col(id_column).cast("long").alias("doc_id"), (F.col(label_column) == 1).alias("clean"))
    chosen = shared.stored(cutoffs(counted, told, risk, level))
    over = F.lit(False)
    for r in RULES:
        over = over | (_ratio(r) > F.col(f"cut_{r}"))
    failed = base_failed()
    return counted.join(chosen, "stratum", "left").select(
        "doc_id", *textstats.BASE, failed.alias("base_failed"), (~failed & ~F.coalesce(over, F.lit(False))).alias("kept"), "stratum", "rung", "tested_as"
    )
