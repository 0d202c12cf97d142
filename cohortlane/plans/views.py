"""The given tables seen as samples, labels, peaks, predictions and embeddings."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.operators.cohorts import ProtocolDates
from cohortlane.sized import dealt, spread
from cohortlane.sources.tables import read_table

DATES = ProtocolDates(
    transition_start=date(1998, 1, 1), transition_end=date(1998, 1, 31), current_start=date(1998, 2, 1), current_end=date(1999, 12, 31),
    test_start=date(2000, 2, 1), test_end=date(2001, 8, 1),
)
DEVELOPMENT = (date(1995, 1, 1), date(1999, 12, 31))
TEST = (DATES.test_start, DATES.test_end)


# Column contracts of the given tables; reading with them needs no job to look at file footers.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", TABLES[name])


def floor_to(value: Column, steps: int) -> Column:
    """Cut to a grid of 1/steps; the same floating-point value in every engine."""
    return F.floor(value * F.lit(float(steps))) / F.lit(float(steps))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: sample, site, cluster (NULL and blank occur), date, task, category, label, scores."""
    key = F.col("o_orderkey")
    raw = F.floor(F.col("o_totalprice") / F.lit(500.0)) / F.lit(1000.0)
    return table(spark, folder, "orders").select(
        key.alias("sample_id"),
        F.when(key % 4 == 0, "B").otherwise("A").alias("site_id"),
        F.when(key % 23 == 0, F.lit(None)).when(key % 29 == 0, "").otherwise(F.concat("o_custkey", F.lit("_"), key % 8)).alias("cluster_id"),
        F.to_date("o_orderdate").alias("d"),
        F.col("o_orderdate").alias("ts"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("task"),
        F.when(F.col("o_orderstatus") == "O", "S").when(F.col("o_orderstatus") == "P", "I").otherwise("R").alias("sir"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("y"),
        F.when(key % 17 == 0, -1).otherwise(key).alias("feature_row"),
        raw.alias("raw"),
        floor_to(1 - raw * F.lit(0.9), 100).alias("alt"),
        (F.lit(0.1) + F.lit(0.8) * raw).alias("calibrated"),
    )


def within(df: DataFrame, days: tuple[date, date]) -> DataFrame:
    """Rows of an inclusive date window. The stored timestamp is compared too, so the scan can skip files and row groups."""
    out = df.where(F.col("d").between(F.lit(days[0]), F.lit(days[1])))
    if "ts" in df.columns:
        bound = lambda day: F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp_ntz")
        out = out.where((F.col("ts") >= bound(days[0])) & (F.col("ts") < bound(days[1] + timedelta(days=1))))
    return out


def development(df: DataFrame) -> DataFrame:
    return within(df, DEVELOPMENT)


def test_rows(df: DataFrame) -> DataFrame:
    return within(df, TEST)


# Panel of ten tasks over (type, brand) pairs; the last pair does not occur.
PANEL_PAIRS = (
    ("ECONOMY", "Brand#1"), ("ECONOMY", "Brand#2"), ("LARGE", "Brand#3"), ("LARGE", "Brand#4"), ("MEDIUM", "Brand#5"),
    ("MEDIUM", "Brand#6"), ("PROMO", "Brand#7"), ("SMALL", "Brand#8"), ("STANDARD", "Brand#9"), ("STANDARD", "Brand#99"),
)
PANEL = [
    {"task_id": f"T{i:02d}", "organism": t, "drug": b, "category": "literature_anchor" if i < 3 else "local_extension",
     "evidence": "documented" if i % 2 else ""}
    for i, (t, b) in enumerate(PANEL_PAIRS)
]


def ast_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One label row per line item: identity from the part, year from the order.

    Orders are joined last and by the sample id, so rows stay dealt by sample for the aggregation and the join that follow.
    """
    sample_id = lambda key: F.col(key).cast("string").alias("sample_id")
    items = spread(table(spark, folder, "lineitem").select(
        sample_id("l_orderkey"), "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax", "l_returnflag"
    ))
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    orders = table(spark, folder, "orders").select(sample_id("o_orderkey"), "o_orderdate")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey").join(orders, "sample_id")
    key = F.col("sample_id").cast("bigint")
    organism = (
        F.when(key % 101 == 0, "").when(key % 5 == 0, F.concat(F.lit("  "), F.lower("p_type"), F.lit(" "))).otherwise(F.col("p_type"))
    )
    core = F.lit("")
    for task, (kind, brand) in zip(PANEL, PANEL_PAIRS, strict=True):
        core = F.when((F.col("p_type") == kind) & (F.col("p_brand") == brand), F.lit(task["task_id"])).otherwise(core)
    return joined.select(
        F.when(key % 4 == 0, "B").otherwise("A").alias("site_id"),
        "sample_id",
        F.year("o_orderdate").alias("year"),
        organism.alias("organism"),
        F.col("p_brand").alias("drug_code"),
        F.lower("p_brand").alias("drug_name"),
        F.when(F.col("l_returnflag") == "N", "S").when(F.col("l_returnflag") == "A", "i ").otherwise("R").alias("sir"),
        (F.col("l_tax") == 0.08).alias("conflict"),
        core.alias("core_task"),
        "l_linenumber", "l_suppkey", "l_extendedprice",
    )


LABEL_ORDER = ("l_linenumber", "l_suppkey", "l_extendedprice", "sir")


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    """One peak per line item; ten consecutive orders are the replicate spectra of a sample."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("spectrum_id"),
        F.floor(F.col("l_orderkey") / 10).alias("sample_id"),
        (F.lit(2000.0) + F.col("l_extendedprice") / F.lit(5.5)).alias("mz"),
        F.col("l_quantity").alias("intensity"),
    )


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    """Spectrum list; every order is a spectrum, also those without a peak."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("spectrum_id"), F.floor(F.col("o_orderkey") / 10).alias("sample_id")
    )


def profile_peaks(spark: SparkSession, folder: str) -> DataFrame:
    return peaks(spark, folder).select(F.floor(F.col("spectrum_id") / 250).alias("spectrum_id"), "mz", "intensity")


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Dense profiles: the peaks of 250 consecutive orders on one axis, about a thousand points each; dealt by profile."""
    return dealt(profile_peaks(spark, folder), "spectrum_id").groupBy("spectrum_id", "mz").agg(F.max("intensity").alias("intensity"))


def profile_list(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles' ids, without their points."""
    return profile_peaks(spark, folder).select("spectrum_id").distinct()


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Feature arrays with a binary label; blocks 0..3 develop in order, block 4 tests."""
    key = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        F.lit("emb").alias("task"), key.alias("sample_id"), F.concat(F.lit("c"), F.floor(key / 3)).alias("cluster_id"),
        F.col("embedding").alias("values"), F.when(F.col("label") < 5, 1).otherwise(0).alias("y"), (key % 5).alias("block"),
    )
