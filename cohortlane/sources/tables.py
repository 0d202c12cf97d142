"""Table and peak-file sources, and sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PEAK_SCHEMA = T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())])
# File suffix to (format, separator).
SUFFIXES = {
    "parquet": ("parquet", None), "pq": ("parquet", None),
    "csv": ("csv", ","), "txt": ("csv", ","), "tsv": ("csv", "\t"),
}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read by suffix: parquet/pq, csv/txt (comma), tsv (tab), and their .gz forms.

    Text files need a schema; types are never inferred by a second pass over the data.
    """
    name = path.lower().rstrip("/")
    suffix = name.removesuffix(".gz").rsplit(".", 1)[-1]
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported table type: {path}")
    kind, separator = SUFFIXES[suffix]
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if schema is None:
        raise ValueError(f"a schema is needed to read {path}")
    return reader.csv(path, header=True, sep=separator, mode="FAILFAST")


def read_peak_tables(spark: SparkSession, folder: str, pattern: str = "*.tsv") -> DataFrame:
    """All peak files of a folder as one long table; the spectrum id is the file name without suffix.

    Small files are packed into scan tasks by the reader. A value that is no number fails the job.
    """
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.(tsv|txt|csv)(\.gz)?$", "")
    return (
        spark.read.schema(PEAK_SCHEMA)
        .csv(folder, header=True, sep="\t", mode="FAILFAST", pathGlobFilter=pattern)
        .select(name.alias("spectrum_id"), "mz", "intensity")
    )


def missing_spectra(metadata: DataFrame, peaks: DataFrame) -> DataFrame:
    """Spectra of the metadata without any peak row."""
    return metadata.join(peaks.select("spectrum_id").distinct(), "spectrum_id", "left_anti")


def write_new(df: DataFrame, path: str, *, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write a result; an existing path is an error, never replaced."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(kind).save(path)


def write_predictions(df: DataFrame, path: str | None) -> None:
    """Row-level predictions are written only where a path is given."""
    if path:
        write_new(df, path, partition_by=tuple(c for c in ("task",) if c in df.columns))
