"""File manifests and text audits."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.functions.columns import count_true

# Patterns of private locations in text.
PRIVATE_PATTERNS = {
    "mac_absolute_home": r"/Users/[A-Za-z0-9._-]+/",
    "linux_absolute_home": r"/home/[A-Za-z0-9._-]+/",
    "private_ipv4": r"\b(?:10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})\b",
    "windows_absolute_path": r"\b[A-Za-z]:\\[^\s]+",
}
# File types that must not be in a public code release.
FORBIDDEN_SUFFIXES = (
    ".mzml", ".spectrum", ".db", ".sqlite", ".pkl", ".joblib", ".pt", ".pth", ".ckpt", ".parquet", ".feather", ".h5", ".hdf5", ".xlsx", ".xls",
)


WHOLE = 128 << 20  # bytes of a file that is hashed as one value
PIECE = 8 << 20


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with their SHA-256, read piece by piece."""
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            place = re.sub(r"^file:/+", "/", path)
            system, name = (fs.LocalFileSystem(), place) if place.startswith("/") else fs.FileSystem.from_uri(place)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "length", "sha256"])


def artifact_manifest(spark: SparkSession, root: str, pattern: str = "*", size_limit: int | None = None) -> DataFrame:
    """Path below ``root``, bytes and SHA-256 of all files under it.

    The content of a file of at most ``WHOLE`` bytes is one value; a larger one, of any size, is read piece by piece. A SHA-256 is computed
    from the first byte to the last, so one task reads a file. With ``size_limit`` larger files are listed without a digest.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    read = F.lit(True) if size_limit is None else F.col("length") <= size_limit
    small = F.col("length") <= WHOLE
    hashed = files.where(read & small).select("path", "length", F.sha2("content", 256).alias("sha256"))
    hashed = hashed.unionByName(files.where(read & ~small).select("path", "length").mapInArrow(_streamed, "path string, length long, sha256 string"))
    hashed = hashed.withColumn("hash_status", F.lit("hashed"))
    if size_limit is not None:
        hashed = hashed.unionByName(files.where(~read).select(
            "path", "length", F.lit(None).cast("string").alias("sha256"), F.lit("skipped_size").alias("hash_status")
        ))
    folder = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", root).rstrip("/") + "/"
    below = F.expr("substring(path, position(folder in path) + length(folder))")
    return hashed.withColumn("folder", F.lit(folder)).select(below.alias("relative_path"), F.col("length").alias("bytes"), "sha256", "hash_status")


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Expected files, missing files and mismatches; PASS only if both counts are zero.

    An empty manifest, or one that lists a path twice, fails the job.
    """
    right = files.groupBy("relative_path").agg(F.max("sha256").alias("_found"), F.lit(True).alias("_there"))
    listed = manifest.groupBy("relative_path").agg(F.count(F.lit(1)).alias("_n"), F.max("sha256").alias("sha256"))
    joined = listed.join(right, "relative_path", "left")
    counts = joined.agg(
        F.count(F.lit(1)).alias("files_n"), F.coalesce(F.max("_n"), F.lit(0)).alias("_most"),
        count_true(F.col("_there").isNull()).alias("missing_n"),
        count_true(F.col("_there").isNotNull() & ~F.col("_found").eqNullSafe(F.col("sha256"))).alias("mismatch_n"),
    )
    checked = F.when(F.col("_most") == 1, F.col("files_n")).otherwise(
        F.raise_error(F.lit("manifest is empty or lists a path twice")).cast("bigint")
    )
    ok = (F.coalesce("missing_n", F.lit(0)) == 0) & (F.coalesce("mismatch_n", F.lit(0)) == 0)
    return counts.select(
        checked.alias("files_n"), F.coalesce("missing_n", F.lit(0)).alias("missing_n"), F.coalesce("mismatch_n", F.lit(0)).alias("mismatch_n"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
    )


def pattern_audit(df: DataFrame, key: str, text: str, patterns: Mapping[str, str] = PRIVATE_PATTERNS) -> DataFrame:
    """One finding per (row, pattern) with its number of matches, over whole texts.

    The pattern list is fixed, so all counts are taken within the row: no join and no shuffle.
    """
    hits = F.array(*[
        F.struct(F.lit(name).alias("pattern"), F.regexp_count(F.col(text), F.lit(rx)).cast("bigint").alias("match_n")) for name, rx in patterns.items()
    ])
    return df.select(key, F.explode(hits).alias("h")).select(key, "h.pattern", "h.match_n").where(F.col("match_n") > 0)


def forbidden_files(files: DataFrame, size_limit: int) -> DataFrame:
    """Findings on a file list: forbidden suffix or size above the limit."""
    lower = F.lower("relative_path")
    bad_suffix = F.lit(False)
    for suffix in FORBIDDEN_SUFFIXES:
        bad_suffix = bad_suffix | lower.endswith(suffix)
    findings = F.array_compact(F.array(F.when(bad_suffix, F.lit("forbidden_suffix")), F.when(F.col("bytes") > size_limit, F.lit("size_limit"))))
    return files.select("relative_path", F.explode(findings).alias("finding"))
