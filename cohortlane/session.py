"""Session settings shared by tests, the benchmark and stand-alone runs."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings a cluster would also carry (AQE, UTC, Arrow)."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cohortlane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")  # keep small test inputs parallel
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the cluster's shared checkpoint folder and continue from the stored copy.

    Model fits read the same rows dozens of times, so they start from stored data that survives
    the loss of executors. A session on a cluster must name the folder in ``spark.checkpoint.dir``.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's own folder within ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def packed(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage`, but stored by columns and compressed: for wide rows whose texts repeat, of which some columns are read at a time."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/packed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which its cleaner does once the driver has collected the jobs' objects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
