"""Broadcast joins behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ROW_LIMIT = 20_000
TASK_ROWS = 250_000


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_ROW_LIMIT) -> DataFrame:
    """Mark ``df`` for broadcasting if it has at most ``max_rows`` rows, else return it unchanged.

    Meant for parameter-like tables (fold borders, thresholds, cluster totals per task). At most
    ``max_rows + 1`` rows are fetched; a larger table is left to an ordinary shuffle join.
    """
    fetched = df.limit(max_rows + 1).toArrow()
    if fetched.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(fetched, schema=df.schema))


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores if it has fewer splits than there are cores.

    A table of one row group is read by one task, and per-row work would stay in it. Tables with
    enough splits, the normal case, are returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, *keys: str, rows: int | None = None, task_rows: int | None = None) -> DataFrame:
    """Deal ``df`` by ``keys`` to as many tasks as its rows need, so that the memory of a task does not grow with the table.

    With a fixed number of shuffle partitions a task gets a fixed share of any table. Aggregations by ``keys`` and more columns,
    and joins by ``keys``, go on in these tasks. ``rows`` is the number of rows; without it they are counted, which for columns
    read from Parquet looks at file footers only. Tables of at most ``task_rows`` (else ``TASK_ROWS``) rows per core are returned unchanged.
    """
    tasks = -(-(df.count() if rows is None else rows) // (task_rows or TASK_ROWS))
    return df if tasks <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(tasks, *keys)
