"""Helpers of the llm operators: shared storage, byte views of text columns, words, hashes, components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in a local session without one, a new folder under /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_folder:
        _own_folder[key] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folder[key]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and continue from the written table.

    Tasks that are repeated after a loss read the same rows again. :func:`release` deletes the tables
    of a session; at the end of the driver it is called for what is left.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def smaller_batches(df: DataFrame, most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """Let the session hand texts to Python in batches of at most ``most_rows`` rows and about ``most_bytes``, which bounds their memory."""
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(conf.get(rows))
    if now <= 0 or now > most_rows:
        conf.set(rows, str(most_rows))
    bound = (conf.get(size, None) or "-1").removesuffix("b")
    if bound == "-1" or bound.isdigit() and int(bound) > most_bytes:  # -1 or unset: no bound
        conf.set(size, str(most_bytes))
    return df


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, whose results are stored tables by now.

    Spark's cleaner deletes them once the driver has collected the jobs' objects, which it else does at some later time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote, or that were made of such tables only, once nothing needs them any more."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
        for item in [x for x in _written if x[1].rsplit("/", 1)[-1] in folders]:
            _delete(item)


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a stored table; the tables stored on the way to it are deleted."""
    before = {path for _, path in _written}
    out = stored(make())
    last = _written[-1][1]
    for item in [x for x in _written if x[0] is spark and x[1] not in before and x[1] != last]:
        _delete(item)
    return out


BITS = 1 << 26


def among(df: DataFrame, column: str, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in the column of that name of ``keys``: all that are, and a share of about
    keys / ``bits`` of the others, so that a join with ``keys`` has less to shuffle. No shuffle of ``df``.

    Keys set bits of a broadcast map of at most ``bits`` / 8 bytes, at any number of keys. With many more keys all rows stay.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    block, place = F.shiftright(bit, 15), bit.bitwiseAND(F.lit(32767))  # bitmap_construct_agg makes maps of 32,768 bits
    maps = keys.select(block.alias("_block"), place.alias("_place")).groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(F.col("_place"), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("_place & 7").cast("int")
    rows = df.select("*", block.alias("_block"), place.alias("_place")).join(F.broadcast(maps), "_block")
    return rows.filter(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), hit)) != 0).select(*df.columns)


def release(spark: SparkSession) -> None:
    """Delete all tables that :func:`stored` wrote in this session."""
    for item in [x for x in _written if x[0] is spark]:
        _delete(item)


def _delete(item: tuple[SparkSession, str]) -> None:
    spark, path = item
    _written.remove(item)
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at the end of the driver
        return


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        if spark.sparkContext._jsc is not None:
            release(spark)


# --- running totals of groups of any size -------------------------------------------------------------------------


def running(df: DataFrame, group: list[str], order: list[str], rank: str, xors: dict[str, str] | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the 0-based place of each row in its group, and running values up to and with the row, without a window over a group.

    ``xors`` and ``sums`` map a new column to the integer column whose running exclusive or, or sum, it holds. Rows are dealt
    by ranges of (group, order), so a group of any size is spread over tasks; within a range windows count, and a
    range gets what its first group had before it. Rows that tie in ``order`` take their places in any, but one, order.
    ``group`` columns must not be null; they should be short, as those that begin ranges are broadcast, one row per range at most.
    """
    xors, sums = xors or {}, sums or {}
    # rows that tie in everything are split too
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = stored(keyed.repartitionByRange(*group, *order, "_tie").withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *group).orderBy(*order, "_tie")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumns(
        {rank: F.row_number().over(within).cast("long") - 1}
        | {new: F.bit_xor(old).over(upto) for new, old in xors.items()} | {new: F.sum(old).over(upto) for new, old in sums.items()}
    )
    parts = ranged.groupBy("_range", *group).agg(
        F.count("*").alias("_n"), *(F.bit_xor(old).alias(f"_x_{new}") for new, old in xors.items()), *(F.sum(old).alias(f"_s_{new}") for new, old in sums.items())
    )
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of the group
    bases = parts.select(
        "_range", *group, F.sum("_n").over(ahead).alias("_b"),
        *(F.bit_xor(f"_x_{new}").over(ahead).alias(f"_b_{new}") for new in xors), *(F.sum(f"_s_{new}").over(ahead).alias(f"_b_{new}") for new in sums),
    ).filter("_b > 0")  # only the first group of a range goes on from an earlier one
    out = rows.join(F.broadcast(bases), ["_range", *group], "left")
    zero = F.lit(0).cast("long")
    added: dict[str, Column] = {rank: F.col(rank) + F.coalesce("_b", zero)}
    added |= {new: F.col(new).bitwiseXOR(F.coalesce(f"_b_{new}", zero)) for new in xors} | {new: F.col(new) + F.coalesce(f"_b_{new}", zero) for new in sums}
    return out.withColumns(added).select(*df.columns, *added)


# --- bytes and words of a batch --------------------------------------------------------------------------------

BLOCK_BYTES = 1 << 20
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def byte_blocks(column, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of an Arrow string column, about ``block`` bytes at a time.

    A null has no bytes. A text longer than ``block`` makes a block of its own.
    """
    import pyarrow as pa

    wide = column.type == pa.large_string()
    buffers = column.buffers()
    dtype = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(buffers[1], dtype=dtype)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the index of its first word."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    separator = SEPARATOR[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = separator[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = separator[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = True
    after[edges - 1] = True
    word = ~separator
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


BYTES_LOWER, BYTES_EXACT = _byte_values(True), _byte_values(False)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        size = 1 << int(n + 1).bit_length()
        made = []
        for base in (_POWER, _INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        _powers = made[0], made[1]
    return _powers


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable over undirected ``edges`` (a, b), for every id in an edge.

    With ``rounds`` it stops after so many; equal labels are then connected, but not all connected ids have equal labels.

    Each round takes the least label among the neighbours and then the label's own label, so paths
    halve; rounds end when nothing changes. All steps are aggregations and joins with map-side combining, and
    each round's labels are a stored table. Only a count of changes reaches the driver. A null end joins nothing.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    both = stored(edges.union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).select(F.col("a").alias("id"), "component"))
    done = 0
    while True:
        done += 1
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = stored(
            labels.join(near.withColumnRenamed("a", "id"), "id", "left")
            .select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        )
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        following = stored(
            lower.join(jump, "component", "left")
            .select("id", F.coalesce("further", "component").alias("component"), "was")
        )
        ended = done == rounds or following.filter("component <> was").isEmpty()
        discard(labels, lower)
        if ended:
            discard(both)
            return following.select("id", "component")
        labels = following.select("id", "component")
