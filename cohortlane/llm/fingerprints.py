"""Fingerprints from locally consistent parsing.

A text is a string of bytes. On every level runs of one symbol are contracted, deterministic coin tossing gives each symbol a
label from its own name and its left neighbours' (the lowest differing bit and its value, again and again until there are
six labels), and phrases begin at local maxima of the labels. A phrase's name is a hash of the names in it; names are the
next level's symbols. Cuts depend on a few neighbours only, so equal substrings are parsed equally except at
their edges, wherever they stand. The fingerprint is a bottom-k sketch of the names of all levels from the second on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LEVELS = 4
FIRST_LEVEL = 2
SKETCH = 64
BUCKET_ROWS, BUCKETS = 2000, 10_000

_TRAILING = np.array([0, *(((k & -k).bit_length() - 1) for k in range(1, 256))], np.uint8)
_RUN = np.uint64(0x8CB92BA72F3D8DD7)
_ONE = np.uint64(1)


def _again(label: np.ndarray, sentinel: np.ndarray) -> np.ndarray:
    """One more round of coin tossing on small labels."""
    low = _TRAILING[label[1:] ^ label[:-1]]
    out = np.empty_like(label)
    out[0] = 0
    out[1:] = 2 * low + ((label[1:] >> low) & 1)
    out[sentinel] = 0
    return out


def _labels(symbol: np.ndarray, sentinel: np.ndarray) -> np.ndarray:
    """Labels 0 to 5; the places of ``sentinel`` have label 0, so nothing depends on another text."""
    label = np.zeros(len(symbol), np.uint8)
    if symbol.dtype == np.uint8:
        label = _again(symbol, sentinel)
    else:
        differ = symbol[1:] ^ symbol[:-1]
        low = np.bitwise_count((differ & (~differ + _ONE)) - _ONE)
        low[differ == 0] = 0
        label[1:] = 2 * low + ((symbol[1:] >> low.astype(np.uint64)) & _ONE).astype(np.uint8)
        label[sentinel] = 0
        label = _again(label, sentinel)
    return _again(_again(label, sentinel), sentinel)


def _contracted(symbol: np.ndarray, name: np.ndarray, sentinel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a symbol become one place whose name has the run's length."""
    begins = np.ones(len(symbol), bool)
    begins[1:] = (symbol[1:] != symbol[:-1]) | sentinel[1:] | sentinel[:-1]
    at = np.flatnonzero(begins)
    if len(at) == len(symbol):
        return symbol, name, sentinel
    length = np.diff(np.append(at, len(symbol)))
    name = name[at]
    long = np.flatnonzero(length > 1)
    name[long] = shared.mix(name[long] + length[long].astype(np.uint64) * _RUN)
    return symbol[at], name, sentinel[at]


def parse(data: np.ndarray, offsets: np.ndarray, levels: int = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from the first on, (phrase names, text of each phrase)."""
    n = len(offsets) - 1
    size = len(data) + n + 1
    sentinel = np.zeros(size, bool)
    sentinel[offsets + np.arange(n + 1)] = True
    symbol = np.zeros(size, np.uint8)
    symbol[~sentinel] = data
    name = shared.BYTES_EXACT[symbol]
    out = []
    for _ in range(levels):
        symbol, name, sentinel = _contracted(symbol, name, sentinel)
        label = _labels(symbol, sentinel)
        begins = np.zeros(len(symbol), bool)
        begins[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        begins |= sentinel
        begins[1:] |= sentinel[:-1]
        at = np.flatnonzero(begins)
        power, inverse = shared._power_tables(len(name))
        total = np.zeros(len(name) + 1, np.uint64)
        np.cumsum(name * power[: len(name)], out=total[1:])
        ends = np.append(at[1:], len(name))
        name = shared.mix((total[ends] - total[at]) * inverse[at] + (ends - at).astype(np.uint64))
        sentinel = sentinel[at]
        symbol = name
        owner = np.cumsum(sentinel) - 1
        real = ~sentinel
        out.append((name[real], owner[real]))
    return out


def sketches(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ``SKETCH`` smallest 32-bit hashes of each text's phrase names; empty for an empty text."""
    n = len(offsets) - 1
    keys = []
    for level, (name, owner) in enumerate(parse(data, offsets), 1):
        if level >= FIRST_LEVEL:
            keys.append(owner.astype(np.uint64) << np.uint64(32) | shared.mix(name + np.uint64(level)) >> np.uint64(32))
    key = np.unique(np.concatenate(keys))
    first = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a : min(b, a + SKETCH)] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of common names among all names of two texts, from their sketches; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    first = np.ones(len(both), bool)
    first[1:] = ~same
    rank = np.cumsum(first)
    most = min(int(rank[-1]), SKETCH)
    return int((same & (rank[1:] <= most)).sum()) / most


def encoded(sketch: np.ndarray) -> str:
    """A sketch as text, eight hexadecimal digits for each hash."""
    return sketch.astype(">u4").tobytes().hex()


def _joined(texts: list[bytes]) -> list[np.ndarray]:
    """Sketches of texts, about a block of bytes at a time."""
    out, part, size = [], [], 0
    for k, text in enumerate(texts):
        part.append(text)
        size += len(text)
        if size >= shared.BLOCK_BYTES or k == len(texts) - 1:
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
            out += sketches(np.frombuffer(b"".join(part), np.uint8), offsets)
            part, size = [], 0
    return out


def _cut(text: bytes, points: int) -> int:
    """The byte at which the code point of number ``points`` begins."""
    if len(text) <= points:
        return len(text)
    heads = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return int(heads[points]) if points < len(heads) else len(text)


def _code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _dealt(cuts: list[int]):
    """Rows to their bucket; the first rows of a bucket also to the one before, as rows that are only looked at."""
    edges = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "ahead", "place", "doc_id", "text"]
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(edges, place, "right") - 1  # the first edge is the smallest place
            rest = [batch.column(k) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.zeros(len(place), bool)), *rest], names=names)
            first = np.flatnonzero(edges[bucket] == place) if len(place) else np.zeros(0, np.int64)
            if len(first):
                before = ((bucket[first] - 1) % len(edges)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(np.ones(len(first), bool)), *(c.take(pa.array(first)) for c in rest)], names=names)

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order within buckets; one row is carried over to the next batch."""
    carried: list[tuple] = []
    for batch in batches:
        rows = carried
        rows += [
            (b, a, d, (t.as_py() or "").encode()) for b, a, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4))
        ]
        if not rows:
            continue
        own = _joined([r[3] for r in rows])
        pairs = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
        counts = [_code_points(rows[k][3]) for k in pairs]
        edits = []
        for k, n in zip(pairs, counts):
            text, following = rows[k][3], rows[k + 1][3]
            edits.append(text[: _cut(text, n - n // 2)] + following[: _cut(following, n // 2)])
        edited = _joined(edits)
        columns = [
            pa.array([rows[k][2] for k in pairs], pa.int64()), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
            pa.array([encoded(own[k]) for k in pairs], pa.string()), pa.array([encoded(e) for e in edited], pa.string()),
            pa.array([likeness(own[k], e) for k, e in zip(pairs, edited)], pa.float64()), pa.array([likeness(own[k], own[k + 1]) for k in pairs], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OUT.split(", ")])
        carried = [rows[-1]]


def compare_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and likenesses.

    The order is by id, nulls first, then by the text's hash; the last row is followed by the first. A row's edited text has
    its last floor(n/2) code points replaced by the first as many of the next row's text, or all if it has fewer.
    Null texts are empty. Equal texts have equal fingerprints. Rows are dealt into ranges of ids, so that only text
    of one range and one row more is in a task at a time, in batches; ids repeated very often share a range. Other columns are not read.
    """
    first = -(1 << 63)
    source = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(first)).alias("place"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    rows, least = source.agg(F.count("*"), F.min("place")).first()
    if not rows:
        return docs.sparkSession.createDataFrame([], _OUT)
    buckets = min(max(rows // BUCKET_ROWS, 1), BUCKETS)
    shares = [k / buckets for k in range(1, buckets)]
    found = source.agg(F.percentile_approx("place", shares, 20 * buckets)).first()[0] if shares else []
    cuts = sorted({least, *found})
    dealt = source.mapInArrow(_dealt(cuts), "bucket int, ahead boolean, place long, doc_id long, text string")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "ahead", "place", F.xxhash64("text"))
    return ordered.mapInArrow(_compared, _OUT)
