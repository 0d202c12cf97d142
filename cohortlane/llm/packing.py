"""Packing of token pieces into windows by minimum bin slack.

Each document is cut into whole windows and one remainder. Only the histogram of remainder lengths (at most
``capacity - 1`` numbers, at any size of the corpus) is needed to plan: the longest remaining length opens a window,
a bitset subset-sum over the remaining multiset finds the fill closest to capacity, counts are read off backwards,
and the pattern is repeated until one of its lengths runs out. Every pattern exhausts a length, so there are fewer
patterns than lengths. Remainders take their places by rank within their length, which Spark counts by task and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

CAPACITY = 2048
END_ID = 1
SPECIAL = {"<|endoftext|>": 50256}  # the added token of byte_bpe_50k.json, which its rank file does not hold

_encoders: dict[tuple, object] = {}


def encoder(path: str, special: dict[str, int] | None = None):
    """The function text -> ids of a vocabulary file: ``.tiktoken`` ranks, or a ``tokenizers`` JSON file.

    Texts of ``special`` tokens become their ids, which a JSON file must name itself; without them they are ordinary text.
    """
    key = (path, *sorted((special or {}).items()))
    if key not in _encoders:
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special or {})
            _encoders[key] = lambda text: (
                made.encode(text, allowed_special="all") if any(t in text for t in special or ()) else made.encode_ordinary(text)
            )
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            if any(model.token_to_id(t) != k for t, k in (special or {}).items()):
                raise ValueError(f"{path} has other special tokens than {special}")
            model.encode_special_tokens = not special
            _encoders[key] = lambda text: model.encode(text, add_special_tokens=False).ids
    return _encoders[key]


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is closest to ``capacity`` from below, as counts by length.

    Bit s of the bitset tells whether s can be reached; multiplicities are split into powers of two.
    """
    reached, steps = 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        most = min(counts[length], capacity // length)
        k = 1
        while most > 0:
            k = min(k, most)
            steps.append((reached, length, k))
            reached |= (reached << (length * k)) & mask
            most -= k
            k *= 2
        if reached >> capacity & 1:
            break
    left = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, k in reversed(steps):
        if not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + k
            left -= length * k
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, first sequence, places per sequence, offset of the first place), and the number of sequences."""
    left = {length: n for length, n in counts.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = fill({k: n for k, n in rest.items() if n > 0}, capacity - longest) if capacity > longest else {}
        chosen[longest] = chosen.get(longest, 0) + 1
        repeats = min(left[length] // k for length, k in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            k = chosen[length]
            rows.append((length, rank[length], sequence, k, offset))
            offset += k * length
            rank[length] += repeats * k
            left[length] -= repeats * k
            if not left[length]:
                del left[length]
        sequence += repeats
    return rows, sequence


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, ordinal long"


def _pieces(path: str, capacity: int, end_id: int, special: dict[str, int] | None):
    names = [x.split()[0] for x in _PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                doc = doc.as_py()
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for column, value in zip(rows, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, int(seen[len(piece)]))):
                        column.append(value)
                    seen[len(piece)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n == "part" else pa.int64()) for n, c in zip(names, rows)], names=names
            )

    return run


def _placed(rows, sequences: int, capacity: int):
    """Look up (length, rank) in the plan; whole windows follow the packed sequences by rank."""
    rows = sorted(rows)
    lengths, firsts, starts, places, offsets = (np.array([r[k] for r in rows], np.int64) for k in range(5))
    key = (lengths << 50) + firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            whole = length == capacity
            sequence, offset = sequences + rank, np.zeros(len(rank), np.int64)
            part = ~whole
            if part.any():
                at = np.searchsorted(key, (length[part] << 50) + rank[part], "right") - 1
                ahead = rank[part] - firsts[at]
                sequence[part] = starts[at] + ahead // places[at]
                offset[part] = offsets[at] + ahead % places[at] * length[part]
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
         special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is the path of a vocabulary file on every executor; the texts of ``special`` tokens become their ids. A document is its ids and ``end_id``; a null
    or empty text is ``end_id`` alone. Rows with equal or null ids are separate documents. Other columns are not read.
    An empty table gives no pieces. Places come from ranks in a stored table, so repeated tasks give the same result.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = shared.stored(shared.smaller_batches(source).mapInArrow(_pieces(vocabulary, capacity, end_id, special), _PIECE))
    counts = shared.stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rows, sequences = plan({length: n for length, n in histogram.items() if length < capacity}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("ordinal"))
    return ranked.mapInArrow(
        _placed(rows, sequences, capacity),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
