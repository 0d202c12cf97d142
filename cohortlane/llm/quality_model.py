"""A generalised additive model with pairwise interactions over text counts.

Every feature is cut into bins by quantiles. Boosting cycles through the features; each step fits a tree of up to
``LEAVES`` leaves on one feature's bins to the gradient of the log loss and adds it to that feature's lookup table. Then the pairs
whose joint bins explain most of what is left get two-dimensional tables by trees that cut both features once. A score is
the logistic function of the sum of one table entry per feature and pair, looked up for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textstats

SAMPLE_ROWS = 6000  # labelled documents the model is fitted on, at most
BINS, PAIR_BINS, LEAVES = 32, 8, 3
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, SMOOTH = 40, 20, 6, 0.15, 4.0


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row of ratios per text, finite also for empty texts."""
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    words, letters = np.maximum(c["n_words"], 1), np.maximum(c["n_upper"] + c["n_lower"], 1)
    lines, size = np.maximum(c["n_lines"], 1), np.maximum(c["n_bytes"], 1)
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_symbol_words"] / words, c["n_shout"] / words,
        c["n_upper"] / letters, c["n_bars"] / words, c["n_stops"] / words, c["n_digits"] / size, c["n_wide"] / size,
        c["n_same_next"] / words, c["n_distinct_words"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / lines,
        c["n_words"] / lines, c["n_long_words"] / words,
    ], axis=1)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree that cuts the bins into at most ``leaves`` runs, each cut the one of largest gain."""
    runs = [(0, len(gradient))]
    g, h = np.concatenate([[0.0], np.cumsum(gradient)]), np.concatenate([[0.0], np.cumsum(weight)])

    def value(low: int, high: int) -> float:
        return (g[high] - g[low]) / (h[high] - h[low] + SMOOTH)

    def gain(low: int, high: int) -> float:
        return (g[high] - g[low]) ** 2 / (h[high] - h[low] + SMOOTH)

    while len(runs) < leaves:
        best = max(
            ((gain(low, k) + gain(k, high) - gain(low, high), low, k, high) for low, high in runs for k in range(low + 1, high)), default=(0.0,)
        )
        if best[0] <= 1e-9:
            break
        runs.remove((best[1], best[3]))
        runs += [(best[1], best[2]), (best[2], best[3])]
    out = np.zeros(len(gradient))
    for low, high in runs:
        out[low:high] = value(low, high)
    return out


def _square(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a tree that cuts the first feature once and the second once on each side, and its gain."""
    best, gained = np.zeros_like(gradient), 0.0
    for k in range(1, gradient.shape[0]):
        table, total = np.zeros_like(gradient), 0.0
        for part in (slice(0, k), slice(k, None)):
            row = _tree(gradient[part].sum(0), weight[part].sum(0), 2)
            table[part] = row
            total += float((row * gradient[part].sum(0)).sum())
        if total > gained:
            best, gained = table, total
    return best, gained


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for pair in self.pairs for k in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit on rows ``x`` and labels 0/1. With no rows or one label only, the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    d = x.shape[1]
    model = AdditiveModel(base, [_edges(x[:, k], BINS) for k in range(d)], [], [_edges(x[:, k], PAIR_BINS) for k in range(d)], [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(d):
            gradient, weight = slopes()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(bins[k], gradient, size), np.bincount(bins[k], weight, size), LEAVES)
            model.tables[k] += step
            total += step[bins[k]]

    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def joint(i: int, j: int) -> tuple[np.ndarray, float]:
        gradient, weight = slopes()
        cell = coarse[i] * shape[j] + coarse[j]
        n = shape[i] * shape[j]
        return _square(np.bincount(cell, gradient, n).reshape(shape[i], shape[j]), np.bincount(cell, weight, n).reshape(shape[i], shape[j]))

    ranked = sorted(combinations(range(d), 2), key=lambda pair: -joint(*pair)[1])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for table, (i, j) in zip(model.pair_tables, model.pairs):
            step = RATE * joint(i, j)[0]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def _held_out(third: int, of: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == third, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """A model from at most ``rows`` labelled documents, those of smallest id hash among ids whose crc32 mod 3 is not 1.

    Only ids and labels are sorted; the texts of the chosen ids are then read and reduced to features by the executors.
    An id with several labels counts as 1 only if all are 1.
    """
    told = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("y")).dropna()
    chosen = (
        told.filter(~_held_out(1, 3)).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
    found = textstats.with_counts(source, "text", ["doc_id", "y"]).toArrow().sort_by("doc_id")
    counts = {c: found.column(c).to_numpy() for c in textstats.COUNTS}
    return fit(features(counts), (found.column("y").to_numpy() == 1).astype(np.float64))


def score(docs: DataFrame, model: AdditiveModel, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with a column ``score_column`` from 0 to 1. Null and empty texts are scored like a text without words."""
    names = docs.columns
    at = names.index(text_column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{score_column}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(features(textstats.block_counts(data, offsets))) for _, _, data, offsets in shared.byte_blocks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*names, score_column])

    return shared.smaller_batches(docs).mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; a null id is not held out. Other columns are not read."""
    model = train(docs, labels, id_column, text_column, label_column)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    scored = score(source, model)
    return scored.select("doc_id", _held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
