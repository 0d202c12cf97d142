"""Language of a text from a bidirectional gated recurrent network over its bytes.

Two gated recurrent units read a window of bytes from either end; at every position their states give a distribution over
the languages. A document's distribution is the mean of the log-probabilities of all its positions, normalised again. The
whole text is cut into windows that do not overlap, so every byte is read once in each direction. Windows of many
documents run side by side, one numpy step per position. Weights are trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 64
HIDDEN = 8
ROWS_PER_LANGUAGE = 300  # documents a model is fitted on, at most, for each language
WINDOWS_PER_DOCUMENT = 8
LANGUAGES = 256  # more values of the label column are an error
EPOCHS, BATCH, RATE = 6, 256, 0.01
STEP_ROWS = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Direction:
    """Gates of one unit. A column of ``look`` is a byte's contribution to update, reset and new state, bias included."""

    look: np.ndarray  # (3h, 257); the last column stands for no byte
    gate: np.ndarray  # (2h, h)
    state: np.ndarray  # (h, h)

    def run(self, windows: np.ndarray, keep: bool = False):
        """States (positions, h, rows) for ``windows`` (positions, rows); with ``keep`` also what training needs."""
        steps, rows = windows.shape
        h = len(self.state)
        states = np.empty((steps + 1, h, rows), np.float32)
        states[0] = 0
        kept = []
        given, gates = np.empty((3 * h, rows), np.float32), np.empty((2 * h, rows), np.float32)
        mixed, new = np.empty((h, rows), np.float32), np.empty((h, rows), np.float32)
        for t in range(steps):
            if keep:
                gates, new = np.empty_like(gates), np.empty_like(new)
            before = states[t]
            np.take(self.look, windows[t], axis=1, out=given, mode="clip")
            np.matmul(self.gate, before, out=gates)
            gates += given[: 2 * h]
            _sigmoid(gates)
            update, reset = gates[:h], gates[h:]
            np.multiply(reset, before, out=mixed)
            np.matmul(self.state, mixed, out=new)
            new += given[2 * h :]
            np.tanh(new, out=new)
            after = states[t + 1]
            np.subtract(before, new, out=after)
            after *= update
            after += new
            if keep:
                kept.append((update, reset, new))
        return (states, kept) if keep else states[1:]


@dataclass
class ByteNetwork:
    labels: list[str]
    forward: Direction
    backward: Direction
    out_forward: np.ndarray  # (labels, h)
    out_backward: np.ndarray
    bias: np.ndarray  # (labels, 1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(positions, labels, rows) for ``windows`` (positions, rows) of bytes, 256 where a text has ended."""
        left, right = self.forward.run(windows), self.backward.run(windows[::-1])[::-1]
        out = self.out_forward @ left
        out += self.out_backward @ right
        out += self.bias
        out -= out.max(1, keepdims=True)
        out -= np.log(np.exp(out).sum(1, keepdims=True))
        return out


def windows_of(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) of bytes, 256 after the end of a text, and the text of each row."""
    sizes = np.diff(offsets)
    number = -(-sizes // width)
    owner = np.repeat(np.arange(len(sizes)), number)
    first = np.concatenate([[0], np.cumsum(number)])[:-1]
    begin = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * width
    at = begin[:, None] + np.arange(width)
    inside = at < offsets[1:][owner][:, None]
    wide = np.append(data, 0).astype(np.int16)
    return np.where(inside, wide[np.minimum(at, len(data))], np.int16(256)), owner


def document_probabilities(model: ByteNetwork, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, labels): the mean log-probability over all bytes of a text, normalised; even for texts without bytes."""
    windows, owner = windows_of(data, offsets)
    n, total = len(offsets) - 1, None
    total = np.zeros((n, len(model.labels)))
    for k in range(0, len(windows), STEP_ROWS):
        part = np.ascontiguousarray(windows[k : k + STEP_ROWS].T)
        logs = model.log_probabilities(part)
        logs *= (part < 256)[:, None, :]
        rows = logs.sum(0)
        for j in range(len(rows)):
            total[:, j] += np.bincount(owner[k : k + STEP_ROWS], rows[j], n)
    total /= np.maximum(np.diff(offsets), 1)[:, None]
    total = np.exp(total - total.max(1, keepdims=True)) if len(model.labels) else total
    return total / total.sum(1, keepdims=True)


def _start(labels: list[str], hidden: int, seed: int) -> ByteNetwork:
    draw = np.random.default_rng(seed)

    def of(*shape: int, scale: float) -> np.ndarray:
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    units = [Direction(of(3 * hidden, 257, scale=0.3), of(2 * hidden, hidden, scale=0.3), of(hidden, hidden, scale=0.3)) for _ in range(2)]
    n = len(labels)
    return ByteNetwork(labels, *units, of(n, hidden, scale=0.3), of(n, hidden, scale=0.3), np.zeros((n, 1), np.float32))


def _through_time(unit: Direction, windows: np.ndarray, states: np.ndarray, kept: list, above: np.ndarray) -> list[np.ndarray]:
    """Gradients of look, gate and state, given the loss's gradient for each state (positions, h, rows)."""
    h = len(unit.state)
    look, gate, state = np.zeros_like(unit.look), np.zeros_like(unit.gate), np.zeros_like(unit.state)
    later = np.zeros_like(states[0])
    given = np.empty((3 * h, *windows.shape), np.float32)
    for t in range(len(kept) - 1, -1, -1):
        update, reset, new = kept[t]
        before = states[t]
        at = above[t] + later
        d_new = at * (1 - update) * (1 - new * new)
        d_mixed = unit.state.T @ d_new
        d_update = at * (before - new) * update * (1 - update)
        d_reset = d_mixed * before * reset * (1 - reset)
        d_gates = np.concatenate([d_update, d_reset])
        gate += d_gates @ before.T
        state += d_new @ (reset * before).T
        given[: 2 * h, t], given[2 * h :, t] = d_gates, d_new
        later = at * update + d_mixed * reset + unit.gate.T @ d_gates
    flat = windows.ravel()
    for j in range(3 * h):
        look[j] = np.bincount(flat, given[j].ravel(), 257)
    return [look, gate, state]


def train_network(rows: list[tuple[str, str]], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> ByteNetwork:
    """Fit on (text, language) rows: Adam over batches of windows, the loss being the mean over labelled positions."""
    labels = sorted({lang for _, lang in rows})
    model = _start(labels, hidden, seed)
    draw = np.random.default_rng(seed)
    parts, targets = [], []
    for text, lang in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        windows, _ = windows_of(raw, np.array([0, len(raw)]))
        picked = draw.permutation(len(windows))[:WINDOWS_PER_DOCUMENT]
        parts.append(windows[picked])
        targets += [labels.index(lang)] * len(picked)
    if len(labels) < 2 or not targets:
        return model
    windows, wanted = np.concatenate(parts), np.array(targets)
    # languages weigh alike
    weights = (1 / np.bincount(wanted, minlength=len(labels)))[wanted]
    weights = (weights / weights.mean()).astype(np.float32)
    parameters = [model.forward.look, model.forward.gate, model.forward.state, model.backward.look, model.backward.gate, model.backward.state,
                  model.out_forward, model.out_backward, model.bias]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            part = np.ascontiguousarray(windows[at].T)
            ahead, ahead_kept = model.forward.run(part, True)
            back, back_kept = model.backward.run(part[::-1], True)
            left, right = ahead[1:], back[1:][::-1]
            logits = model.out_forward @ left + model.out_backward @ right + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[:, wanted[at], np.arange(len(at))] -= 1
            mask = (part < 256).astype(np.float32) * weights[at]
            p *= (mask / max(mask.sum(), 1))[:, None, :]
            gradients = [
                *_through_time(model.forward, part, ahead, ahead_kept, model.out_forward.T @ p),
                *_through_time(model.backward, part[::-1], back, back_kept, (model.out_backward.T @ p)[::-1]),
                np.einsum("tlr,thr->lh", p, left), np.einsum("tlr,thr->lh", p, right), p.sum((0, 2))[:, None],
            ]
            step += 1
            for parameter, gradient, m, v in zip(parameters, gradients, first, second):
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient * gradient - v)
                parameter -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> ByteNetwork:
    """A network from at most ``rows`` documents of each language, those of smallest id hash among ids whose crc32 mod 4 is not 2.

    Only ids and languages are sorted; then the texts of the chosen ids are read. More than ``LANGUAGES`` languages raise an error.
    """
    known = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(lang_column).cast("string").alias("lang")).dropna().filter(~held_out())
    languages = [r.lang for r in known.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    chosen = [r.doc_id for lang in sorted(languages) for r in known.filter(F.col("lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    if not chosen:
        return _start([], HIDDEN, 0)
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(set(chosen))], "doc_id long"))  # at most languages x rows
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    found = source.dropna().join(ids, "doc_id").select("doc_id", "lang", F.expr(f"substring(text, 1 + pmod(xxhash64(doc_id), greatest(length(text) - {_LEARNED}, 1)), {_LEARNED})").alias("text"))
    return train_network([(r.text, r.lang) for r in found.orderBy("doc_id", "lang", "text").collect() if r.text])


_LEARNED = WINDOW * WINDOWS_PER_DOCUMENT * 2  # code points of a training document, from a place that its id hash gives


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def label(docs: DataFrame, model: ByteNetwork, text_column: str = "text", prediction: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its probability from the whole text.

    A null text, or one without a letter, is ``und`` with score 0. So is every text if the network has learned no language.
    """
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{prediction}` string", f"`{score}` double"])
    lettered = F.coalesce(F.col(f"`{text_column}`").rlike(r"\p{L}"), F.lit(False))
    marked = docs.select(*(F.col(f"`{c}`") for c in names), lettered)
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.labels:
                blocks = [document_probabilities(model, data, offsets) for _, _, data, offsets in shared.byte_blocks(batch.column(at))]
                p = np.concatenate(blocks) if blocks else np.zeros((0, len(model.labels)))
                letters = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
                best = p.argmax(1) if len(p) else np.zeros(0, int)
                found = [model.labels[k] if ok else "und" for k, ok in zip(best, letters)]
                scores = np.where(letters, p.max(1) if len(p) else 0.0, 0.0)
            else:
                found, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, prediction, score])

    return shared.smaller_batches(marked).mapInArrow(run, schema)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``; a null id is not held out. Other columns are not read."""
    model = train(docs, id_column, text_column, lang_column)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return label(source, model, score="score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
