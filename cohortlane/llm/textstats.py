"""Counts over whole texts, computed for a block of texts at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_bytes", "n_lines", "n_line_words", "n_upper", "n_lower", "n_digits", "n_shout", "n_bars", "n_stops", "n_wide",
          "n_distinct_words", "n_same_next", "n_long_words", "n_symbol_words")

_SYMBOL, _UPPER, _LOWER, _DIGIT, _SHOUT, _BAR, _STOP = (np.zeros(256, bool) for _ in range(7))
for _table, _characters in (
    (_SYMBOL, "#*$%&|<>"), (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LOWER, "abcdefghijklmnopqrstuvwxyz"), (_DIGIT, "0123456789"), (_SHOUT, "!?"),
    (_BAR, "|"), (_STOP, ".,;:"),
):
    _table[[ord(c) for c in _characters]] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _grouped(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal (text, value) pairs together, and for each place whether it equals the one before."""
    key = shared.mix(values + text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    return order, same


def block_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts ``COUNTS`` of each text of a block."""
    n = len(offsets) - 1
    starts, ends, first = shared.word_bounds(data, offsets)
    hashes = shared.range_hashes(data, starts, ends, shared.BYTES_EXACT)
    owner = np.repeat(np.arange(n), np.diff(first))
    out = {"n_words": np.diff(first), "n_bytes": np.diff(offsets)}
    head = (data & 0xC0) != 0x80
    out["word_chars"] = _per_text(head & ~shared.SEPARATOR[data], offsets)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_shout", _SHOUT), ("n_bars", _BAR), ("n_stops", _STOP)):
        out[name] = _per_text(table[data], offsets)
    out["n_wide"] = _per_text(data >= 0xC0, offsets)

    # lines with a word, by the words they hold: a line is what lies between newlines within its text
    breaks = data == 0x0A
    number = np.cumsum(breaks)
    line_of_word = number[starts] if len(starts) else np.zeros(0, np.int64)
    opens = np.ones(len(starts), bool)
    opens[1:] = (line_of_word[1:] != line_of_word[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(opens)
    places = np.flatnonzero(breaks)
    line_text = owner[at]
    begin = np.maximum(offsets[line_text], np.concatenate([[0], places + 1])[np.searchsorted(places, starts[at], "left")] if len(at) else at)
    finish = np.minimum(offsets[line_text + 1], np.concatenate([places, [len(data)]])[np.searchsorted(places, starts[at], "left")] if len(at) else at)
    lines = shared.range_hashes(data, begin, finish, shared.BYTES_EXACT)
    order, same = _grouped(lines, line_text)
    out["n_lines"] = np.bincount(line_text, minlength=n)
    out["n_dup_lines"] = np.bincount(line_text[order[same]], minlength=n)
    out["n_line_words"] = out["n_words"]

    order, same = _grouped(hashes, owner)
    out["n_distinct_words"] = out["n_words"] - np.bincount(owner[order[same]], minlength=n)
    follows = np.zeros(len(hashes), bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out["n_same_next"] = np.bincount(owner[follows], minlength=n)
    out["n_long_words"] = np.bincount(owner[(ends - starts) > 24], minlength=n)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    out["n_symbol_words"] = np.bincount(owner[symbols[ends] > symbols[starts]], minlength=n)

    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= WINDOW:
        m = len(hashes) - WINDOW + 1
        inside = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
        total = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            total += hashes[k : m + k] * (shared.mix(np.array([k + 7], np.uint64))[0] | np.uint64(1))
        order, same = _grouped(total[inside], owner[inside])
        twice = same.copy()
        twice[:-1] |= same[1:]
        found = inside[order[twice]]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(covered[:-1]) > 0, first)
    return out


def with_counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the counts of its column ``text``; a null text counts as empty."""
    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [block_counts(data, offsets) for _, _, data, offsets in shared.byte_blocks(batch.column(0))]
            columns = [pa.array(np.concatenate([b[c] for b in blocks]) if blocks else np.zeros(0, np.int64), pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*keep, *COUNTS])

    return docs.select(F.col(text), *keep).mapInArrow(run, schema)
