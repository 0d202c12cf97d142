"""Encoding into vocabulary pieces by the path of best score, and decoding.

An Aho-Corasick automaton over all pieces reads each word once. At every position the output links of its state lead
through all pieces that end there, and each relaxes the best score of the position: one pass of Viterbi. Different words
of a block of texts run side by side, one numpy step for each position. A character that no piece covers becomes
byte pieces. Pieces begin with at most their own space marks, so words, which begin with the marks before them, are independent.
Among equal scores the longest last piece wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MARK = "▁"
BLOCK_BYTES = 4 << 20
CELLS = 1 << 21  # characters of padded words in one run
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces, scores and the automaton of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        plain, self.byte = {}, np.full(256, -1, np.int32)
        self.bytes_of: list[bytes] = [b""] * self.size
        for k in range(self.size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                plain[piece] = (model.get_score(k), k)
                self.bytes_of[k] = piece.replace(MARK, " ").encode()
        if (self.byte < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so a text could not be decoded exactly")
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece spans words")
        self._automaton(plain)
        self.piece_sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.piece_starts = np.concatenate([[0], np.cumsum(self.piece_sizes)])[:-1]
        self.piece_data = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _automaton(self, plain: dict[str, tuple[float, int]]) -> None:
        letters = sorted({c for p in plain for c in p})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        children: list[dict[int, int]] = [{}]
        depth, ends = [0], [-1]
        for piece, (_, k) in plain.items():
            at = 0
            for c in piece:
                code = int(self.letter[ord(c)])
                if code not in children[at]:
                    children[at][code] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    ends.append(-1)
                at = children[at][code]
            ends[at] = k
        fail, output = [0] * len(children), [0] * len(children)
        queue = list(children[0].values())
        for at in queue:
            for code, child in children[at].items():
                queue.append(child)
                back = fail[at]
                while back and code not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(code, 0)
                output[child] = fail[child] if ends[fail[child]] >= 0 else output[fail[child]]
        moves = sorted((at * self.width + code, child) for at, own in enumerate(children) for code, child in own.items())
        self.move_keys = np.array([m[0] for m in moves], np.int64)
        self.move_to = np.array([m[1] for m in moves], np.int32)
        self.first = np.zeros(self.width, np.int32)
        self.first[list(children[0])] = list(children[0].values())
        self.fail, self.output = np.array(fail, np.int32), np.array(output, np.int32)
        self.piece, self.length = np.array(ends, np.int32), np.array(depth, np.int32)
        scores = np.zeros(self.size)
        scores[[k for _, k in plain.values()]] = [s for s, _ in plain.values()]
        self.score = np.where(self.piece >= 0, scores[np.maximum(self.piece, 0)], 0.0)
        self.unknown = min((s for s, _ in plain.values()), default=0.0) - UNKNOWN_PENALTY

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The automaton's next states: along a move, or a move of the nearest failure state that has one."""
        state = state.copy()
        out = np.zeros_like(state)
        open_ = np.arange(len(state))
        while len(open_):
            at, by = state[open_], code[open_]
            key = at.astype(np.int64) * self.width + by
            place = np.minimum(np.searchsorted(self.move_keys, key), len(self.move_keys) - 1)
            hit = self.move_keys[place] == key
            out[open_[hit]] = self.move_to[place[hit]]
            open_ = open_[~hit & (at > 0)]
            root = self.fail[state[open_]] == 0
            done = open_[root]
            out[done] = self.first[code[done]]
            open_ = open_[~root]
            state[open_] = self.fail[state[open_]]
        return out

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of each word; a word begins with its space marks."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        at = 0
        while at < len(order):
            longest = max(len(words[order[at]]), 1)
            part = order[at : at + max(CELLS // longest, 1)]
            for k, ids in zip(part, self._paths([words[j] for j in part])):
                out[k] = ids
            at += len(part)
        return out

    def _paths(self, words: list[str]) -> list[np.ndarray]:
        """Words in order of falling length."""
        sizes = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        width = int(sizes.max(initial=0))
        best = np.full((width + 1, len(words)), -np.inf)
        best[0] = 0.0
        last = np.zeros((width + 1, len(words)), np.int32)  # state whose piece ends here; 0 for an uncovered character
        state = np.zeros(len(words), np.int32)
        for t in range(width):
            n = int(np.searchsorted(-sizes, -t, "left"))  # words longer than t
            state = self.step(state[:n], self.letter[points[begin[:n] + t]])
            link = np.where(self.piece[state] >= 0, state, self.output[state])
            rows = np.flatnonzero(link)
            while len(rows):
                u = link[rows]
                value = best[t + 1 - self.length[u], rows] + self.score[u]
                better = value > best[t + 1, rows]
                best[t + 1, rows[better]] = value[better]
                last[t + 1, rows[better]] = u[better]
                link[rows] = self.output[u]
                rows = rows[link[rows] > 0]
            # a character is uncovered only where no piece of its own exists
            alone = self.first[self.letter[points[begin[:n] + t]]]
            bare = np.flatnonzero(self.piece[alone] < 0)
            value = best[t, bare] + self.unknown
            better = value > best[t + 1, bare]
            best[t + 1, bare[better]] = value[better]
            last[t + 1, bare[better]] = 0
        out = []
        for k, word in enumerate(words):
            ids, t = [], len(word)
            while t:
                u = last[t, k]
                if u:
                    ids.append(int(self.piece[u]))
                    t -= int(self.length[u])
                else:
                    ids.extend(int(self.byte[b]) for b in reversed(_raw(word[t - 1])))
                    t -= 1
            out.append(np.array(ids[::-1], np.int32))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the space that encoding put before it is dropped."""
        if not len(ids):
            return b""
        sizes = self.piece_sizes[ids]
        total = int(sizes.sum())
        starts = np.repeat(self.piece_starts[ids] - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
        return self.piece_data[starts + np.arange(total)].tobytes()[1:]


#: Stands for a mark that is part of the text itself; it is in no piece and becomes the bytes of the mark.
_OWN_MARK = "\U0010FFFF"


def _raw(character: str) -> bytes:
    return (MARK if character == _OWN_MARK else character).encode()


def _word(raw: bytes) -> str:
    return raw.decode("utf-8").replace(MARK, _OWN_MARK).replace(" ", MARK)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode_block(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of each text's ids) of a block. Texts get a space in front; empty texts have no ids."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    shift = np.cumsum(sizes > 0)  # one space more for each text that is not empty
    spaced = np.empty(len(data) + int(shift[-1] if n else 0), np.uint8)
    head = offsets[:-1][sizes > 0] + np.arange(int((sizes > 0).sum()))
    mask = np.zeros(len(spaced), bool)
    mask[head] = True
    spaced[mask] = 0x20
    spaced[~mask] = data
    space = spaced == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[head] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(spaced))
    hashes = shared.range_hashes(spaced, starts, ends, shared.BYTES_EXACT)
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = spaced.tobytes()
    coded = v.encode_words([_word(raw[a:b]) for a, b in zip(starts[one].tolist(), ends[one].tolist())])
    lengths = np.array([len(c) for c in coded], np.int64)
    flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
    base = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(lengths) else np.zeros(0, np.int64)
    count = lengths[which]
    reached = np.concatenate([[0], np.cumsum(count)])
    ids = flat[np.repeat(base[which] - reached[:-1], count) + np.arange(int(reached[-1]))] if len(which) else flat
    first_word = np.searchsorted(starts, offsets + np.concatenate([[0], shift]), "left")
    return ids, reached[first_word]


def encode(docs: DataFrame, path: str, text_column: str = "text", ids_column: str = "piece_ids") -> DataFrame:
    """``docs`` with a column of piece ids. Null and empty texts have none; all other columns stay as they are.

    ``path`` is the model file's path on every executor. An existing column ``ids_column`` is an error.
    """
    return _with_ids(docs, path, text_column, [f"`{ids_column}` array<int>"], lambda v, ids, offsets, column: [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))])


def decode(coded: DataFrame, path: str, ids_column: str = "piece_ids", text_column: str = "text_decoded") -> DataFrame:
    """``coded`` with the text of its ids; no ids, or null, give an empty text. Ids outside the vocabulary are an error."""
    names = coded.columns
    at = names.index(ids_column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields), f"`{text_column}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(np.array(ids or [], np.int64)).decode() for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, text_column])

    return coded.mapInArrow(run, schema)


def _with_ids(docs: DataFrame, path: str, text_column: str, added: list[str], make) -> DataFrame:
    names = docs.columns
    at = names.index(text_column)
    new = [a.split("` ")[0].strip("`") for a in added]
    if set(new) & set(names):
        raise ValueError(f"columns exist already: {sorted(set(new) & set(names))}")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for first, last, data, offsets in shared.byte_blocks(batch.column(at), BLOCK_BYTES):
                ids, ends = encode_block(v, data, offsets)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(v, ids, ends, (data, offsets))], names=[*names, *new])

    return docs.mapInArrow(run, schema)


def round_trips(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding gives the text) of every row."""

    def make(v: Vocabulary, ids: np.ndarray, ends: np.ndarray, block: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
        data, offsets = block
        crc, same = [], []
        for a, b, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            crc.append(zlib.crc32(ids[a:b].astype("<u4").tobytes()))
            same.append(v.decode(ids[a:b]) == data[x:y].tobytes())
        return [pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return _with_ids(source, path, "text", ["`n_pieces` long", "`ids_crc32` long", "`round_trip` boolean"], make).drop("text")
