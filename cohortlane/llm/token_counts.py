"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a block of texts are laid end to end as one array of symbols, each different pre-token once. In a round
every sequence finds its lowest-ranked pair, and all these pairs are merged together, in every sequence at once; a
sequence without a pair of a rank leaves the arrays. What is counted is the symbols that are left. A merge never makes
a pair of a lower rank than its own (checked when a file is read), so merging all places of the lowest pair together
is what merging them one by one gives.

Where texts are cut into pre-tokens is taken from the vocabulary file itself: the library is asked once for each code
point whether its pattern takes it for a letter, a digit, a space or something else.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LIMIT = 2048
BLOCK_BYTES = 2 << 20
LONG = 2048  # symbols; longer sequences keep their pairs by rank instead of looking at all of them in every round
NONE = np.int64(1) << 40  # the rank of a pair that no merge joins

#: Fixed value: the pattern of word_bpe_49k.json, whose matches the arrays find by themselves.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
#: Texts of code points below U+0300 are in composed form, and all but one of these have lower-case forms without context.
_NEEDS_LIBRARY = re.compile("[^\x00-˿]|İ")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself, or the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Merger:
    """Symbols, ranks and merges of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        told = json.loads(Path(path).read_text(encoding="utf-8"))
        model = told["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} is no plain BPE vocabulary")
        self.library = Tokenizer.from_file(path)
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        missing = [x for x in letters if x not in vocabulary or x + suffix not in vocabulary]
        if missing:
            raise ValueError(f"{path} has no symbol for {len(missing)} bytes")
        self.inner = np.array([vocabulary[x] for x in letters], np.int64)
        self.final = np.array([vocabulary[x + suffix] for x in letters], np.int64)
        self.byte_of = {x: b for b, x in enumerate(letters)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        made_at = {}
        for rank, (a, b) in enumerate(merges):
            if made_at.setdefault(a + b, rank) != rank or max(made_at.get(a, -1), made_at.get(b, -1)) >= rank:
                raise ValueError(f"{path}: a merge has a lower rank than the merges of its parts")
        pairs = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.rank_of_pair = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.rank_of_pair]
        added = told.get("added_tokens") or []
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError(f"{path} has added tokens that are not plain strings of the raw text")
        self.special = re.compile("|".join(re.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"])))) if added else None
        split = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_words = split.get("pattern", {}).get("Regex") == WORD_PATTERN and split.get("behavior") == "Removed" and split.get("invert")
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)

    # --- pre-tokens -----------------------------------------------------------------------------------------------

    def _kinds_of(self, points: np.ndarray) -> np.ndarray:
        """SPACE, LETTER, DIGIT or OTHER of each code point, as the pattern of the file takes it."""
        kinds = self.kinds[points]
        if (kinds == UNKNOWN).any():
            new = np.unique(points[kinds == UNKNOWN])
            probe = " ".join(f"a{chr(p)}{chr(p)}" for p in new)  # letters join the a, digits stand alone, other marks keep together
            found = self.library.pre_tokenizer[0].pre_tokenize_str(probe)
            in_cell: dict[int, list[int]] = {}
            for _, (start, end) in found:
                in_cell.setdefault(start // 4, []).append(end - start)
            kind = {(3,): LETTER, (1, 2): OTHER, (1, 1, 1): DIGIT, (1,): SPACE}
            self.kinds[new] = [kind[tuple(in_cell[k])] for k in range(len(new))]
            kinds = self.kinds[points]
        return kinds

    def _word_cuts(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of a normalised text, and the byte offsets where its pre-tokens start and end."""
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) == 0:
            return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = self._kinds_of(points)
        first = np.ones(len(points), bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        # an apostrophe that stands alone takes the letters of 's 't 'm 'd 're 've 'll along
        lone = np.flatnonzero((points == ord("'")) & first)
        after = points[np.minimum(lone + 1, len(points) - 1)]
        beyond = np.where(lone + 2 < len(points), points[np.minimum(lone + 2, len(points) - 1)], 0)
        one = np.isin(after, [ord(c) for c in "stmd"])
        two = (np.isin(after, [ord("r"), ord("v")]) & (beyond == ord("e"))) | ((after == ord("l")) & (beyond == ord("l")))
        for at, taken in ((lone[one], 1), (lone[two], 2)):
            first[at + 1] = False
            rest = at + 1 + taken
            rest = rest[rest < len(points)]
            first[rest] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(points))
        word = kinds[starts] != SPACE
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        return data, byte_at[starts[word]], byte_at[ends[word]]

    def _library_cuts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`_word_cuts`, for any other pattern, from the library's own pre-tokens; and the text of each pre-token."""
        parts, owners = [], []
        for k, text in enumerate(texts):
            for section in self.special.split(text) if self.special else [text]:
                if section:
                    if self.library.normalizer is not None:
                        section = self.library.normalizer.normalize_str(section)
                    found = self.library.pre_tokenizer.pre_tokenize_str(section)
                    parts += [bytes(self.byte_of[c] for c in piece) for piece, _ in found if piece]
                    owners += [k] * sum(1 for piece, _ in found if piece)
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.append(0, ends[:-1]) if parts else ends, ends, np.array(owners, np.int64)

    def _normal(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text) if _NEEDS_LIBRARY.search(text) else text.lower()

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, those of special strings included."""
        out = np.zeros(len(texts), np.int64)
        if self.special is not None:
            out[:] = [sum(1 for _ in self.special.finditer(text)) for text in texts]
        if self.by_words:
            # nothing joins across white space, so specials become spaces and texts are laid end to end
            plain = [self._normal(self.special.sub(" ", t) if out[k] else t) for k, t in enumerate(texts)]
            data, starts, ends = self._word_cuts("\n".join(plain))
            lengths = np.array([len(p.encode("utf-8")) + 1 for p in plain], np.int64)
            owners = np.searchsorted(np.cumsum(lengths), starts, "right")
        else:
            data, starts, ends, owners = self._library_cuts(texts)
        if len(starts):
            out += np.bincount(owners, weights=self._counts(data, starts, ends), minlength=len(texts)).astype(np.int64)
        return out

    # --- merges ---------------------------------------------------------------------------------------------------

    def _counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols left of each byte range; equal ranges are merged once."""
        hashes = shared.range_hashes(data, starts, ends, shared.BYTES_EXACT)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        same = self._equal(data, starts, ends, one[which])
        if not same.all():  # ranges of equal hash and different bytes stand for themselves
            odd = np.flatnonzero(~same)
            which[odd] = len(one) + np.arange(len(odd))
            one = np.append(one, odd)
        return self.merged(data, starts[one], ends[one])[which]

    @staticmethod
    def _equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether each range has the bytes of the range numbered ``other``."""
        lengths = ends - starts
        same = lengths == lengths[other]
        rows = np.flatnonzero(same & (other != np.arange(len(starts))))
        if len(rows):
            n = lengths[rows]
            heads = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(heads, n)
            equal = data[np.repeat(starts[rows], n) + step] == data[np.repeat(starts[other[rows]], n) + step]
            same[rows] = np.logical_and.reduceat(equal, heads)
        return same

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank_of_pair[at], NONE)

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols left of each range (none of them empty) after all merges."""
        lengths = ends - starts
        out = np.ones(len(starts), np.int64)
        for k in np.flatnonzero(lengths > LONG):
            out[k] = self._swept(data[starts[k] : ends[k]])
        which = np.flatnonzero((lengths > 1) & (lengths <= LONG))
        if len(which) == 0 or len(self.pairs) == 0:
            out[which] = lengths[which]
            return out
        n = lengths[which]
        heads = np.cumsum(n) - n
        taken = data[np.repeat(starts[which], n) + np.arange(int(n.sum())) - np.repeat(heads, n)]
        symbols = self.inner[taken]
        tails = heads + n - 1
        symbols[tails] = self.final[taken[tails]]
        ranks = np.full(len(symbols), NONE)
        ranks[:-1] = self._ranks(symbols[:-1], symbols[1:])
        ranks[tails] = NONE
        while len(which):
            lowest = np.minimum.reduceat(ranks, heads)
            live = lowest < NONE
            if not live.all():
                out[which[~live]] = n[~live]
                stay = np.repeat(live, n)
                symbols, ranks, which, n, lowest = symbols[stay], ranks[stay], which[live], n[live], lowest[live]
                if len(which) == 0:
                    break
            hit = ranks == np.repeat(lowest, n)
            hit = _leftmost(hit)
            at = np.flatnonzero(hit)
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            gone = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(~keep, out=gone[1:])
            bounds = np.append(0, np.cumsum(n))
            n = n - (gone[bounds[1:]] - gone[bounds[:-1]])
            at = at - gone[at]
            symbols, ranks = symbols[keep], ranks[keep]
            heads = np.cumsum(n) - n
            last = np.zeros(len(symbols), bool)
            last[heads + n - 1] = True
            changed = np.concatenate([at, at[at > 0] - 1])  # the merged symbols and those before them
            inside = changed[~last[changed]]
            ranks[changed] = NONE
            ranks[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        return out

    def _swept(self, data: np.ndarray) -> int:
        """Symbols left of one long sequence: places are kept by rank, so a round costs as much as it merges."""
        size = len(data)
        symbols = self.inner[data]
        symbols[-1] = self.final[data[-1]]
        after, before, alive = np.arange(1, size + 1), np.arange(-1, size - 1), np.ones(size, bool)
        ranks = np.full(size, NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(places: np.ndarray) -> None:
            ranks[places] = NONE
            places = places[after[places] < size]
            ranks[places] = self._ranks(symbols[places], symbols[after[places]])
            places = places[ranks[places] < NONE]
            places = places[np.argsort(ranks[places], kind="stable")]
            values, firsts = np.unique(ranks[places], return_index=True)
            for rank, some in zip(values.tolist(), np.split(places, firsts[1:]) if len(values) else []):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(some)

        look(np.arange(size))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (ranks[at] == rank)]
            if len(at) == 0:
                continue
            touching = np.append(False, at[1:] == after[at[:-1]])
            at = at[_leftmost_of_runs(touching)]
            joined = after[at]
            symbols[at], alive[joined], after[at] = self.made[rank], False, after[joined]
            follows = after[at] < size
            before[after[at][follows]] = at[follows]
            look(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return int(alive.sum())


def _leftmost_of_runs(touching: np.ndarray) -> np.ndarray:
    """In runs of places that overlap the one before (``touching``), every second one from the left."""
    place = np.arange(len(touching))
    start = np.maximum.accumulate(np.where(touching, 0, place))
    return (place - start) % 2 == 0


def _leftmost(hit: np.ndarray) -> np.ndarray:
    """Pairs that overlap the pair before them are dropped, from the left: of a a a only the first two symbols join."""
    if not (hit[1:] & hit[:-1]).any():
        return hit
    at = np.flatnonzero(hit)
    kept = at[_leftmost_of_runs(np.append(False, at[1:] == at[:-1] + 1))]
    out = np.zeros(len(hit), bool)
    out[kept] = True
    return out


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(path)
        for batch in batches:
            texts = batch.column(1)
            counts = [
                counter.count([t or "" for t in texts.slice(first, last - first).to_pylist()])
                for first, last, _, _ in shared.byte_blocks(texts, BLOCK_BYTES)
            ]
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``vocabulary`` is the path, on every executor, of a byte-level BPE file of the ``tokenizers`` library. Counts are those of
    its ``encode`` without special tokens added, truncation or padding: strings of special tokens inside a text count as one
    token. A null or empty text has no bytes and no tokens. Repeated ids stay repeated rows, a null id stays null, and other
    columns are not read. An empty table gives an empty table. Whole texts are counted; a batch is cut into
    blocks of about ``BLOCK_BYTES``, and a longer text makes a block of its own.
    """
    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = shared.smaller_batches(source).mapInArrow(_counted(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def totals(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Documents, tokens and documents over the limit of each group of ``by`` columns, or of all rows."""
    return counts.groupBy(*(by or [])).agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.count_if("over_limit").alias("n_over_limit"),
    )
