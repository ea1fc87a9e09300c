"""Operator 1: exact token counts by rank-synchronous array merging.

The distinct words of a batch of texts lie end to end in one numpy array of
symbols. Each round looks up the rank of every adjacent pair, finds every word's
lowest rank and applies that pair in all words at once, wherever it stands; a word
leaves when no pair of it can merge. A long word (text without spaces) counts as
many sequences: a pair may go as soon as none ranks lower within the longest
piece's reach, which no merge farther away can cross. So rounds do not grow with a
word's length. What survives are tokens: one for a known symbol, one for each
UTF-8 byte of an unknown one (byte fallback).
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import per_worker, text_chunks, texts_of
from tidewater.llm.pieces import Vocabulary, WordCache, merge_table

NONE = np.iinfo(np.int64).max
#: Characters from which a word is long, and characters of long words that are merged at once.
LONG, AT_ONCE = 64, 500_000


def window_min(values: np.ndarray, reach: int) -> np.ndarray:
    """The least value within ``reach`` places of each place."""
    width, n = 2 * reach + 1, len(values)
    m = np.r_[np.full(reach, NONE), values, np.full(reach, NONE)]
    size = 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[width - size : width - size + n])


class RankMerger:
    """Counts tokens of words under a BPE vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.kind != 2:
            raise ValueError("rank-synchronous merging needs a BPE model")
        self.v = vocabulary
        self.number, self.keys, self.merged, self.ranks, self.careful = merge_table(vocabulary)
        self.n, self.longest = len(self.number), max(map(len, vocabulary.ids), default=1)
        self.cost: dict[str, int] = {s: 1 for s in vocabulary.ids}

    def _cost(self, symbol: str) -> int:
        got = self.cost.get(symbol)
        if got is None:
            got = len(symbol.encode()) if self.v.byte_fallback else 1
        return got

    def surviving(self, words: list[str]) -> list[int]:
        """Tokens of each word."""
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        counts = [0] * len(words)
        for i, n in zip(short, self._short([words[i] for i in short]) if short else (), strict=True):
            counts[i] = n
        held, owner, total = [], [], 0
        for i, w in enumerate(words):
            if len(w) > LONG:
                for part in self._parts(w):
                    held.append(part)
                    owner.append(i)
                    total += len(part[0])
                    if total > AT_ONCE:
                        self._long(held, owner, counts)
                        held, owner, total = [], [], 0
        if held:
            self._long(held, owner, counts)
        return counts

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all letters of the words (-1: none), and the tokens that a letter costs beyond one."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        letters, symbol = np.unique(chars, return_inverse=True)
        strings = [chr(c) for c in letters]
        known = np.array([self.number.get(c, -1) for c in strings], np.int64)
        # A character outside the vocabulary never merges and costs the same to the end.
        extra = np.array([self._cost(c) - 1 if c not in self.v.ids else 0 for c in strings], np.int64)
        return known[symbol], extra[symbol]

    def _pairs(self, symbol: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of adjacent symbols that can merge, and where the table has them; ``same`` marks pairs within a word."""
        at = np.flatnonzero(same & (symbol[:-1] >= 0) & (symbol[1:] >= 0))
        key = symbol[at] * self.n + symbol[at + 1]
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[slot] == key
        return at[hit], slot[hit]

    def _short(self, words: list[str]) -> list[int]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol, extra = self._letters(words)
        owner = np.repeat(np.arange(len(words)), lengths)
        counts = np.bincount(owner, weights=extra, minlength=len(words)).astype(np.int64)
        while symbol.size:
            at, slot = self._pairs(symbol, owner[:-1] == owner[1:])
            if not at.size:
                counts += np.bincount(owner, minlength=len(words))
                break
            rank = self.ranks[slot]
            best = np.full(len(words), NONE)
            np.minimum.at(best, owner[at], rank)
            lowest = rank == best[owner[at]]
            at, slot = at[lowest], slot[lowest]
            # Of overlapping pairs in a run, every second one goes, from the left.
            start = np.r_[True, np.diff(at) != 1]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            take = (place % 2 == 0) & (~self.careful[slot] | np.r_[True, owner[at][1:] != owner[at][:-1]])
            at, slot = at[take], slot[take]
            symbol[at] = self.merged[slot]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            # Words without a pair that can merge are done and leave.
            done = best[owner] == NONE
            counts += np.bincount(owner[done], minlength=len(words))
            keep &= ~done
            symbol, owner = symbol[keep], owner[keep]
        return counts.tolist()

    def _parts(self, word: str) -> Iterator[tuple[str, np.ndarray]]:
        """Stretches of a long word that no piece joins, and how far pieces that start up to each letter reach."""
        ids, n, start, far = self.v.ids, len(word), 0, 0
        reach = np.empty(n, np.int64)
        for i in range(n):
            if i and far <= i:
                yield word[start:i], reach[start:i] - start
                start = i
            far = max(far, i + 1)
            for j in range(min(n, i + self.longest), far, -1):
                if word[i:j] in ids:
                    far = j
                    break
            reach[i] = far
        yield word[start:], reach[start:] - start

    def _long(self, parts: list[tuple[str, np.ndarray]], owners: list[int], counts: list[int]) -> None:
        """Add the tokens of stretches of long words to ``counts``."""
        lengths = np.array([len(w) for w, _ in parts])
        base = np.cumsum(lengths) - lengths
        symbol, extra = self._letters([w for w, _ in parts])
        place, owner = np.arange(len(symbol)), np.repeat(np.arange(len(parts)), lengths)
        reach = np.concatenate([r for _, r in parts]) + np.repeat(base, lengths)
        cost = np.bincount(owner, weights=extra, minlength=len(parts)).astype(np.int64)
        while symbol.size:
            at, slot = self._pairs(symbol, owner[:-1] == owner[1:])
            if not at.size:
                break
            rank = np.full(len(symbol), NONE)
            rank[at] = self.ranks[slot]
            lowest = rank[at] == window_min(rank, self.longest - 1)[at]
            # The nearest equal pair on the left, where one piece could hold both.
            order = np.lexsort((at, self.ranks[slot]))
            left = np.full(len(at), -1)
            left[order[1:]] = np.where(self.ranks[slot][order[1:]] == self.ranks[slot][order[:-1]], order[:-1], -1)
            tied = (left >= 0) & (reach[place[at[left]]] > place[at])
            able = lowest & ~(tied & self.careful[slot])
            # Overlapping pairs of a kind: every second one from the left, while the run's first ones may go.
            overlap = np.r_[False, (np.diff(at) == 1) & (self.ranks[slot][1:] == self.ranks[slot][:-1])]
            index = np.arange(len(at))
            first = np.maximum.accumulate(np.where(~overlap, index, 0))
            stopped = np.maximum.accumulate(np.where(~able, index, -1))
            take = able & (stopped < first) & ((index - first) % 2 == 0)
            at, slot = at[take], slot[take]
            symbol[at] = self.merged[slot]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, owner, place = symbol[keep], owner[keep], place[keep]
        cost += np.bincount(owner, minlength=len(parts))
        for i, n in zip(owners, cost.tolist(), strict=True):
            counts[i] += n


@per_worker
def counter(model: bytes) -> WordCache:
    """A word cache that counts tokens; a worker builds it once for all its tasks."""
    v = Vocabulary(model)
    return WordCache(v, RankMerger(v).surviving)


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Count the tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    ``documents`` needs doc_id and text; other columns are left alone, whatever
    their names. A null text counts as empty (0 bytes, 0 tokens); a null doc_id
    stays null; repeated rows give repeated results; an empty table gives none.
    No begin, end or other special tokens are added, and their strings in a text
    are ordinary text. Narrow: no shuffle, memory bounded by the batch.
    """
    model = Path(model_path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = counter(model)
        for batch in batches:
            for part in text_chunks(batch, 2 << 20):
                texts = texts_of(part)
                counts = [sum(x) for x in cache.of(texts)]
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(counts, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    out = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
