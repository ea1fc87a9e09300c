"""The vocabulary of a SentencePiece model, as tables for the operators.

The file's own normaliser settings are honoured: dummy prefix, escaped white
space and, where set, removal of extra white space. Character maps other than
identity are applied by the library's normaliser.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tidewater.llm.common import fill_missing, trimmed

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary:
    """Pieces, scores and normalisation of one model file's bytes."""

    def __init__(self, model: bytes):
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, self.kind = proto.normalizer_spec, proto.trainer_spec.model_type  # 1 unigram, 2 BPE
        if self.kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.strings = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_fallback = bool(proto.trainer_spec.byte_fallback)
        self.prefix = bool(spec.add_dummy_prefix)
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self._library = None if plain else sentencepiece.SentencePieceProcessor(model_proto=model)
        # No piece holds white space behind another character: then words are independent.
        by_word = not any(re.search(f"[^{SPACE}]{SPACE}", s) for s in self.ids)
        self.cuts = plain and self.prefix and by_word

    def normalise(self, text: str) -> str:
        if self._library is not None:
            return self._library.normalize(text)
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def words(self, text: str) -> list[str]:
        """Independent parts of the text, without the one space mark that each begins with.

        A model that has no such parts gives the whole normalised text as one.
        """
        if self.cuts and text and text[0] != " " and "  " not in text and SPACE not in text:
            return text.split(" ")
        if self.cuts:
            return [w[1:] for w in _RUNS.findall(self.normalise(text))]
        return [self.normalise(text)] if text else []


class WordCache:
    """Results of ``encode`` for distinct words, for all texts that a worker sees.

    Holds ``limit`` words at most: beyond that the longer ones go.
    """

    def __init__(self, vocabulary: Vocabulary, encode: Callable[[list[str]], list], limit: int = 1_000_000):
        self.v, self.encode, self.limit = vocabulary, encode, limit
        self.known: dict[str, object] = {}

    def of(self, texts: list[str]) -> list[list]:
        """For each text, the results of its words in order."""
        self.known = trimmed(self.known, self.limit)
        known, parts = self.known, [self.v.words(t) if t else [] for t in texts]
        found = [list(map(known.get, p)) for p in parts]
        mark = SPACE if self.v.cuts else ""
        fill_missing(parts, found, known, lambda words: self.encode([mark + w for w in words]))
        return found


def merge_table(v: Vocabulary) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and the ways to merge two of them.

    Returns symbol numbers by string, and, sorted by key (left * n + right), the
    keys, the merged symbols, their ranks (0 first) and whether each merge is one
    of a kind after which a lower rank can turn up next to it: then occurrences
    near each other must go one after the other.
    """
    symbols = dict.fromkeys(v.ids)
    for s in v.ids:
        symbols.update(dict.fromkeys(s))
    number = {s: i for i, s in enumerate(symbols)}
    order = {score: r for r, score in enumerate(sorted({v.scores[i] for i in v.ids.values()}, reverse=True))}
    rank = {s: order[v.scores[i]] for s, i in v.ids.items()}
    n, rows, wary = len(number), [], set()
    for s in v.ids:
        for k in range(1, len(s)):
            a, b = s[:k], s[k:]
            if a in number and b in number:
                rows.append((number[a] * n + number[b], number[s], rank[s]))
                wary.update(number[x] for x in (a, b) if len(x) > 1 and rank[x] >= rank[s])
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    # Pieces of equal rank, too, must go from left to right.
    first = np.unique(np.unique(table[:, 1:], axis=0)[:, 1], return_counts=True)
    shared = first[0][first[1] > 1]
    careful = np.isin(table[:, 1], np.fromiter(wary, np.int64, len(wary))) | np.isin(table[:, 2], shared)
    return number, table[:, 0], table[:, 1], table[:, 2], careful
