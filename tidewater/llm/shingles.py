"""Sets of word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

from tidewater.llm.wordhash import runs, word_hashes

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
NO_SET = np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct fingerprints of its ``size``-word shingles.

    A text with fewer words has its whole sequence as the one shingle; one
    without words has none.
    """
    words, at = word_hashes(texts, SEPARATOR, FOLD)
    every = runs(words, list(range(size)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(every[a : b - size + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        else:
            yield runs(words[a:b], list(range(b - a))) if b > a else NO_SET


def set_id(shingles: np.ndarray) -> bytes:
    """A 128-bit identity of a set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()
