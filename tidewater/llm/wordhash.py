"""Word and shingle fingerprints of many texts at once, in numpy.

A word's fingerprint is a polynomial over its bytes modulo 2^64, taken for all
words of a chunk from one running sum, and then scrambled.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np

from tidewater.llm.common import dropped_in_turn, mix64

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
LANES = np.array([pow(BASE, 3 + 2 * i, 2**64) for i in range(64)], np.uint64)


@dropped_in_turn
@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(size, np.uint64)
    ones[0] = 1
    up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for ``size`` places at least."""
    return _powers(1 << max(16, int(size - 1).bit_length()))


def word_hashes(texts: list[bytes], separator: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and where each text's words start (one more entry ends the last).

    ``separator`` marks the bytes between words (a line end must be one), ``fold``
    maps bytes before hashing.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    out = separator[buf]
    before = np.empty_like(out)
    before[0], before[1:] = True, out[:-1]
    start, end = np.flatnonzero(before & ~out), np.flatnonzero(~before & out)
    h = stretches(fold[buf], start, end)
    limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(start, limits)


def stretches(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the stretches of whole numbers from each start to its end."""
    up, down = powers(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    h = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    # Known ways to make such sums collide need long words: these get a keyless digest.
    for i in np.flatnonzero(end - start > 512):
        digest = blake2b(np.ascontiguousarray(values[start[i] : end[i]]).tobytes(), digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def runs(words: np.ndarray, offsets: list[int]) -> np.ndarray:
    """At each place i that allows it, the fingerprint of the words at i + offset, in that order."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(offsets), np.uint64)
    for lane, o in zip(LANES, offsets, strict=False):
        h += words[o : o + n] * lane
    return mix64(h)
