"""Counts of 64-bit fingerprints over all tasks, and bitmaps of the frequent ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import discard, stash

PIECES = 256


class Packer:
    """Counts of fingerprints (their top ``bits``), packed by range: steps between sorted ones as byte planes, and the counts above 1."""

    def __init__(self, parts: int, bits: int):
        self.parts, self.bits = parts, bits  # parts: a power of two
        self.values: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, fingerprints: np.ndarray, counts: np.ndarray) -> None:
        self.values.append(fingerprints >> np.uint64(64 - self.bits))
        self.counts.append(counts.astype(np.uint64))
        self.held += len(fingerprints)

    def packs(self) -> tuple[list[int], list[bytes], list[bytes]]:
        v, n = summed(np.concatenate(self.values), np.concatenate(self.counts))
        width = (1 << self.bits) // self.parts
        cut = [0, *np.searchsorted(v, np.arange(1, self.parts, dtype=np.uint64) * np.uint64(width)).tolist(), len(v)]
        planes, more = [], []
        for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            step = np.diff(v[a:b], prepend=np.uint64(k * width)).astype("<u8")
            planes.append(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())
            several = np.flatnonzero(n[a:b] > 1)
            more.append(np.c_[several, n[a:b][several]].astype("<u8").tobytes())
        self.values, self.counts, self.held = [], [], 0
        at = [k for k in range(self.parts) if planes[k]]
        return at, [planes[k] for k in at], [more[k] for k in at]


def summed(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, each with the sum of its counts."""
    order = np.argsort(v, kind="stable")
    v, n = v[order], n[order]
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, int)
    return v[start], np.add.reduceat(n, start) if len(start) else n


def frequent(packs: DataFrame, bits: int, parts: int, least: int) -> DataFrame:
    """h: the fingerprints of which ``packs`` (part, steps, more) count ``least`` or more; those that agree in their top ``bits`` count together."""
    width = (1 << bits) // parts

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        values, counts = [], []
        base = np.uint64(int(rows["part"].iloc[0]) * width)
        for steps, more in zip(rows["steps"], rows["more"], strict=True):
            v = np.cumsum(np.frombuffer(steps, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64) + base
            n, m = np.ones(len(v), np.uint64), np.frombuffer(more, "<u8").reshape(-1, 2)
            n[m[:, 0].astype(int)] = m[:, 1]
            values.append(v)
            counts.append(n)
        v, n = summed(np.concatenate(values), np.concatenate(counts))
        return pd.DataFrame({"h": (v[n >= least] << np.uint64(64 - bits)).view(np.int64)})

    return packs.select("part", "steps", "more").groupBy("part").applyInPandas(merge, "h long")


def bitmap(hashes: DataFrame, width: int) -> np.ndarray:
    """A map of 2 ** ``width`` bits with the places of all fingerprints of column h (others may share them)."""
    size = (1 << width) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (7 - (at & 7))).astype(np.uint8))
        for k in range(PIECES):
            piece = bits[k * size // PIECES : (k + 1) * size // PIECES]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.tobytes()])], ["k", "bits"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": rows["k"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]]).tobytes()]})

    pieces, path = stash(hashes.select("h").mapInArrow(run, "k int, bits binary").groupBy("k").applyInPandas(merge, "k int, bits binary"), "bitmap")
    out = np.zeros(size, np.uint8)
    for r in pieces.collect():
        out[r.k * size // PIECES : (r.k + 1) * size // PIECES] = np.frombuffer(r.bits, np.uint8)
    discard(hashes.sparkSession, path)
    return out


def in_map(bits: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Which fingerprints may be among those of the map."""
    at = (fingerprints >> np.uint64(64 - (int(len(bits) * 8).bit_length() - 1))).astype(np.int64)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def map_width(total: int, least: int) -> int:
    """log2 of the bits of a map of what occurs ``least`` times or more among ``total``: 32 bits for each, at most 32 MB."""
    return min(28, max(16, (32 * total // max(1, least)).bit_length()))


