"""Operator 13: centroid clustering of whole-number vectors, each distinct one once.

Components are scaled and floored, equal vectors grouped with their number (combined
before the shuffle, so a vector that a third of all rows share is one row of each
task), and Lloyd's rounds run on the distinct ones alone: a task sends for each cluster
the sum of its vectors times their numbers, as whole numbers, and the driver sees one
row for each cluster. Assignments are joined back to the rows at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, release, stash
from tidewater.llm.vectors import packed, usable

#: Whole-number components must be smaller, so that a squared distance fits 63 bits.
LIMIT = 1 << 27
#: Components for which squared distances are exact in doubles.
EXACT = 1 << 20


def whole_numbers(scale: int, size: int):
    """A packer of vectors with ``size`` finite components into floor(scale * x), as 32-bit integers."""

    def pack(flat: np.ndarray, at: np.ndarray, null: np.ndarray) -> list[bytes | None]:
        good = usable(flat, at, null) & (np.diff(at) == size)
        x = np.floor(flat[np.repeat(good, np.diff(at))] * scale)
        if len(x) and np.abs(x).max() >= LIMIT:
            raise ValueError(f"a component is beyond {LIMIT / scale:g}: squared distances do not fit 63 bits")
        rows = iter(x.astype("<i4").reshape(-1, size) if size else np.zeros((int(good.sum()), 0), "<i4"))
        return [next(rows).tobytes() if g else None for g in good]

    return pack


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of whole-number vectors, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT and x.shape[1] <= 1 << 10:
        f, c = x.astype(float), centroids.astype(float)
        return ((f**2).sum(1)[:, None] + (c**2).sum(1) - 2 * (f @ c.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def _matrix(keys: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign, then the floor of each cluster's mean; an empty cluster keeps its centroid."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x, weight = _matrix(batch.column(0), size), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            near = distances(x, centroids).argmin(1)
            for c in range(k):
                at = near == c
                n[c] += weight[at].sum()
                total[c] += (x[at] * weight[at, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sums = [F.sum(F.col("total")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(size)]
    parts = distinct.select("key", "n").mapInArrow(run, "cluster int, n long, total array<long>")
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).where(F.col("n") > 0).collect():
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(size)]
    return out


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Assign vectors to ``k`` centroids by ``rounds`` of Lloyd's algorithm on whole numbers.

    Takes the vectors with exactly ``size`` components, none null or not finite;
    others are not in the result. Centroids start as the ``k`` rows (all, if
    fewer) whose ids have the smallest SHA-256 of ``seed:id``; ties, which only
    repeated ids can have, go to the smaller bytes of the vector, and a row with
    a null id never starts one unless all ids are null. Vectors go to the nearest
    centroid, ties to the smaller number.

    Returns one row for each row taken: the id, cluster, distance (squared),
    cluster_inertia and inertia (distances summed over its cluster and over all
    rows), centroid_sha256 (of the final centroid's components joined by ",").
    Repeated rows are returned again; a null id is returned as null; an empty
    table gives none. Components of LIMIT and more, scaled, are an error. Other
    columns are left alone, whatever their names.
    """
    spark = vectors.sparkSession
    rows = packed(vectors, id_col, vec_col, whole_numbers(scale, size))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = rows.orderBy(first.asc_nulls_last(), "key").limit(k).select("key").collect()
    schema = f"{rows.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], f"`{id_col}` {schema}")
    centroids = np.array([np.frombuffer(r.key, "<i4") for r in start], np.int64).reshape(len(start), size)
    distinct, path = stash(rows.groupBy("key").agg(F.count("*").alias("n")), "lloyd-distinct")
    for _ in range(rounds):
        new = moved(distinct, centroids)
        if (new == centroids).all():
            break  # later rounds would change nothing
        centroids = new
    final = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(_matrix(batch.column(0), size), final)
            near = d.argmin(1)
            arrays = [batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "cluster", "distance"])

    assigned, _ = stash(distinct.mapInArrow(assign, "key binary, n long, cluster int, distance long"), "lloyd-assigned")
    discard(spark, path)
    weight = F.sum(F.col("n").cast("decimal(20,0)") * F.col("distance").cast("decimal(18,0)"))
    inertia = {r.cluster: int(r.w) for r in assigned.groupBy("cluster").agg(weight.alias("w")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    by_cluster = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    out = rows.join(assigned.select("key", "cluster", "distance"), "key")
    return out.select(
        F.col("id").alias(id_col), "cluster", "distance",
        by_cluster([inertia.get(c, 0) for c in range(len(final))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(digests).alias("centroid_sha256"),
    )
