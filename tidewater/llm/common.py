"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text processed at once inside a task, in bytes; bounds numpy temporaries.
CHUNK_BYTES = 1 << 20
_CACHES: list = []


def per_worker(build: Callable) -> Callable:
    """Keep the last result of ``build`` for all tasks of a Python worker, until another operator's turn."""
    cached = lru_cache(maxsize=1)(build)
    _CACHES.append(cached)

    @wraps(build)
    def get(*args):
        release(cached)
        return cached(*args)

    return get


def dropped_in_turn(cached: Callable) -> Callable:
    """Count a cache among those that another operator's turn drops."""
    _CACHES.append(cached)
    return cached


def release(keep: Callable | None = None) -> None:
    """Drop what other operators keep in this worker, which outlives its stage."""
    full = [c for c in _CACHES if c is not keep and c.cache_info().currsize]
    for c in full:
        c.cache_clear()
    if full:
        gc.collect()
        pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting (as in tests) gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/tidewater-{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors. Returns the reread
    frame and its path, for :func:`discard`.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stashed tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``text`` column holds about ``limit`` bytes each."""
    n = batch.num_rows
    if n == 0:
        return
    text = batch.column(batch.schema.get_field_index("text"))
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The ``text`` column as strings; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective scrambling) over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trimmed(known: dict[str, object], limit: int) -> dict[str, object]:
    """``known``, or beyond ``limit`` words the shorter half of it, which texts use most."""
    if len(known) <= limit:
        return known
    size = int(np.median([len(w) for w in known]))
    return {w: x for w, x in known.items() if len(w) < size}


def fill_missing(parts: list[list[str]], found: list[list], known: dict, learn: Callable[[list[str]], list]) -> None:
    """Put the results of words that ``known`` lacked (None in ``found``) in place, learning each word once."""
    at, missing = [], {}
    for words, got in zip(parts, found, strict=True):
        j = -1
        try:
            while True:
                j = got.index(None, j + 1)
                at.append((got, j, words[j]))
                missing[words[j]] = None
        except ValueError:
            continue
    if missing:
        words = list(missing)
        known.update(zip(words, learn(words), strict=True))
        for got, j, w in at:
            got[j] = known[w]


def appended(df: DataFrame, fields: list[tuple[str, pa.DataType, T.DataType]], make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``df`` with columns that ``make`` computes from slices of its rows, as lists or arrays.

    A column of ``df`` with one of the new names is overwritten; all others pass
    unread. ``df`` needs a column text.
    """
    new = [n for n, _, _ in fields]
    kept = [f for f in df.schema if f.name not in new]
    # Columns travel by position: names may hold dots or differ in case only.
    source = df.select(*[F.col(quoted(f.name)).alias("text" if f.name == "text" else f"c{i}") for i, f in enumerate(kept)])
    schema = T.StructType([*source.schema, *(T.StructField(f"n{i}", t) for i, (_, _, t) in enumerate(fields))])
    names = [f.name for f in kept] + new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in text_chunks(batch):
                made = [pa.array(v, t) for v, (_, t, _) in zip(make(part), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], schema.names)

    return source.mapInArrow(run, schema).toDF(*names)


def quoted(name: str) -> str:
    """A column's name for F.col, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, tag: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (tag, *(f"{tag}_{i}" for i in range(len(taken) + 1))) if n not in taken)
