"""Vector columns as numpy matrices and as bytes that can be grouped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import quoted, release

#: Rows taken at once inside a task.
ROWS = 4096


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components in one array (a null one as NaN), where each vector begins (one more entry ends the last), and which are null."""
    offsets = np.asarray(column.offsets, np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
    return flat, offsets - offsets[0], column.is_null().to_numpy(zero_copy_only=False)


def usable(flat: np.ndarray, at: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Which vectors are there, with finite components only."""
    bad = np.cumsum(np.r_[0, ~np.isfinite(flat)])
    return ~null & (bad[at[1:]] == bad[at[:-1]])


def packed(vectors: DataFrame, id_col: str, vec_col: str, pack) -> DataFrame:
    """id and key of the rows of ``vectors``; ``pack`` makes a list of keys (None: leave the row out) from :func:`ragged` parts."""
    kind = vectors.schema[vec_col].dataType
    vec = F.col(quoted(vec_col))
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        vec = vec.cast("array<double>")
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                keys = pack(*ragged(part.column(1)))
                at = [i for i, key in enumerate(keys) if key is not None]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([keys[i] for i in at], pa.binary())], ["id", "key"])

    return vectors.select(F.col(quoted(id_col)).alias("id"), vec.alias("v")).mapInArrow(run, schema)
