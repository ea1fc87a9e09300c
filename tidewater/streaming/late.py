"""Event time on a stream: late rows in a sink of their own, and sessions whose state ends with the watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Groups among which marked_late deals the keys.
SHARDS = 128


def marked_late(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The rows of a stream with late: whether ``ts`` was behind the watermark (``delay`` behind the latest time of earlier micro-batches).

    Nothing is dropped. Rows that come in the same micro-batch as the time that
    moves the watermark are on time, and so is a row without a time. Keys share
    ``SHARDS`` groups, so a micro-batch takes as many calls however many keys it has.
    """
    schema = StructType([*df.schema.fields]).add("late", "boolean")

    def mark(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        for f in frames:
            f["late"] = (f["_ms"] < watermark).fillna(False).astype(bool)
            yield f[schema.names]

    # The state stays empty: the operator is stateful only to see the query's watermark.
    timed = df.withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp"))).withWatermark(ts, delay)
    return timed.withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(SHARDS))).groupBy("_shard").applyInPandasWithState(mark, schema, "nothing int", "append", GroupStateTimeout.NoTimeout)


def sessions(df: DataFrame, key: str, ts: str, delay: str, gap_ms: int) -> DataFrame:
    """Sessions of a key: key, start, end (milliseconds), n. One ends ``gap_ms`` behind its last row and is sent once the watermark has passed that end.

    A key's state holds its open sessions only and goes with the last of them.
    Rows behind the watermark of the micro-batch before do not count: the engine drops
    them here (:func:`marked_late` keeps such rows).
    """
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, start long, end long, n long"

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            opened = merged([*opened, *((int(x), int(x), 1) for f in frames for x in f["_ms"].dropna())], gap_ms)
        now = state.getCurrentWatermarkMs()
        done, opened = [s for s in opened if s[1] + gap_ms <= now], [s for s in opened if s[1] + gap_ms > now]
        if opened:
            state.update(tuple(list(c) for c in zip(*opened, strict=True)))
            state.setTimeoutTimestamp(min(e for _, e, _ in opened) + gap_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(k[0], *s) for s in done], columns=[key, "start", "end", "n"])

    kept = "start array<long>, end array<long>, n array<long>"
    timed = df.withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp"))).withWatermark(ts, delay).select(key, ts, "_ms")
    return timed.groupBy(key).applyInPandasWithState(update, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def merged(parts: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (start, end, n) joined where less than ``gap`` lies between them."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(parts):
        if out and a - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + n)
        else:
            out.append((a, b, n))
    return out


def run_into(stream: DataFrame, path: str, split: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> dict[str, DataFrame]:
    """Runs a stream over all data that is there, each micro-batch into folders of its own, and reads what they add up to.

    ``split`` makes several sinks of a micro-batch, by name. A batch that is run
    again after a failure replaces its folders, so nothing counts twice, and a run
    on the same ``path`` goes on where the last one stopped. Every batch leaves its
    count; to read back another number of rows is an error, however many batches
    there were.
    """
    spark = stream.sparkSession
    split = split or (lambda batch: {"rows": batch})

    def put(name: str, part: DataFrame, number: int) -> None:
        seen = Observation()
        part.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        said = part.sparkSession.createDataFrame([(number, int(seen.get["n"]))], "number long, n long")
        said.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}-counts/batch={number}")

    def keep(batch: DataFrame, number: int) -> None:
        if len(nothing) > 1:  # each sink would run the micro-batch anew, its state included
            batch.persist()
        try:
            for name, part in split(batch).items():
                put(name, part, number)
        finally:
            batch.unpersist()

    nothing = split(spark.createDataFrame([], stream.schema))
    for name, part in nothing.items():
        put(name, part, -1)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = {}
    for name, part in nothing.items():
        out[name] = spark.read.schema(part.schema).parquet(f"{path}/{name}/*")
        said = spark.read.schema("number long, n long").parquet(f"{path}/{name}-counts/*").agg(F.sum("n")).first()[0]
        if (have := out[name].count()) != said:
            raise OSError(f"{path}/{name}: the stream made {said} records, {have} are there")
    return out
