"""State over a clock: hysteresis, runs, holds, latches, phases.

All are window chains over one (key, t, tie) order, so a key is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.operators.clock import in_order


def islands(df: DataFrame, key: list[str], order: list[str], breaks: Column, out: str = "island") -> DataFrame:
    """Numbers stretches of rows; a row where ``breaks`` is true begins a new one."""
    w = in_order(key, *order)
    return df.withColumn("_brk", breaks.cast("int")).withColumn(out, F.sum("_brk").over(w)).drop("_brk")


def hysteresis(df: DataFrame, key: list[str], order: list[str], v: str, on: float, off: float, ok: Column, out: str = "state") -> DataFrame:
    """1 above ``on``, 0 at or below ``off``, else as before; -1 where not ok, and until known after that."""
    d = islands(df.withColumn("_ok", F.coalesce(ok, F.lit(False))), key, order, ~F.col("_ok"), "_seg")
    mark = F.when(F.col("_ok"), F.when(F.col(v) > on, 1).when(F.col(v) <= off, 0))
    held = F.last(mark, ignorenulls=True).over(in_order([*key, "_seg"], *order))
    return d.withColumn(out, F.when(F.col("_ok"), F.coalesce(held, F.lit(-1))).otherwise(-1)).drop("_ok", "_seg")


def runs(df: DataFrame, key: list[str], order: list[str], state: str, split: Column | None = None) -> DataFrame:
    """Adds run: stretches of equal state, also cut where ``split`` is true."""
    w = in_order(key, *order)
    change = F.coalesce(~F.lag(state).over(w).eqNullSafe(F.col(state)), F.lit(True))
    return islands(df, key, order, change if split is None else change | F.coalesce(split, F.lit(False)), "run")


def episodes(df: DataFrame, key: list[str], order: list[str], state: str, t: str, dur: str, least: int) -> DataFrame:
    """Contact episodes: runs of state 1 with their length and censoring.

    ``confirmed`` if they last ``least``; censored on a side where the state is
    unknown or the record ends there.
    """
    r = runs(df, key, order, state)
    per = r.groupBy(*key, "run").agg(
        F.first(state).alias("state"), F.min(t).alias("start"), F.max(F.col(t) + F.col(dur)).alias("end"),
        F.sum(dur).cast("long").alias("length"), F.count("*").alias("samples"),
    )
    w = in_order(key, "run")
    side = lambda c: F.coalesce(c == -1, F.lit(True))
    per = per.withColumn("left_censored", side(F.lag("state").over(w))).withColumn("right_censored", side(F.lead("state").over(w)))
    return per.where(F.col("state") == 1).withColumn("confirmed", F.col("length") >= least).drop("state", "run")


def hold_timer(df: DataFrame, key: list[str], order: list[str], t: str, condition: Column, gap: Column, out: str = "held") -> DataFrame:
    """How long the condition has been true without a break (null where it is not); a gap restarts it."""
    w = in_order(key, *order)
    d = df.withColumn("_c", F.coalesce(condition, F.lit(False)))
    brk = F.when(F.col("_c"), F.coalesce(gap, F.lit(False)).cast("int")).otherwise(1)
    d = d.withColumn("_i", F.sum(brk).over(w))
    since = F.min(F.when(F.col("_c"), F.col(t))).over(in_order([*key, "_i"], *order))
    return d.withColumn(out, F.when(F.col("_c"), F.col(t) - since)).drop("_c", "_i")


def first_hold(df: DataFrame, key: list[str], t: str, held: str, least: int, after: str | None = None, strict: bool = False) -> Column:
    """Over a whole key: the first t at which ``held`` reaches ``least``, not before ``after``."""
    ok = (F.col(held) > least) if strict else (F.col(held) >= least)
    ok = ok if after is None else ok & (F.col(t) >= F.col(after))
    return F.min(F.when(ok, F.col(t))).over(Window.partitionBy(*key))


def phases(df: DataFrame, key: list[str], order: list[str], grasp: Column, board: Column) -> DataFrame:
    """Adds phase: board, post_board (seen before), grasp, pre, or unknown, in that order of precedence."""
    w = in_order(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.coalesce(board, F.lit(False))).over(w), F.lit(False))
    phase = F.when(board, "board").when(seen, "post_board").when(grasp, "grasp").when(grasp.isNull() | board.isNull(), "unknown")
    return df.withColumn("phase", phase.otherwise("pre"))


def merged_intervals(df: DataFrame, key: list[str], start: str, end: str, label: str) -> DataFrame:
    """Adjacent intervals with one label become one: key, label, start, end, parts."""
    w = in_order(key, start, end)
    fresh = ~(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.coalesce(F.lag(end).over(w) == F.col(start), F.lit(False)))
    d = islands(df, key, [start, end], F.coalesce(fresh, F.lit(True)))
    return d.groupBy(*key, "island", label).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("parts")).drop("island")


def state_changes(df: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before, with ``before``."""
    d = df.withColumn("before", F.lag(state).over(in_order(key, *order)))
    return d.where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))


def debounced(df: DataFrame, key: list[str], t: str, tie: str, v: str, on: float, release: float, tail: int, out: str = "contact") -> DataFrame:
    """Contact from a value at or above ``on``, kept while above ``release``, and for ``tail`` after."""
    w = in_order(key, t, tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    high = F.coalesce((F.col(v) > release) | (F.col(v) >= on), F.lit(False))
    d = df.withColumn("_h", high).withColumn("_pt", F.lag(t).over(w))
    d = d.withColumn("_ph", F.last(F.when(F.col("_h"), F.col(t)), ignorenulls=True).over(before))
    lapsed = F.col("_ph").isNull() | ((F.col("_pt") != F.col("_ph")) & (F.col("_pt") >= F.col("_ph") + tail))
    d = d.withColumn("_i", F.sum(F.when(F.col("_h") & lapsed, 1).otherwise(0)).over(w))
    started = F.max(F.coalesce(F.col(v) >= on, F.lit(False))).over(in_order([*key, "_i"], t, tie))
    d = d.withColumn("_ref", F.col("_h") & started)
    last = F.last(F.when(F.col("_ref"), F.col(t)), ignorenulls=True).over(w)
    return d.withColumn(out, F.col("_ref") | F.coalesce(F.col(t) < last + tail, F.lit(False))).drop("_h", "_pt", "_ph", "_i", "_ref")


def trailing_run(df: DataFrame, key: list[str], order: list[str], t: str, condition: Column) -> DataFrame:
    """Where the condition holds from some row to the end: key, since, samples (no row where it does not)."""
    back = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    d = df.withColumn("_bad", F.sum((~F.coalesce(condition, F.lit(False))).cast("int")).over(back))
    return d.where(F.col("_bad") == 0).groupBy(*key).agg(F.min(t).alias("since"), F.count("*").alias("samples"))


def growth_runs(df: DataFrame, key: list[str], order: list[str], t: str, v: str, tolerance: float, gap: str | None = None) -> DataFrame:
    """Stretches over which each value exceeds the one before by more than ``tolerance``; no step crosses a ``gap`` (of the row before)."""
    w = in_order(key, *order)
    grows = F.coalesce(F.col(v) - F.lag(v).over(w) > tolerance, F.lit(False))
    if gap is not None:
        grows = grows & ~F.coalesce(F.lag(gap).over(w), F.lit(False))
    d = islands(df.withColumn("_g", grows), key, order, ~F.col("_g"))
    out = d.groupBy(*key, "island").agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("samples"), (F.max(v) - F.min(v)).alias("rise")
    )
    return out.where(F.col("samples") > 1).drop("island")


def plateaus(df: DataFrame, key: list[str], order: list[str], t: str, v: str, tolerance: float, least: int, gap: str) -> DataFrame:
    """Greedy stretches of two samples or more whose values stay within ``tolerance`` for at least ``least``.

    Each begins where the one before ended; an unknown value or a ``gap`` (behind a
    row) ends one. So this is read in order, a key at a time, as a stream of sorted
    rows (memory does not grow with a key). A key may be null or any whole number.
    """
    fields = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {fields[k]}" for k in key), f"start {fields[t]}", f"end {fields[t]}", "samples long"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lo, hi, start, end, n, cut, out = None, 0.0, 0.0, 0, 0, 0, False, []

        def close() -> None:
            if n > 1 and end - start >= least:
                out.append((*now, start, end, n))

        for batch in batches:
            for *k, at, x, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == now and n and not cut and x is not None and max(hi, x) - min(lo, x) <= tolerance:
                    lo, hi, end, n = min(lo, x), max(hi, x), at, n + 1
                else:
                    close()
                    now, lo, hi, start, end, n = k, x, x, at, at, int(x is not None)
                cut = ends
            yield table(out)
            out.clear()
        close()
        yield table(out)

    names = [*key, "start", "end", "samples"]
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(names))], names)

    value = F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
    ordered = df.select(*key, t, value.alias("_v"), F.coalesce(gap, F.lit(False)).alias("_g"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    ordered = ordered.repartition(*key).sortWithinPartitions(*key, *[f"_o{i}" for i in range(len(order))]).select(*key, t, "_v", "_g")
    return ordered.mapInArrow(scan, schema)
