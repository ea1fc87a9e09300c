"""Stage programs over streams: the stateful twin of :mod:`tidewater.operators.stages`.

State is kept for each key: its last clock value, one timer for each hold and what
has been reached. Rows of a micro-batch are put in order; a row behind the last
one seen is a rewind, never repaired: it is counted and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class StreamStage:
    """A named stage: one hold condition, its time, and whether it starts only behind the stage before."""

    name: str
    condition: Column
    least: int
    strict: bool = False
    behind: bool = False


def observe(state: tuple, rows: list[tuple], limit: int, rules: list[tuple[int, bool, bool]]) -> tuple:
    """The state after some rows in order: (last t, since of each hold, first time of each stage, samples, gaps, rewinds).

    ``rows`` are (t, truth of each condition); a step beyond ``limit`` is a gap.
    """
    last, since, first, samples, gaps, rewinds = state
    since, first = list(since), list(first)
    for t, *conditions in rows:
        if last is not None and t < last:
            rewinds += 1
            continue
        if last is not None and t - last > limit:
            since, gaps = [None] * len(rules), gaps + 1
        last, samples = t, samples + 1
        for i, (least, strict, behind) in enumerate(rules):
            before = i == 0 or first[i - 1] is not None
            if conditions[i] is not True or (behind and not before):
                since[i] = None
                continue
            since[i] = t if since[i] is None else since[i]
            held = t - since[i]
            if before and first[i] is None and (held > least if strict else held >= least):
                first[i] = t
    return last, since, first, samples, gaps, rewinds


def stage_stream(df: DataFrame, key: str, t: str, tie: str, limit: int, program: list[StreamStage]) -> DataFrame:
    """A running report of each key: first time of every stage, highest_stage, samples, gaps, rewinds.

    Works on streaming DataFrames (output mode update: a row for each key that
    got data) and needs whole-number clocks. The last row of a key equals the
    batch report over the same rows if none came late.
    """
    names = [s.name for s in program]
    rules = [(s.least, s.strict, s.behind) for s in program]
    n = len(rules)
    kind = dict(df.dtypes)[key]
    out = ", ".join([f"{key} {kind}", *(f"{x} long" for x in names), "highest_stage int, samples long, gaps long, rewinds long"])
    kept = "last long, since array<long>, first array<long>, samples long, gaps long, rewinds long"

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (None, [None] * n, [None] * n, 0, 0, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["_t", "_tie"], kind="stable")
        flags = [rows[f"_c{i}"].astype(object).where(rows[f"_c{i}"].notna(), None).tolist() for i in range(n)]
        truth = ([x if x is None else bool(x) for x in f] for f in flags)
        now = observe(now, list(zip(map(int, rows["_t"]), *truth, strict=True)), limit, rules)
        state.update(now)
        _, _, first, samples, gaps, rewinds = now
        highest = sum(f is not None for f in first)
        line = pd.DataFrame([[k[0], *first, highest, samples, gaps, rewinds]], columns=[key, *names, "highest_stage", "samples", "gaps", "rewinds"])
        yield line.astype({x: "Int64" for x in names})

    measured = df.select(
        key, F.col(t).alias("_t"), F.col(tie).alias("_tie"), *[s.condition.cast("boolean").alias(f"_c{i}") for i, s in enumerate(program)]
    )
    return measured.groupBy(key).applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


def guard_counts(df: DataFrame, t: str, width: str, delay: str, kind: str, measured: str, threshold: float) -> DataFrame:
    """Threshold breaches of a stream in tumbling windows behind a watermark: window start, kind, n, most."""
    hit = df.withWatermark(t, delay).where(F.col(measured) > threshold)
    out = hit.groupBy(F.window(t, width).alias("w"), kind).agg(F.count("*").alias("n"), F.max(measured).alias("most"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "most")
