"""Records that a stream leaves behind: state logs, histories, committed steps, and evidence that is closed with a count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.sources.tables import scratch
from tidewater.streaming.late import run_into


def _in_order(df: DataFrame, key: str, t: str, tie: str, values: list[str], state: str, out: str, step: Callable) -> DataFrame:
    """Runs ``step(state, t, tie, *values)`` -> (state, rows) over each key's rows in order; the state starts as None. Rows without a clock are left out."""
    def update(k: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now, made = (tuple(kept.get) if kept.exists else None), []
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["_t", "_tie"], kind="stable")
        rows = rows[rows["_t"].notna()]  # a row without a clock has no place in the order
        columns = [rows[c].astype(object).where(rows[c].notna(), None) for c in ("_t", "_tie", *values)]
        for at, i, *x in zip(*columns, strict=True):
            now, new = step(now, int(at), int(i), *x)
            made += [(k[0], *r) for r in new]
        kept.update(now)
        yield pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")]).astype({c.split()[0]: "Int64" for c in out.split(", ") if c.endswith(" long")})

    named = df.select(key, F.col(t).alias("_t"), F.col(tie).alias("_tie"), *values)
    return named.groupBy(key).applyInPandasWithState(update, out, state, "append", GroupStateTimeout.NoTimeout)


def state_log(df: DataFrame, key: str, t: str, tie: str, state: str, interval: int) -> DataFrame:
    """A log of a key's state: a record at the first row, at every change, and once ``interval`` has passed since the last record."""
    def step(now: tuple | None, at: int, i: int, s: str | None) -> tuple[tuple, list]:
        if now is None or now[1] != s:
            return (at, s), [(at, i, s, "transition")]
        return ((at, s), [(at, i, s, "interval")]) if at - now[0] >= interval else (now, [])

    return _in_order(df, key, t, tie, [state], "last long, state string", f"{key} long, t long, id long, state string, why string", step)


def history_stream(df: DataFrame, key: str, t: str, tie: str, value: str, length: int) -> DataFrame:
    """Each row with its key's last ``length`` values, oldest first, the first one repeated before the start."""
    def step(now: tuple | None, at: int, i: int, x: float | None) -> tuple[tuple, list]:
        ring = list(now[0]) if now else [x] * length
        ring = [*ring[1:], x]
        return (ring,), [(at, i, ring)]

    return _in_order(df, key, t, tie, [value], "ring array<double>", f"{key} long, t long, id long, history array<double>", step)


def committed_steps(df: DataFrame, key: str, t: str, tie: str, kind: str, value: str) -> DataFrame:
    """Steps in two phases: a staged row is recorded once a commit follows; a new stage or a commit without one discards.

    Gives step (committed ones count from 1), t and value of the staged row, and
    skipped: how many stages were discarded since the last commit.
    """
    def step(now: tuple | None, at: int, i: int, k: str | None, x: float | None) -> tuple[tuple, list]:
        n, staged, value_, skipped = now or (0, None, None, 0)
        if k == "stage":
            return (n, at, x, skipped + (staged is not None)), []
        if k == "commit" and staged is not None:
            return (n + 1, None, None, 0), [(n + 1, staged, value_, skipped)]
        return (n, None, None, skipped + (staged is not None)), []

    schema = f"{key} long, step long, t long, value double, skipped long"
    return _in_order(df, key, t, tie, [kind, value], "n long, staged long, value double, skipped long", schema, step)


def captured_steps(df: DataFrame, key: str, order: str, t: str, start: str, kind: str, value: str, step: int) -> DataFrame:
    """Values captured over exactly one step each, handed to the observation at the step's end; one row out for each row in.

    Rows come in the order of ``order`` and are captures (from ``start`` to ``t``) or
    observations (at ``t``). A capture of any other length, or of an unknown value, is
    refused and clears what was captured; an observation takes the capture that ends
    at its own clock, once. A clock that goes back, or is missing, ends the key: nothing after it counts. Gives
    t, id (the order), why (captured, inexact, unknown, used, none, rewind or ended), value
    (where used) and total (of values times ``step`` so far).
    """
    def advance(now: tuple | None, i: int, _: int, at: int | None, since: int | None, k: str | None, x: float | None) -> tuple[tuple, list]:
        last, until, held, total, over = now or (None, None, None, 0.0, False)
        state, why, out = (last, until, held, total, over), "ended", None
        if not over and (at is None or (last is not None and at < last)):
            state, why = (last, None, None, total, True), "rewind"
        elif not over and k == "capture":
            exact = since is not None and at - since == step
            why = "inexact" if not exact else "unknown" if x is None else "captured"
            state = (at, at, x, total, False) if why == "captured" else (at, None, None, total, False)
        elif not over and until == at:
            why, out = "used", held
            total += held * step
            state = (at, None, None, total, False)
        elif not over:
            state, why = (at, until, held, total, False), "none"
        return state, [(None if at is None else int(at), i, why, out, total)]

    kept = "last long, until long, held double, total double, over boolean"
    out = f"{key} long, t long, id long, why string, value double, total double"
    # Clocks go by as strings, for a column with a null would pass through floats on its way.
    whole = [F.col(c).cast("string").alias(f"_{c}_") for c in (t, start)]
    named = df.select(key, order, *whole, kind, value)
    read = lambda now, i, j, at, since, k, x: advance(now, i, j, None if at is None else int(at), None if since is None else int(since), k, x)
    return _in_order(named, key, order, order, [f"_{t}_", f"_{start}_", kind, value], kept, out, read)


def closed(stream: DataFrame, tag: str) -> DataFrame:
    """Runs a stream over all data that is there into a table of its own, checks its count batch by batch, and reads it; without data it is empty."""
    return run_into(stream, scratch(stream.sparkSession, tag))["rows"]
