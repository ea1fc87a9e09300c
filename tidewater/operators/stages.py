"""Ordered stage programs over nullable measurements.

A stage is reached at the first row at which all of its holds have lasted long
enough and every stage before it has been reached (at that very row, too). A hold
is a three-valued condition with a time: only known truth keeps its timer running,
and a gap of the clock restarts it. Everything shares one (key, t, tie) order, so a
key is shuffled and sorted once however many stages there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.clock import in_order
from tidewater.operators.segments import hold_timer

#: Default stage thresholds in SI units (fixed values).
THRESHOLDS = {
    "lift_m": 0.02, "near_mouth_m": 0.05, "grasp_hold_s": 0.15, "finger_load_n": 0.025, "opposition_cosine": 0.50,
    "near_hold_s": 0.15, "seating_hold_s": 0.20, "clear_hold_s": 0.10, "extracted_hold_s": 2.0, "placement_hold_s": 0.05,
    "release_hold_s": 0.20, "table_support_n": 0.01, "release_speed_m_s": 0.02, "release_speed_rad_s": 0.20,
    "drag_m": 0.02, "drag_hold_s": 0.05, "drag_clearance_m": 0.005, "transport_m": 0.02, "terminal_hold_s": 3.0,
    "terminal_error_m": 0.03, "terminal_cosine": 0.80, "terminal_speed_m_s": 0.02, "terminal_speed_rad_s": 0.20, "gap_steps": 1.5,
}


@dataclass(frozen=True)
class Hold:
    """A condition and how long it must have held.

    ``condition`` gets the flag "the stage before has been reached by this row".
    ``strict`` asks for more than ``least``; with ``ever`` it is enough that the
    hold was complete at this row or an earlier one, gaps or not.
    """

    condition: Callable[[Column], Column]
    least: int
    strict: bool = False
    ever: bool = False


@dataclass(frozen=True)
class Stage:
    """A named stage and the holds that reach it."""

    name: str
    holds: tuple[Hold, ...]


def checked_thresholds(**changed: float) -> dict[str, float]:
    """The thresholds with some changed; all must be finite and positive, cosines at most 1."""
    unknown = set(changed) - set(THRESHOLDS)
    if unknown:
        raise ValueError(f"unknown thresholds: {sorted(unknown)}")
    out = {**THRESHOLDS, **changed}
    for name, x in out.items():
        if not 0 < x < float("inf") or ("cosine" in name and x > 1):
            raise ValueError(f"{name} is out of range: {x}")
    return out


def gaps(df: DataFrame, key: list[str], t: str, tie: str, limit: Column, out: str = "late") -> DataFrame:
    """Adds whether the step to this row is longer than ``limit``."""
    return df.withColumn(out, F.coalesce(F.col(t) - F.lag(t).over(in_order(key, t, tie)) > limit, F.lit(False)))


def run_stages(df: DataFrame, key: list[str], t: str, tie: str, late: str, stages: list[Stage]) -> DataFrame:
    """Every row with _p (its place in the key) and for each stage i the place _f{i} at which it was reached, or null."""
    w, whole = in_order(key, t, tie), Window.partitionBy(*key)
    d = df.withColumn("_p", F.row_number().over(w))
    for i, stage in enumerate(stages):
        reached = F.coalesce(F.col("_p") >= F.col(f"_f{i - 1}"), F.lit(False)) if i else F.lit(True)
        done = []
        for j, hold in enumerate(stage.holds):
            name = f"_h{i}_{j}"
            d = hold_timer(d, key, [t, tie], t, hold.condition(reached), F.col(late), name)
            full = F.col(name) > hold.least if hold.strict else F.col(name) >= hold.least
            full = F.coalesce(full, F.lit(False))
            if hold.ever:
                d = d.withColumn(name, F.max(full).over(w))
                full = F.col(name)
            done.append(full)
        met = reduce(lambda a, b: a & b, done, reached)
        d = d.withColumn(f"_f{i}", F.min(F.when(met, F.col("_p"))).over(whole))
        d = d.drop(*[f"_h{i}_{j}" for j in range(len(stage.holds))])
    return d


def stage_report(df: DataFrame, key: list[str], t: str, tie: str, late: str, stages: list[Stage]) -> DataFrame:
    """One row for each key: first time of every stage, highest_stage, success, failure_stage, samples, gaps."""
    d = run_stages(df, key, t, tie, late, stages)
    first = [F.min(F.when(F.col("_p") == F.col(f"_f{i}"), F.col(t))).alias(s.name) for i, s in enumerate(stages)]
    out = d.groupBy(*key).agg(*first, F.count("*").alias("samples"), F.count_if(late).alias("gaps"))
    highest = sum((F.col(s.name).isNotNull().cast("int") for s in stages), F.lit(0))
    failure = F.coalesce(*[F.when(F.col(s.name).isNull(), F.lit(s.name)) for s in stages])
    return out.select(
        *key, *[s.name for s in stages], highest.alias("highest_stage"), F.col(stages[-1].name).isNotNull().alias("success"),
        failure.alias("failure_stage"), "samples", "gaps",
    )


def transported(
    df: DataFrame, key: list[str], t: str, tie: str, late: str, carried: Column, position: list[str], hold: int, least: float
) -> DataFrame:
    """Adds moved: whether, at this row or before, the object was carried ``least`` away from where a hold became stable.

    Each stretch of carrying has its own origin: the position at the first row at
    which it has lasted ``hold``. Nulls and gaps end a stretch; what was verified
    stays verified.
    """
    w = in_order(key, t, tie)
    d = hold_timer(df, key, [t, tie], t, carried, F.col(late), "_carry")
    brk = F.when(F.col("_carry").isNull() | (F.col("_carry") == 0), 1).otherwise(0)
    d = d.withColumn("_stretch", F.sum(brk).over(w))
    here = F.struct(*position)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in position])
    ready = known & (F.col("_carry") >= hold)
    d = d.withColumn("_origin", F.first(F.when(ready, here), ignorenulls=True).over(in_order([*key, "_stretch"], t, tie)))
    far = F.sqrt(sum(((F.col(c) - F.col(f"_origin.{c}")) ** 2 for c in position), F.lit(0.0)))
    ok = F.coalesce(ready & (far >= least), F.lit(False))
    return d.withColumn("moved", F.max(ok).over(w)).drop("_carry", "_stretch", "_origin")


def phase_program(
    df: DataFrame, key: list[str], t: str, tie: str, late: str, phases: list[tuple], terminal: str, failure: str | Callable[[Column], Column]
) -> DataFrame:
    """The verdict of a declarative phase program: (name, condition column, dwell) in order, and perhaps a timer of its own.

    Unlike stages, phases are searched one after another: a phase's dwell starts
    only behind the row that completed the one before. It succeeds if all phases
    complete, the last row's ``terminal`` condition is known to be true and no row
    has ``failure``: a column, which counts until all phases are complete, or a
    function of the number of phases that rows before have completed. A timer adds
    _held to the rows, given them and the live condition; else a plain hold counts.
    Gives key, the phases' times, completed, observed_failure and verdict.
    """
    w, whole = in_order(key, t, tie), Window.partitionBy(*key)
    d = df.withColumn("_p", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole)).withColumn("_done", F.lit(0))
    for i, (_, condition, dwell, *timer) in enumerate(phases):
        live = F.col(condition) & F.coalesce(F.col("_p") > F.col("_done"), F.lit(False))
        d = timer[0](d, live) if timer else hold_timer(d, key, [t, tie], t, live, F.col(late), "_held")
        d = d.withColumn("_done", F.min(F.when(F.col("_held") >= dwell, F.col("_p"))).over(whole)).withColumn(f"_e{i}", F.col("_done")).drop("_held")
    last = F.max(F.when(F.col("_p") == F.col("_n"), F.coalesce(F.col(terminal), F.lit(False))))
    if callable(failure):
        acquired = sum((F.coalesce(F.col(f"_e{i}") < F.col("_p"), F.lit(False)).cast("int") for i in range(len(phases))), F.lit(0))
        wrong = failure(acquired)
    else:
        wrong = F.col(failure) & (F.col("_done").isNull() | (F.col("_p") <= F.col("_done")))
    d = d.withColumn("_wrong", F.coalesce(wrong, F.lit(False)))
    times = [F.min(F.when(F.col("_p") == F.col(f"_e{i}"), F.col(t))).alias(n) for i, (n, *_) in enumerate(phases)]
    out = d.groupBy(*key).agg(*times, last.alias("_last"), F.max("_wrong").alias("observed_failure"))
    completed = sum((F.col(n).isNotNull().cast("int") for n, *_ in phases), F.lit(0))
    return out.select(
        *key, *[n for n, *_ in phases], completed.alias("completed"), "observed_failure",
        (F.col(phases[-1][0]).isNotNull() & F.col("_last") & ~F.col("observed_failure")).alias("verdict"),
    )
