"""Audits of raw recordings: streams of different rates under one table of rules.

A recording is one key with several streams: states at a fixed period, other
streams that should have a row for each state, frames of cameras at a rate of
their own. Each stream is a table; what its rows can be asked is prepared by
:func:`stepped`, :func:`lengths` and :func:`scheduled`, and :func:`findings` runs
all rules over all of them. A rule that is unknown for a row is broken: damaged
recordings fail. Nothing is repaired.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import logic
from tidewater.functions.numbers import steps
from tidewater.operators.clock import in_order

SECOND = 1_000_000


@dataclass(frozen=True)
class Rule:
    """What must hold for each row of a stream; a warning asks for a look and leaves the recording valid."""

    name: str
    stream: str
    holds: Column
    warning: bool = False


def finite(v: Column, size: int) -> Column:
    """Whether an array has ``size`` elements, all of them finite numbers; false for null."""
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: logic.known(x).isNotNull()), F.lit(False))


def unit_length(q: Column, tolerance: float = 1e-7) -> Column:
    """Whether a quaternion has length 1 within ``tolerance``; null where a number is missing."""
    square = F.aggregate(q, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return F.when(F.size(q) == 4, F.abs(F.sqrt(square) - 1) <= tolerance)


def stepped(states: DataFrame, key: list[str], row: str, t: str, position: str, velocity: str, unit: int = SECOND) -> DataFrame:
    """Adds step (time since the row before), residual and repeated; rows are in the order of ``row``.

    ``residual`` is the largest difference of any coordinate between its step and
    the row's own velocity times the step's time (in ``unit``). ``repeated`` says that
    position and velocity are the row before's although some velocity is not 0.
    All are null on a first row, and the residual where a number is missing.
    """
    w = in_order(key, row)
    before = F.lag(F.struct(F.col(t).alias("t"), F.col(position).alias("p"), F.col(velocity).alias("v"), F.lit(True).alias("is"))).over(w)
    d = states.withColumn("_b", before).withColumn("step", F.col(t) - F.col("_b.t"))
    off = F.zip_with(F.zip_with(F.col(position), F.col("_b.p"), lambda a, b: a - b), F.col(velocity), lambda s, v: F.abs(s - v * F.col("step") / unit))
    whole = (F.size(off) > 0) & F.forall(off, lambda x: logic.known(x).isNotNull())
    d = d.withColumn("residual", F.when(F.col("_b.is") & whole, F.array_max(off)))
    same = F.col(position).eqNullSafe(F.col("_b.p")) & F.col(velocity).eqNullSafe(F.col("_b.v"))
    moving = F.coalesce(F.exists(velocity, lambda v: v != 0), F.lit(False))
    return d.withColumn("repeated", F.when(F.col("_b.is"), same & moving)).drop("_b")


def lengths(states: DataFrame, others: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """The number of rows of each stream of each recording: key, stream, rows, expected (that of the states).

    A stream without any row is there with 0, and so is a recording without states.
    Streams are counted before they meet, so only counts are shuffled twice.
    """
    counts = [d.groupBy(*key).agg(F.count("*").alias("n")).withColumn("stream", F.lit(name)) for name, d in others.items()]
    counts.append(states.groupBy(*key).agg(F.count("*").alias("n")).withColumn("stream", F.lit(None).cast("string")))
    own = [F.coalesce(F.sum(F.when(F.col("stream") == name, F.col("n"))), F.lit(0)).cast("long").alias("rows") for name in others]
    d = reduce(DataFrame.unionByName, counts).groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.col("stream").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("expected"),
        F.array(*[F.struct(F.lit(name).alias("stream"), n) for name, n in zip(others, own, strict=True)]).alias("_s"),
    )
    return d.select(*key, "expected", F.explode("_s").alias("_s")).select(*key, "_s.stream", "_s.rows", "expected")


def deadlines(first: Column, last: Column, rate: int, period: int) -> Column:
    """Clock values at which a camera of ``rate`` frames a second should see states of one ``period``: the state nearest to each deadline (a tie to the later), and the last state."""
    ticks = (last - first) / period
    frames = F.floor((ticks + 0.5) * rate * period / SECOND).cast("long")
    # Whole numbers: floor(n * SECOND / (rate * period) + 1/2) without rounding.
    at = lambda n: first + F.floor((2 * SECOND * n + rate * period) / (2 * rate * period)).cast("long") * period
    regular = F.filter(F.transform(steps(F.lit(0).cast("long"), frames), at), lambda x: x <= last)
    return F.array_union(regular, F.array(last))


def scheduled(frames: DataFrame, states: DataFrame, key: list[str], camera: str, t: str, state_row: str, row: str, rates: dict[str, int], period: int) -> DataFrame:
    """Frames against the states that they should show: key, camera, t, due, seen, matched.

    One row for each camera and clock value that is due or has frames: ``due`` says
    whether a frame is expected, ``seen`` how many there are, ``matched`` whether
    every frame's clock is that of the state it names (null without frames). A camera
    without frames has rows with seen 0; one without a rate is never due. Recordings
    that have no states have no schedule.
    """
    named = states.select(*key, F.col(row).alias("_row"), F.col(t).alias("_t"))
    shown = frames.select(*key, camera, t, F.col(state_row).alias("_row")).join(named, [*key, "_row"], "left")
    right = F.coalesce(F.col("_t") == F.col(t), F.lit(False))
    have = shown.groupBy(*key, camera, t).agg(F.count("*").alias("seen"), F.bool_and(right).alias("matched"))
    extent = states.groupBy(*key).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    each = F.array(*[F.struct(F.lit(c).alias("c"), deadlines(F.col("_lo"), F.col("_hi"), rate, period).alias("at")) for c, rate in rates.items()])
    due = extent.select(*key, F.explode(each).alias("_e")).select(*key, F.col("_e.c").alias(camera), F.explode("_e.at").alias(t))
    d = due.withColumn("due", F.lit(True)).join(have, [*key, camera, t], "full")
    return d.select(*key, camera, t, F.coalesce("due", F.lit(False)).alias("due"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"), "matched")


def findings(streams: dict[str, tuple[DataFrame, Column]], key: list[str], rules: list[Rule], most: int = 24) -> DataFrame:
    """Broken rules: key, rule, warning, broken (rows) and first (the ``most`` smallest places, a report and so bounded).

    A stream is a table and the place of its rows, as a long. Each is read in one
    pass for all its rules and only broken rows are shuffled; ranks are cut before
    the shuffle, so a recording that breaks a rule in every row costs ``most`` rows a task.
    """
    unknown = sorted({r.stream for r in rules} - set(streams))
    if unknown or len({r.name for r in rules}) < len(rules):
        raise ValueError(f"rules need names of their own and streams that are there (not: {unknown})")
    parts = []
    for name, (d, place) in streams.items():
        own = [r for r in rules if r.stream == name]
        if own:
            failed = F.array(*[F.when(~logic.is_true(r.holds), F.struct(F.lit(r.name).alias("rule"), F.lit(r.warning).alias("warning"))) for r in own])
            rows = d.select(*key, place.cast("long").alias("place"), F.explode(F.array_compact(failed)).alias("_f"))
            parts.append(rows.select(*key, "place", "_f.rule", "_f.warning"))
    broken = reduce(DataFrame.unionByName, parts)
    each = [*key, "rule"]
    rank = F.row_number().over(Window.partitionBy(*each).orderBy("place"))
    few = broken.withColumn("_r", rank).where(F.col("_r") <= most).groupBy(*each).agg(F.array_sort(F.collect_list("place")).alias("first"))
    return broken.groupBy(*each, "warning").agg(F.count("*").alias("broken")).join(few, each, "left")


def verdicts(recordings: DataFrame, found: DataFrame, key: list[str], rules: list[Rule]) -> DataFrame:
    """One row for each recording: errors and warnings (names in the table's order), broken (rows), valid (no error), review (some warning)."""
    hit = {r.name: F.coalesce(F.max(F.col("rule") == r.name), F.lit(False)) for r in rules}
    told = found.groupBy(*key).agg(F.sum("broken").alias("_n"), *[c.alias(f"_{i}") for i, c in enumerate(hit.values())])
    d = recordings.select(*key).distinct().join(told, key, "left")
    named = lambda warning: F.array_compact(F.array(*[F.when(F.col(f"_{i}"), r.name) for i, r in enumerate(rules) if r.warning == warning]).cast("array<string>"))
    out = d.select(*key, named(False).alias("errors"), named(True).alias("warnings"), F.coalesce("_n", F.lit(0)).cast("long").alias("broken"))
    return out.withColumn("valid", F.size("errors") == 0).withColumn("review", F.size("warnings") > 0)


def peaks(df: DataFrame, key: list[str], row: str, t: str, values: list[str]) -> DataFrame:
    """The largest known value of each column and where it is first reached: key, metric, most, row, t."""
    rows = df.select(*key, F.col(row).alias("row"), F.col(t).alias("t"), F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), logic.known(F.col(v)).alias("x")) for v in values])).alias("m"))
    top = F.max(F.struct(F.col("m.x").alias("x"), (-F.col("row")).alias("r"), F.col("t").alias("t")))
    d = rows.where(F.col("m.x").isNotNull()).groupBy(*key, F.col("m.metric").alias("metric")).agg(top.alias("_m"))
    return d.select(*key, "metric", F.col("_m.x").alias("most"), (-F.col("_m.r")).alias("row"), F.col("_m.t").alias("t"))
