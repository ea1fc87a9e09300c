"""Clocks: left-hold durations, cadence, gaps and audits.

Clocks are whole microseconds. A sample holds until the next one; the last holds
for no time. Rows of one clock are in (key, t, tie) order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidewater.functions.numbers import steps


def in_order(key: list[str], *order: str) -> WindowSpec:
    """The window of one clock."""
    return Window.partitionBy(*key).orderBy(*order)


def left_hold(df: DataFrame, key: list[str], t: str, tie: str, out: str = "dur") -> DataFrame:
    """Adds the time until the next sample (0 for the last)."""
    w = in_order(key, t, tie)
    return df.withColumn(out, F.coalesce(F.lead(t).over(w) - F.col(t), F.lit(0).cast("long")))


def cadence(df: DataFrame, key: list[str], t: str, tie: str) -> DataFrame:
    """The median step of each clock: key columns, cadence (null with one sample)."""
    step = df.withColumn("_dt", F.col(t) - F.lag(t).over(in_order(key, t, tie)))
    return step.groupBy(*key).agg(F.percentile("_dt", F.lit(0.5)).alias("cadence"))


def gap_aware(df: DataFrame, key: list[str], t: str, tie: str, factor: float = 1.5, cap: bool = False) -> DataFrame:
    """Adds dur, gap and cadence: steps beyond ``factor`` cadences are gaps.

    A gap's duration is wholly unknown, thus 0; with ``cap`` it is the limit. All
    are windows over one partitioning, so the rows are shuffled once.
    """
    d = df.withColumn("_dt", F.col(t) - F.lag(t).over(in_order(key, t, tie)))
    d = d.withColumn("cadence", F.percentile("_dt", F.lit(0.5)).over(Window.partitionBy(*key))).drop("_dt")
    held = left_hold(d, key, t, tie)
    limit = F.col("cadence") * factor
    gap = F.coalesce(F.col("dur") > limit, F.lit(False))
    return held.withColumn("gap", gap).withColumn("dur", F.when(gap, limit if cap else 0).otherwise(F.col("dur")).cast("long"))


def clock_audit(df: DataFrame, key: list[str], t: str, order: str, factor: float = 1.5) -> DataFrame:
    """Of each clock in arrival order: duplicates, reversals, gaps, estimated missing samples."""
    step = df.withColumn("_dt", F.col(t) - F.lag(t).over(in_order(key, order)))
    typical = step.where(F.col("_dt") > 0).groupBy(*key).agg(F.percentile("_dt", F.lit(0.5)).alias("cadence"))
    gap = F.col("_dt") > F.col("cadence") * factor
    return (
        step.join(typical, key, "left")
        .groupBy(*key)
        .agg(
            F.count("*").alias("samples"),
            F.count_if(F.col("_dt") == 0).alias("duplicates"),
            F.count_if(F.col("_dt") < 0).alias("reversals"),
            F.count_if(gap).alias("gaps"),
            F.coalesce(F.sum(F.when(gap, F.round(F.col("_dt") / F.col("cadence")).cast("long") - 1)), F.lit(0)).alias("missing"),
        )
    )


def grid_difference(df: DataFrame, key: list[str], t: str, step: int) -> DataFrame:
    """Cells of a regular grid over each clock's extent without a sample: key, cell."""
    cells = df.select(*key, F.floor(F.col(t) / step).cast("long").alias("cell")).distinct()
    extent = cells.groupBy(*key).agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    expected = extent.select(*key, F.explode(steps(F.col("lo"), F.col("hi"))).alias("cell"))
    return expected.join(cells, [*key, "cell"], "left_anti")


def grid_samples(df: DataFrame, key: list[str], t: str, tie: str, step: int) -> DataFrame:
    """Samples nearest to a regular grid's points (ties to the earlier one), and both ends, once each."""
    point = F.floor((F.col(t) - F.col("_first") + step / 2) / step).cast("long")
    ends = Window.partitionBy(*key)
    d = df.withColumn("_first", F.min(t).over(ends)).withColumn("_last", F.max(t).over(ends)).withColumn("_point", point)
    off = F.abs(F.col(t) - F.col("_first") - F.col("_point") * step)
    near = F.row_number().over(Window.partitionBy(*key, "_point").orderBy(off, t, tie))
    kept = (near == 1) | (F.col(t) == F.col("_first")) | (F.col(t) == F.col("_last"))
    return d.withColumn("_keep", kept).where("_keep").drop("_first", "_last", "_point", "_keep")


def quantised(df: DataFrame, t: str, tick: int, out: str = "tick") -> DataFrame:
    """Adds the nearest physics tick of a clock."""
    return df.withColumn(out, F.rint(F.col(t) / tick).cast("long"))
