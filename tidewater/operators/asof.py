"""Temporal joins on whole-number clocks, by one union and window functions.

Both sides are unioned, sorted once within their key, and the last (or next) row of
the right side is carried along: a single shuffle, no inequality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, key: list[str], t: str, values: list[str], right_first: bool) -> DataFrame:
    """Left and right rows in one table; _r is the right side's struct (clock and values)."""
    r = F.struct(F.col(t).alias("rt"), *[F.col(v) for v in values])
    side = lambda n: F.lit(n if right_first else -n)
    a = left.select(*left.columns, side(1).alias("_side"), F.lit(True).alias("_left"))
    b = right.select(*key, t, r.alias("_r"), side(0).alias("_side"), F.lit(False).alias("_left"))
    return a.unionByName(b, allowMissingColumns=True)


def asof_backward(
    left: DataFrame, right: DataFrame, key: list[str], t: str, values: list[str], tolerance: int | None = None, tie: str | None = None
) -> DataFrame:
    """Each left row with the latest right row at or before it: rt, age and the right's values.

    Without such a row they are null; beyond ``tolerance`` rt and age stay but the
    values are null. Of right rows with one clock value the one with the greatest
    values (or ``tie``, one of them) counts.
    """
    both = _both(left, right, key, t, values, True)
    w = Window.partitionBy(*key).orderBy(t, "_side", F.col(f"_r.{tie}") if tie else F.col("_r"))
    held = both.withColumn("_held", F.last("_r", ignorenulls=True).over(w)).where("_left")
    age = F.col(t) - F.col("_held.rt")
    ok = F.lit(True) if tolerance is None else age <= tolerance
    return held.select(
        *left.columns, F.col("_held.rt").alias("rt"), age.alias("age"), *[F.when(ok, F.col(f"_held.{v}")).alias(v) for v in values]
    )


def bracket(left: DataFrame, right: DataFrame, key: list[str], t: str, values: list[str]) -> DataFrame:
    """Each left row with the right rows around it: prev (at or before) and next (at or after), structs or null."""
    back = _both(left, right, key, t, values, True)
    w = Window.partitionBy(*key).orderBy(t, "_side", "_r")
    ahead = Window.partitionBy(*key).orderBy(F.desc(t), F.col("_side"), F.desc("_r"))
    out = back.withColumn("prev", F.last("_r", ignorenulls=True).over(w)).withColumn("next", F.last("_r", ignorenulls=True).over(ahead))
    return out.where("_left").select(*left.columns, "prev", "next")


def asof_nearest(
    left: DataFrame, right: DataFrame, key: list[str], t: str, values: list[str], tolerance: int | None = None, later: bool = False
) -> DataFrame:
    """Each left row with the nearest right row, ties to the earlier (or ``later``) one; beyond ``tolerance`` there is none."""
    both = bracket(left, right, key, t, values)
    before, after = F.col(t) - F.col("prev.rt"), F.col("next.rt") - F.col(t)
    near = F.when(F.col("next").isNull() | ((before < after) if later else (before <= after)), F.col("prev")).otherwise(F.coalesce("next", "prev"))
    out = both.withColumn("_n", near)
    off = F.abs(F.col(t) - F.col("_n.rt"))
    ok = off <= tolerance if tolerance is not None else F.lit(True)
    pick = lambda c: F.when(ok, F.col(f"_n.{c}")).alias(c)
    return out.select(*left.columns, pick("rt"), *[pick(v) for v in values])


def interpolated(left: DataFrame, right: DataFrame, key: list[str], t: str, value: str) -> DataFrame:
    """Each left row with the right's value on the line between its neighbours; null outside their extent."""
    both = bracket(left, right, key, t, [value])
    span = F.col("next.rt") - F.col("prev.rt")
    part = F.when(span > 0, (F.col(t) - F.col("prev.rt")) / span).otherwise(0.0)
    line = F.col(f"prev.{value}") + (F.col(f"next.{value}") - F.col(f"prev.{value}")) * part
    return both.select(*left.columns, line.alias(value))


def exact_join(left: DataFrame, right: DataFrame, key: list[str], t: str) -> DataFrame:
    """Left outer join on equal clock values."""
    return left.join(right, [*key, t], "left")


def held_while_fresh(
    left: DataFrame, right: DataFrame, cadence: DataFrame, key: list[str], t: str, values: list[str], factor: float = 1.5
) -> DataFrame:
    """Backward as-of whose values expire after ``factor`` cadences of the right clock."""
    out = asof_backward(left, right, key, t, values).join(cadence, key, "left")
    ok = F.col("age") <= F.col("cadence") * factor
    return out.select(*left.columns, "rt", "age", *[F.when(ok, F.col(v)).alias(v) for v in values])


def lagged_pairs(df: DataFrame, key: list[str], t: str, value: str, lag: int, bad: Column) -> DataFrame:
    """Pairs at exactly ``lag`` apart with no ``bad`` row between: t, then, value, value_then."""
    w = Window.partitionBy(*key).orderBy(t)
    d = df.withColumn("_bad", F.sum(bad.cast("int")).over(w)).select(*key, t, value, "_bad")
    then = d.select(*key, (F.col(t) + lag).alias(t), F.col(t).alias("then"), F.col(value).alias("value_then"), F.col("_bad").alias("_b0"))
    return d.join(then, [*key, t]).where(F.col("_bad") == F.col("_b0")).drop("_bad", "_b0")
