"""Weighted and robust statistics per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.numbers import availability, ratio


def weighted_quantiles(df: DataFrame, key: list[str], v: str, w: str, points: dict[str, float], ties: list[str]) -> DataFrame:
    """For each key the least value at which the running weight reaches each point of the total."""
    d = df.where(F.col(v).isNotNull() & (F.col(w) > 0))
    run = F.sum(w).over(Window.partitionBy(*key).orderBy(v, *ties))
    d = d.withColumn("_c", run).withColumn("_w", F.sum(w).over(Window.partitionBy(*key)))
    return d.groupBy(*key).agg(*[F.min(F.when(F.col("_c") >= F.col("_w") * q, F.col(v))).alias(n) for n, q in points.items()])


def weighted_stats(df: DataFrame, key: list[str], v: str, w: str, ties: list[str]) -> DataFrame:
    """Weighted mean, population std, p50 and p95 over rows of positive weight; peak over all known rows.

    Quantiles are marked by a running weight, so one sort of each key serves all.
    """
    d = df.where(F.col(v).isNotNull())
    d = d.withColumn("_c", F.sum(w).over(Window.partitionBy(*key).orderBy(v, *ties))).withColumn("_w", F.sum(w).over(Window.partitionBy(*key)))
    x, y = F.col(v), F.col(w).cast("double")
    mean = ratio(F.sum(x * y), F.sum(y))
    square = ratio(F.sum(x * x * y), F.sum(y))
    mark = lambda q: F.min(F.when((F.col(w) > 0) & (F.col("_c") >= F.col("_w") * q), x))
    return d.groupBy(*key).agg(
        F.count("*").alias("samples"), F.sum(w).cast("long").alias("weight"), mean.alias("mean"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.max(v).alias("peak"), mark(0.5).alias("p50"), mark(0.95).alias("p95"),
    )


def channel_stats(df: DataFrame, key: list[str], t: str, v: str, dur: str, on: float) -> DataFrame:
    """Load of each key: coverage, contact and exceedance, impulse, peak and its first time, availability."""
    known, d = F.col(v).isNotNull(), F.col(dur)
    contact = F.sum(F.when(F.col(v) > on, d).otherwise(0))
    held = F.sum(F.when(known, d).otherwise(0))
    out = df.groupBy(*key).agg(
        F.count("*").alias("total"), F.count(v).alias("valid"), ratio(held.cast("double"), F.sum(d)).alias("coverage"),
        contact.cast("long").alias("contact"), ratio(contact.cast("double"), held).alias("contact_share"),
        F.sum(F.col(v) * d).alias("impulse"), F.max(v).alias("peak"),
        F.max(F.when(known, F.struct(F.col(v), (-F.col(t)).alias("_n")))).alias("_p"),
        (F.stddev_pop(v) / F.when(F.avg(v) > 0, F.avg(v))).alias("cv"),
    )
    return out.withColumn("peak_time", -F.col("_p._n")).withColumn("status", availability(F.col("valid"), F.col("total"))).drop("_p")


def distribution(df: DataFrame, key: list[str], v: str) -> DataFrame:
    """Counts of all and of known values, mean, least, greatest, and exact linear quartiles."""
    p = F.percentile(v, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    out = df.groupBy(*key).agg(
        F.count("*").alias("total"), F.count(v).alias("known"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), p.alias("_p")
    )
    return out.select(*[c for c in out.columns if c != "_p"], *[F.col("_p")[i].alias(n) for i, n in enumerate(("p25", "median", "p75"))])


def percentile_scale(df: DataFrame, key: list[str], v: str, floor: float = 1.0) -> DataFrame:
    """The 99th percentile of absolute values, at least ``floor``."""
    return df.groupBy(*key).agg(F.greatest(F.lit(floor), F.percentile(F.abs(v), F.lit(0.99))).alias("scale"))


def agreement(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """How two streams agree: pairs, correlation (null where a side never varies), root mean square, mean absolute and mean difference."""
    d, x, y = F.col(a) - F.col(b), F.stddev_pop(a), F.stddev_pop(b)
    # F.corr divides by zero, which is an error, for a side that is constant over several pairs.
    corr = F.when((x > 0) & (y > 0), F.covar_pop(a, b) / x / y)
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*key).agg(
        F.count("*").alias("pairs"), corr.alias("corr"), F.sqrt(F.avg(d * d)).alias("rms"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias")
    )


def load_shares(df: DataFrame, group: list[str], part: str, v: str, w: str, parts: int, least: float) -> DataFrame:
    """Each part's mean share of the total load, by weight: part, weight, share.

    Only samples (``group``) count in which all ``parts`` are known and the total is above ``least``.
    """
    over = Window.partitionBy(*group)
    d = df.withColumn("_n", F.count(v).over(over)).withColumn("_t", F.sum(v).over(over)).where((F.col("_n") == parts) & (F.col("_t") > least))
    return d.groupBy(part).agg(F.sum(w).alias("weight"), ratio(F.sum(F.col(v) / F.col("_t") * F.col(w)), F.sum(w)).alias("share"))


def extremes(df: DataFrame, group: list[str], by: str, item: str) -> DataFrame:
    """The items with the least and the greatest ``by`` (ties to the smaller item)."""
    lo = F.min(F.struct(F.col(by), F.col(item))).alias("_lo")
    hi = F.max(F.struct(F.col(by), (-F.col(item)).alias(item))).alias("_hi")
    out = df.groupBy(*group).agg(lo, hi, F.count("*").alias("n"))
    return out.select(*group, "n", F.col(f"_lo.{item}").alias("argmin"), F.col(f"_lo.{by}").alias("min"), (-F.col(f"_hi.{item}")).alias("argmax"), F.col(f"_hi.{by}").alias("max"))


def adjacent_rms(df: DataFrame, key: list[str], order: list[str], v: str, mask: str) -> DataFrame:
    """Population std within the mask, and the root mean square of steps whose both ends are in it."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.withColumn("_s", F.when(F.col(mask) & F.lag(mask).over(w), F.col(v) - F.lag(v).over(w)))
    inside = F.when(F.col(mask), F.col(v))
    return d.groupBy(*key).agg(F.stddev_pop(inside).alias("std"), F.sqrt(F.avg(F.col("_s") * F.col("_s"))).alias("rms"))


def trapezoid(df: DataFrame, key: list[str], order: list[str], t: str, v: str) -> DataFrame:
    """Trapezoid integral over steps with both ends known: key, integral, steps."""
    w = Window.partitionBy(*key).orderBy(*order)
    area = 0.5 * (F.col(v) + F.lag(v).over(w)) * (F.col(t) - F.lag(t).over(w))
    d = df.withColumn("_a", area)
    return d.groupBy(*key).agg(F.sum("_a").alias("integral"), F.count("_a").alias("steps"))


def guard_events(df: DataFrame, key: list[str], t: str, measured: str, threshold: str) -> DataFrame:
    """Rolls threshold breaches up: first, last, count, extremes and the last measured value."""
    hit = df.where(F.col(measured) > F.col(threshold))
    return hit.groupBy(*key, threshold).agg(
        F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n"), F.min(measured).alias("least"),
        F.max(measured).alias("most"), F.max(F.struct(t, measured)).getField(measured).alias("latest"),
    )


def clip_counts(df: DataFrame, key: list[str], array: str, low: float, high: float) -> DataFrame:
    """For each array position: rows, values outside the limits, and the largest excess."""
    x = df.select(*key, F.posexplode(array).alias("pos", "_x"))
    over = F.greatest(F.col("_x") - high, F.lit(low) - F.col("_x"))
    return x.groupBy(*key, "pos").agg(F.count("*").alias("n"), F.count_if(over > 0).alias("clipped"), F.max(F.greatest(over, F.lit(0.0))).alias("excess"))


def tail_summary(df: DataFrame, key: list[str], order: list[str], t: str, v: str, tail: int) -> DataFrame:
    """The last ``tail`` of each record: time, mean by time and largest absolute value.

    A step counts with the value at its right end; the step across the tail's start counts as far as it lies inside.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.withColumn("_from", F.greatest(F.lag(t).over(w), F.max(t).over(Window.partitionBy(*key)) - tail))
    d = d.withColumn("_d", F.greatest(F.col(t) - F.col("_from"), F.lit(0))).withColumn("_known", F.when(F.col(v).isNotNull(), F.col("_d")))
    inside = F.when(F.col("_d") > 0, F.abs(v))
    return d.groupBy(*key).agg(F.sum("_d").alias("time"), ratio(F.sum(F.col(v) * F.col("_d")), F.sum("_known")).alias("mean"), F.max(inside).alias("most"))
