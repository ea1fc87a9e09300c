"""Progress of episodes: bins, milestones, population summaries, reviews of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.numbers import ratio
from tidewater.operators.clock import in_order


def bin_of(progress: Column, edges: list[float]) -> Column:
    """The bin of a progress value; the last bin holds its upper edge."""
    case = None
    for i in range(len(edges) - 1):
        hit = (progress >= edges[i]) & (progress < edges[i + 1]) if i < len(edges) - 2 else (progress >= edges[i]) & (progress <= edges[i + 1])
        case = F.when(hit, i) if case is None else case.when(hit, i)
    return case


def progress_bins(df: DataFrame, key: list[str], t: str, tie: str, progress: str, gap: str, signal: str, edges: list[float]) -> DataFrame:
    """Each episode's bins: samples, visits, observed time, progress made, and the signal's weighted mean and peak.

    A step belongs to the bin of its first sample; ``gap`` marks rows whose step
    to the next one is unknown, and such steps count nowhere.
    """
    w = in_order(key, t, tie)
    p = F.col(progress)
    d = df.withColumn("bin", bin_of(p, edges))
    fresh = F.lag("bin").over(w).isNull() | (F.lag("bin").over(w) != F.col("bin")) | F.lag(gap).over(w)
    dt = F.when(~F.col(gap), F.lead(t).over(w) - F.col(t))
    d = d.withColumn("_v", fresh.cast("int")).withColumn("_dt", dt).withColumn("_dp", F.when(F.col("_dt").isNotNull(), F.lead(progress).over(w) - p))
    x, y = F.col(signal), F.col("_dt")
    known = F.sum(F.when(x.isNotNull(), y))
    return d.where(F.col("bin").isNotNull()).groupBy(*key, "bin").agg(
        F.count("*").alias("samples"), F.sum("_v").alias("visits"), F.min(t).alias("first"), F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("observed"),
        F.sum("_dp").alias("delta"), ratio(F.sum(x * y), known).alias("mean"), F.max(x).alias("peak"),
    )


def population(bins: DataFrame, group: list[str], value: str) -> DataFrame:
    """Bins over episodes, each episode with equal weight: episodes, known, mean and median of the value."""
    return bins.groupBy(*group, "bin").agg(
        F.count("*").alias("episodes"), F.count(value).alias("known"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median")
    )


def key_frames(df: DataFrame, key: list[str], t: str, tie: str, channel: str, v: str, budget: int) -> DataFrame:
    """At most ``budget`` rows of a key to show: both ends, each channel's peak, then evenly spread ones.

    Mandatory rows come first by rank, so the budget cuts the spread only (or
    later channels, if there are more of them than budget).
    """
    whole = Window.partitionBy(*key)
    d = df.withColumn("_i", F.row_number().over(in_order(key, t, tie))).withColumn("_n", F.count("*").over(whole))
    peak = F.row_number().over(Window.partitionBy(*key, channel).orderBy(F.col(v).desc_nulls_last(), t, tie))
    d = d.withColumn("_peak", (peak == 1) & F.col(v).isNotNull())
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / budget))
    rank = F.when((F.col("_i") == 1) | (F.col("_i") == F.col("_n")), 0).when(F.col("_peak"), 1).when(F.col("_i") % step == 0, 2)
    d = d.withColumn("_r", rank).where(F.col("_r").isNotNull())
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_r", F.col("_i")))
    why = F.when(F.col("_r") == 0, "end").when(F.col("_r") == 1, "peak").otherwise("spread")
    return d.withColumn("_k", place).where(F.col("_k") <= budget).withColumn("why", why).drop("_i", "_n", "_peak", "_r", "_k")


def ranked_events(events: DataFrame, key: list[str], start: str, end: str, most: int = 3) -> DataFrame:
    """Adds rank by duration (ties by start) and preview for the first ``most``."""
    w = Window.partitionBy(*key).orderBy(F.desc(F.col(end) - F.col(start)), start, end)
    return events.withColumn("rank", F.row_number().over(w)).withColumn("preview", F.col("rank") <= most)


def decimated(df: DataFrame, key: list[str], t: str, v: str, width: int) -> DataFrame:
    """For each cell of ``width`` the rows with the least and the greatest value, for plots: cell, low, low_t, high, high_t, unknown."""
    cell = F.floor(F.col(t) / width).cast("long").alias("cell")
    known = F.col(v).isNotNull()
    low, high = F.min(F.when(known, F.struct(v, t))), F.max(F.when(known, F.struct(F.col(v), (-F.col(t)).alias("n"))))
    d = df.groupBy(*key, cell).agg(low.alias("_l"), high.alias("_h"), F.count_if(~known).alias("unknown"))
    return d.select(
        *key, "cell", F.col(f"_l.{v}").alias("low"), F.col(f"_l.{t}").alias("low_t"), F.col(f"_h.{v}").alias("high"), (-F.col("_h.n")).alias("high_t"), "unknown"
    )


def path_length(df: DataFrame, key: list[str], order: list[str], position: list[str]) -> DataFrame:
    """Length of each key's known steps, and the distance of its ends, which is null if a position is unknown: path, net."""
    w = in_order(key, *order)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in position), F.lit(0.0)))
    whole = [F.col(c).isNotNull() for c in position]
    known = whole[0]
    for k in whole[1:]:
        known = known & k
    at = F.struct(*order, *position)
    d = df.withColumn("_s", step).groupBy(*key).agg(F.sum("_s").alias("path"), F.bool_and(known).alias("_k"), F.min(at).alias("_a"), F.max(at).alias("_b"))
    net = F.sqrt(sum(((F.col(f"_b.{c}") - F.col(f"_a.{c}")) ** 2 for c in position), F.lit(0.0)))
    return d.select(*key, F.coalesce("path", F.lit(0.0)).alias("path"), F.when(F.col("_k"), net).alias("net"))
