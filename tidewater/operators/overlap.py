"""Interval joins: bins, clips, unions, gap propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.numbers import steps


def overlap_bins(df: DataFrame, start: str, end: str, width: int, origin: str | None = None) -> DataFrame:
    """Each interval once for every bin it overlaps: adds bin and overlap (exact, above 0)."""
    base = F.col(origin) if origin else F.lit(0)
    lo = F.floor((F.col(start) - base) / width).cast("long")
    hi = F.floor((F.col(end) - base - 1) / width).cast("long")
    out = df.where(F.col(end) > F.col(start)).withColumn("bin", F.explode(steps(lo, hi)))
    a, b = F.col("bin") * width + base, (F.col("bin") + 1) * width + base
    return out.withColumn("overlap", F.least(F.col(end), b) - F.greatest(F.col(start), a))


def clipped(df: DataFrame, windows: DataFrame, key: list[str], start: str, end: str, lo: str, hi: str) -> DataFrame:
    """Intervals joined to windows of their key, with the overlap of both (0 rows where there is none)."""
    both = F.least(F.col(end), F.col(hi)) - F.greatest(F.col(start), F.col(lo))
    return df.join(windows, key).withColumn("overlap", F.greatest(both, F.lit(0))).where(F.col("overlap") > 0)


def union_length(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """The length that a key's intervals cover together: key, covered."""
    before = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_reach", F.max(end).over(before))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("_reach"), F.col(start))))
    return d.groupBy(*key).agg(F.sum(fresh).cast("long").alias("covered"))


def gaps_touched(target: DataFrame, gaps: DataFrame, key: list[str], start: str, end: str, width: int) -> DataFrame:
    """Adds touched: whether a target interval overlaps a gap of its key.

    Both sides meet in bins of ``width``, so the join has an equality to hash on.
    """
    a = overlap_bins(target.withColumn("_id", F.monotonically_increasing_id()), start, end, width)
    b = overlap_bins(gaps.select(*key, F.col(start).alias("_gs"), F.col(end).alias("_ge")), "_gs", "_ge", width)
    b = b.select(*key, "bin", "_gs", "_ge")
    hit = (F.col("_gs") < F.col(end)) & (F.col("_ge") > F.col(start))
    names = target.columns
    joined = a.join(b, [*key, "bin"], "left").groupBy("_id", *names).agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("touched"))
    return joined.drop("_id")


def complete_bin_changes(df: DataFrame, key: list[str], start: str, end: str, value: str, width: int, lag: int) -> DataFrame:
    """Absolute changes of bin means over ``lag`` bins, where all bins on the way are complete.

    Bins count from each key's first start; a bin is complete if known values cover
    it wholly. Gives key, bin, mean and change.
    """
    first = df.groupBy(*key).agg(F.min(start).alias("_o"), F.max(end).alias("_e"))
    binned = overlap_bins(df.where(F.col(value).isNotNull()).join(first, key), start, end, width, "_o")
    means = binned.groupBy(*key, "bin").agg(
        F.sum("overlap").alias("_cover"), (F.sum(F.col(value) * F.col("overlap")) / F.sum("overlap")).alias("mean")
    )
    dense = first.where(F.col("_e") > F.col("_o")).select(
        *key, F.explode(steps(F.lit(0).cast("long"), F.floor((F.col("_e") - F.col("_o") - 1) / width).cast("long"))).alias("bin")
    )
    w = Window.partitionBy(*key).orderBy("bin")
    span = w.rowsBetween(0, lag)
    d = dense.join(means, [*key, "bin"], "left").withColumn("_bad", F.coalesce(F.col("_cover") < width, F.lit(True)).cast("int"))
    d = d.withColumn("_n", F.count("*").over(span)).withColumn("_bad", F.sum("_bad").over(span)).withColumn("_to", F.lead("mean", lag).over(w))
    return d.where((F.col("_bad") == 0) & (F.col("_n") == lag + 1)).select(*key, "bin", "mean", F.abs(F.col("_to") - F.col("mean")).alias("change"))
