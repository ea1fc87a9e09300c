"""Exact order statistics of few, huge groups, without a task that holds a group.

Equal values are counted before any shuffle of rows. Each group's range is cut into
cells; running counts of the cells (a small table) say where a rank lies, and only
within a cell are values put in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.numbers import ratio

#: Cells of a group's range.
CELLS = 4096


def _celled(values: DataFrame, key: list[str], v: str, counts: list[str]) -> DataFrame:
    """Distinct values with counts: adds _cell and, for each count, _b_<count>, what lies in lower cells, and _t_<count>, the total."""
    range_ = values.groupBy(*key).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), *[F.sum(c).alias(f"_t_{c}") for c in counts])
    d = values.join(range_, key) if key else values.crossJoin(F.broadcast(range_))
    part = F.floor((F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS)
    d = d.withColumn("_cell", F.when(F.col("_hi") > F.col("_lo"), F.least(part, F.lit(CELLS - 1))).otherwise(0).cast("int")).drop("_lo", "_hi")
    cells = d.groupBy(*key, "_cell").agg(*[F.sum(c).alias(f"_n_{c}") for c in counts])
    w = Window.partitionBy(*key).orderBy("_cell")
    before = cells.select(*key, "_cell", *[(F.sum(f"_n_{c}").over(w) - F.col(f"_n_{c}")).alias(f"_b_{c}") for c in counts])
    return d.join(before, [*key, "_cell"])


def quantiles(df: DataFrame, key: list[str], v: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group with linear interpolation: key and one column for each named point."""
    values = df.where(F.col(v).isNotNull()).groupBy(*key, v).agg(F.count("*").alias("n"))
    d = _celled(values, key, v, ["n"])
    upto = F.col("_b_n") + F.sum("n").over(Window.partitionBy(*key, "_cell").orderBy(v))
    d = d.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("n"))
    place = lambda q: (F.col("_t_n") - 1) * F.lit(q)
    at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col(v)))
    sides = [x for n, q in points.items() for x in (at(F.floor(place(q))).alias(f"_{n}_lo"), at(F.ceil(place(q))).alias(f"_{n}_hi"))]
    out = d.groupBy(*key).agg(F.max("_t_n").alias("_t_n"), *sides)

    def line(n: str, q: float) -> Column:
        lo, hi, part = F.col(f"_{n}_lo"), F.col(f"_{n}_hi"), place(q) - F.floor(place(q))
        return (lo + (hi - lo) * part).alias(n)

    return out.select(*key, *[line(n, q) for n, q in points.items()])


def distribution(df: DataFrame, key: list[str], v: str) -> DataFrame:
    """As :func:`tidewater.operators.aggregates.distribution`, for few, huge groups (``key`` may be empty)."""
    out = df.groupBy(*key).agg(
        F.count("*").alias("total"), F.count(v).alias("known"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    parts = quantiles(df, key, v, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    # Without a key both sides are one row.
    return out.join(parts, key, "left") if key else out.crossJoin(F.broadcast(parts))


def median_mad(df: DataFrame, key: list[str], v: str) -> DataFrame:
    """Median and median absolute deviation."""
    middle = quantiles(df, key, v, {"median": 0.5})
    off = df.join(middle, key).withColumn("_off", F.abs(F.col(v) - F.col("median")))
    return middle.join(quantiles(off, key, "_off", {"mad": 0.5}), key)


def rank_interval(df: DataFrame, reference: DataFrame, key: list[str], v: str) -> DataFrame:
    """Adds the shares of the key's reference values below, and at or below, each value (null for null, and without reference values)."""
    asked = df.where(F.col(v).isNotNull()).groupBy(*key, v).agg(F.lit(0).cast("long").alias("n"))
    given = reference.where(F.col(v).isNotNull()).groupBy(*key, v).agg(F.count("*").alias("n"))
    both = reduce(DataFrame.unionByName, [asked, given]).groupBy(*key, v).agg(F.sum("n").alias("n"))
    d = _celled(both, key, v, ["n"])
    upto = F.col("_b_n") + F.sum("n").over(Window.partitionBy(*key, "_cell").orderBy(v))
    total = F.col("_t_n").cast("double")
    shares = d.withColumn("_upto", upto).select(*key, v, ratio(F.col("_upto") - F.col("n"), total).alias("below"), ratio(F.col("_upto"), total).alias("upto"))
    return df.join(shares, [*key, v], "left").select(*df.columns, "below", "upto")
