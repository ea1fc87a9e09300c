"""Sets of half-open intervals by key, and their algebra: one union, one shuffle by key and one sort, no join.

A set is a DataFrame with a key, a start and an end. Its intervals may overlap,
touch and repeat; those that are empty, reversed or lack an end count for nothing.
Results are in normal form: sorted, apart, and as long as they can be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.numbers import ratio


def _sides(df: DataFrame, key: list[str], start: str, end: str, side: int) -> DataFrame:
    """Both ends of every interval as steps of a side's depth."""
    up, down = (F.struct(F.col(c).alias("_at"), *[F.lit(x if i == side else 0).alias(f"_d{i}") for i in (0, 1)]) for c, x in ((start, 1), (end, -1)))
    return df.where(F.col(start) < F.col(end)).select(*key, F.explode(F.array(up, down)).alias("_e")).select(*key, "_e.*")


def combined(a: DataFrame, b: DataFrame, key: list[str], start: str, end: str, rule: Callable[[Column, Column], Column]) -> DataFrame:
    """Where ``rule`` of (inside a, inside b) holds: key, start, end. It must not hold outside of both."""
    steps = _sides(a, key, start, end, 0).unionByName(_sides(b, key, start, end, 1))
    w = Window.partitionBy(*key).orderBy("_at")
    # The default frame ends with the last row of the same time, so all steps of one time count at once.
    depth = steps.withColumn("_in", rule(F.sum("_d0").over(w) > 0, F.sum("_d1").over(w) > 0))
    turn = depth.withColumn("_turn", F.col("_in") != F.coalesce(F.lag("_in").over(w), F.lit(False))).where("_turn")
    ends = turn.withColumn("_to", F.lead("_at").over(w))
    return ends.where("_in").select(*key, F.col("_at").alias(start), F.col("_to").alias(end))


def merged(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """A set in normal form."""
    return combined(df, df.limit(0), key, start, end, lambda a, _: a)


def united(a: DataFrame, b: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    return combined(a, b, key, start, end, lambda x, y: x | y)


def intersected(a: DataFrame, b: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """What both hold. With one window for each key as ``b``, the set clipped to it."""
    return combined(a, b, key, start, end, lambda x, y: x & y)


def subtracted(a: DataFrame, b: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """What a holds and b does not. With the records' extents as ``a``, the complement of b."""
    return combined(a, b, key, start, end, lambda x, y: x & ~y)


def _supported(df: DataFrame, key: list[str], t: str, order: list[str], factor: float) -> DataFrame:
    """Adds _p (place), _bad (the key's clock lacks a time or does not rise), _dur and _ok (a step beyond 0 and no gap)."""
    w, whole = Window.partitionBy(*key).orderBy(*order), Window.partitionBy(*key)
    d = df.withColumn("_p", F.row_number().over(w)).withColumn("_dur", F.lead(t).over(w) - F.col(t))
    d = d.withColumn("_bad", F.bool_or(F.col(t).isNull() | F.coalesce(F.col("_dur") <= 0, F.lit(False))).over(whole))
    limit = factor * F.percentile("_dur", F.lit(0.5)).over(whole)
    return d.withColumn("_ok", ~F.col("_bad") & F.coalesce(F.col("_dur") <= limit, F.lit(False)))


def predicate_scopes(df: DataFrame, key: list[str], t: str, order: list[str], predicates: dict[str, Column], factor: float = 1.5) -> DataFrame:
    """Intervals over which sampled predicates hold: key, name, start, end, samples, place (from 1 by name).

    A sample holds until the next one. An unknown or false sample, a gap beyond
    ``factor`` median steps and the last sample end an interval; a clock that lacks
    a time or does not rise has none.
    """
    d = _supported(df.withColumns({f"_c{i}": c for i, c in enumerate(predicates.values())}), key, t, order, factor).where("_ok")
    names = F.array_compact(F.array(*[F.when(F.col(f"_c{i}"), F.lit(n)) for i, n in enumerate(predicates)]))
    each = d.select(*key, "_p", F.col(t).alias("_t"), "_dur", F.explode(names).alias("name"))
    w = Window.partitionBy(*key, "name")
    runs = each.withColumn("_run", F.col("_p") - F.row_number().over(w.orderBy("_p")))
    out = runs.groupBy(*key, "name", "_run").agg(F.min("_t").alias("start"), F.max(F.col("_t") + F.col("_dur")).alias("end"), F.count("*").alias("samples"))
    return out.withColumn("place", F.row_number().over(w.orderBy("start"))).drop("_run")


def predicate_availability(df: DataFrame, key: list[str], t: str, order: list[str], predicates: dict[str, Column], factor: float = 1.5) -> DataFrame:
    """What the samples of each key tell of each predicate: one row for each (key, name).

    status is observed, not_observed (known, never true) or missing; ``known_time``
    and ``observed_time`` are over steps that are no gaps; ``coverage`` is the known
    share of the span; ``full`` says that all samples are known and all time is
    covered. A clock that lacks a time or does not rise makes everything unknown.
    """
    d = _supported(df.withColumns({f"_c{i}": c for i, c in enumerate(predicates.values())}), key, t, order, factor)
    good = ~F.col("_bad")

    def told(i: int, name: str) -> Column:
        c = F.col(f"_c{i}")
        time = lambda when: F.coalesce(F.sum(F.when(F.col("_ok") & when, F.col("_dur"))), F.lit(0)).alias
        return F.struct(
            F.lit(name).alias("name"), F.count(F.when(good, c)).alias("known"), F.count_if(good & F.coalesce(c, F.lit(False))).alias("positive"),
            time(c.isNotNull())("known_time"), time(c)("observed_time"),
        )

    out = d.groupBy(*key).agg(
        F.count("*").alias("samples"), F.bool_or("_bad").alias("_bad"), (F.max(t) - F.min(t)).alias("_span"), F.array(*[told(i, n) for i, n in enumerate(predicates)]).alias("_a")
    )
    out = out.withColumn("span", F.when(~F.col("_bad") & (F.col("samples") > 1), F.col("_span"))).select(*key, "samples", "span", "_bad", F.explode("_a").alias("_r"))
    out = out.select(*key, "_r.name", "samples", "_r.known", "_r.positive", "_r.known_time", "_r.observed_time", "span", "_bad")
    return out.select(
        *[c for c in out.columns if c != "_bad"],
        ratio(F.col("known_time").cast("double"), F.col("span")).alias("coverage"),
        ((F.col("known") == F.col("samples")) & F.coalesce(F.col("known_time") == F.col("span"), F.lit(False))).alias("full"),
        F.when(F.col("positive") > 0, "observed").when(F.col("known") > 0, "not_observed").otherwise("missing").alias("status"),
        F.when(F.col("_bad"), "clock").when(F.col("known") == 0, "unknown").alias("reason"),
    )
