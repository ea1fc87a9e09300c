"""Checks of a released data set against its source, without making the windows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.audits import quick_fingerprint

#: A prime below 2^31: products of two remainders fit a long.
PRIME = 2**31 - 1


def _print(action: Column) -> Column:
    """An action's remainder of its hash; missing numbers count by their place."""
    return F.pmod(F.xxhash64(F.transform(action, lambda x: F.struct(x.isNull(), x))), F.lit(PRIME)).cast("long")


def source_prints(source: DataFrame, key: list[str], frame: str, action: str, horizon: int) -> DataFrame:
    """What each frame's window must come to: key, frame, _sum and _weighted (by place in the window).

    A window holds the actions of the frame and those behind it, ``horizon`` in all, the last
    action repeated beyond the episode's end. Both numbers are differences of running
    sums, so a row costs the same whatever the horizon is.
    """
    w, whole = Window.partitionBy(*key).orderBy(frame), Window.partitionBy(*key)
    place = F.col("_i")
    d = source.select(*key, frame, _print(F.col(action)).alias("_h"))
    d = d.withColumn("_i", (F.row_number().over(w) - 1).cast("long")).withColumn("_n", F.count("*").over(whole)).withColumn("_w", F.pmod(place * F.col("_h"), F.lit(PRIME)))
    d = d.withColumn("_c", F.sum("_h").over(w)).withColumn("_t", F.sum("_w").over(w))
    last = F.max(F.struct("_i", "_h", "_c", "_t")).over(whole)
    d = d.withColumn("_last", last)
    to = lambda c: F.coalesce(F.lead(c, horizon - 1).over(w), F.col(f"_last.{c}"))
    d = d.withColumn("_real", F.least(F.lit(horizon), F.col("_n") - place)).withColumn("_ec", to("_c")).withColumn("_et", to("_t"))
    inner = F.col("_ec") - F.col("_c") + F.col("_h")
    weighted = F.col("_et") - F.col("_t") + F.col("_w") - place * F.pmod(inner, F.lit(PRIME))
    more, h = F.lit(horizon) - F.col("_real"), F.col("_last._h")
    places = F.lit(horizon * (horizon - 1) // 2) - F.shiftright(F.col("_real") * (F.col("_real") - 1), 1)
    return d.select(
        *key, frame, (inner + more * h).alias("_sum"),
        F.pmod(F.pmod(weighted, F.lit(PRIME)) + F.pmod(h * F.pmod(places, F.lit(PRIME)), F.lit(PRIME)), F.lit(PRIME)).alias("_weighted"),
    )


def released_prints(release: DataFrame, key: list[str], frame: str, window: str, horizon: int) -> DataFrame:
    """What each released window comes to, with _fits (its length): two numbers leave a row, not its window."""
    prints = F.transform(F.col(window), _print)
    total = F.aggregate(prints, F.lit(0).cast("long"), lambda s, x: s + x)
    weighted = F.aggregate(F.transform(prints, lambda x, i: F.pmod(i * x, F.lit(PRIME))), F.lit(0).cast("long"), lambda s, x: s + x)
    fits = F.coalesce(F.size(window) == horizon, F.lit(False))
    return release.select(*key, frame, fits.alias("_fits"), total.alias("_sum"), F.pmod(weighted, F.lit(PRIME)).alias("_weighted"))


def checked_windows(release: DataFrame, source: DataFrame, key: list[str], frame: str, window: str, action: str, horizon: int) -> DataFrame:
    """Every window of every episode, proved against the source: one row for each episode.

    frames (of the source), windows (rows of the release), missing, foreign (a frame that the
    source lacks), repeated, unfit (another length), changed (other actions, or in
    another order), first_bad (the least frame with any of these) and ok. Windows are
    compared through two remainders of 31 bits; none is rebuilt, none is shuffled.
    """
    got = released_prints(release, key, frame, window, horizon).groupBy(*key, frame).agg(
        F.count("*").alias("_rows"), F.bool_and("_fits").alias("_fits"), F.min(F.struct("_sum", "_weighted")).alias("_lo"), F.max(F.struct("_sum", "_weighted")).alias("_hi")
    )
    want = source_prints(source, key, frame, action, horizon).select(*key, frame, F.struct("_sum", "_weighted").alias("_want"))
    d = want.join(got, [*key, frame], "full")
    here, there = F.col("_want").isNotNull(), F.col("_rows").isNotNull()
    faults = {
        "missing": here & ~there, "foreign": ~here, "repeated": there & (F.col("_rows") > 1), "unfit": here & there & ~F.col("_fits"),
        "changed": here & there & F.col("_fits") & ((F.col("_lo") != F.col("_want")) | (F.col("_hi") != F.col("_want"))),
    }
    d = d.withColumns({f"_{n}": F.coalesce(c, F.lit(False)) for n, c in faults.items()})
    bad = F.greatest(*[F.col(f"_{n}") for n in faults])
    out = d.groupBy(*key).agg(
        F.count_if(here).alias("frames"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("windows"), *[F.count_if(F.col(f"_{n}")).alias(n) for n in faults], F.min(F.when(bad, F.col(frame))).alias("first_bad")
    )
    return out.withColumn("ok", F.col("first_bad").isNull())


def bound(source: DataFrame, manifest: DataFrame, key: list[str], fields: list[Column]) -> DataFrame:
    """How a source's episodes stand to a manifest of :func:`quick_fingerprint`: key, binding (bound, changed, unlisted, absent)."""
    have = quick_fingerprint(source, key, fields).select(*key, F.struct("samples", "a", "b").alias("_have"))
    told = manifest.select(*key, F.struct("samples", "a", "b").alias("_told"))
    state = F.when(F.col("_told").isNull(), "unlisted").when(F.col("_have").isNull(), "absent").when(F.col("_have") == F.col("_told"), "bound").otherwise("changed")
    return have.join(told, key, "full").select(*key, state.alias("binding"))
