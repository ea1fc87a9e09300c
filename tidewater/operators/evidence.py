"""Contact quality: loads, interruptions, effects, safety, scopes, comparisons.

All verdicts are three-valued: pass, fail, or unknown where the evidence does not
decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import logic
from tidewater.functions.numbers import ratio, steps
from tidewater.operators.asof import asof_backward
from tidewater.operators.clock import in_order


def verdict(failed: Column, complete: Column) -> Column:
    """fail if a failure is known, else pass if the evidence is complete, else unknown."""
    return F.when(F.coalesce(failed, F.lit(False)), "fail").when(F.coalesce(complete, F.lit(False)), "pass").otherwise("unknown")


def load_report(df: DataFrame, key: list[str], v: str, dur: str, limit: float) -> DataFrame:
    """Time above a load limit and the impulse in excess of it: over, excess, known, status."""
    x, d = F.col(v), F.col(dur)
    out = df.groupBy(*key).agg(
        F.sum(F.when(x > limit, d).otherwise(0)).cast("long").alias("over"), F.sum(F.greatest(x - limit, F.lit(0.0)) * d).alias("excess"),
        F.sum(F.when(x.isNotNull(), d).otherwise(0)).cast("long").alias("known"), F.max(x > limit).alias("_f"), F.bool_and(x.isNotNull()).alias("_c"),
    )
    return out.withColumn("status", verdict(F.col("_f"), F.col("_c"))).drop("_f", "_c")


def interruptions(df: DataFrame, key: list[str], order: list[str], expected: str, contact: str, dur: str, allowed: int) -> DataFrame:
    """Contact while it is expected: expected, touching and unknown time, longest interruption, status.

    An interruption is a stretch of rows on which contact is expected and known to
    be absent; unknown rows end it and leave the verdict open unless it fails.
    """
    w = in_order(key, *order)
    want, touch = F.coalesce(F.col(expected), F.lit(False)), F.col(contact)
    broken = want & F.coalesce(~touch, F.lit(False))
    d = df.withColumn("_b", broken).withColumn("_i", F.sum((~broken).cast("int")).over(w))
    length = F.sum(F.when(F.col("_b"), F.col(dur)).otherwise(0)).over(Window.partitionBy(*key, "_i"))
    d = d.withColumn("_l", length)
    time = lambda c: F.sum(F.when(c, F.col(dur)).otherwise(0)).cast("long")
    out = d.groupBy(*key).agg(
        time(want).alias("expected"), time(want & F.coalesce(touch, F.lit(False))).alias("touching"), time(want & touch.isNull()).alias("unknown"),
        F.max("_l").cast("long").alias("longest"),
    )
    return out.withColumn("status", F.when(F.col("expected") == 0, "unknown").otherwise(verdict(F.col("longest") > allowed, F.col("unknown") == 0)))


def effects(df: DataFrame, key: list[str], order: list[str], v: str, gap: str, target: float) -> DataFrame:
    """What a value did: observed change (over known neighbours without a gap between), final value, status against a target."""
    w = in_order(key, *order)
    step = F.when(~F.lag(gap).over(w), F.col(v) - F.lag(v).over(w))
    d = df.withColumn("_s", step)
    last = F.max(F.struct(*order, F.col(v).alias("_v"))).getField("_v")
    out = d.groupBy(*key).agg(F.sum("_s").alias("change"), F.count("_s").alias("steps"), last.alias("final"))
    return out.withColumn("status", F.when(F.col("final").isNull(), "unknown").when(F.col("final") >= target, "pass").otherwise("fail"))


def contact_effect(df: DataFrame, key: list[str], order: list[str], contact: str, progress: str, dur: str, least: float, gap: str) -> DataFrame:
    """Contact time with, without and with unknown progress to the next row; across a gap it is unknown."""
    w = in_order(key, *order)
    gain = F.when(~F.col(gap), F.lead(progress).over(w) - F.col(progress))
    d = df.withColumn("_g", gain).where(F.coalesce(F.col(contact), F.lit(False)))
    time = lambda c: F.sum(F.when(c, F.col(dur)).otherwise(0)).cast("long")
    return d.groupBy(*key).agg(
        time(F.col("_g") > least).alias("with_progress"), time(F.col("_g") <= least).alias("without_progress"), time(F.col("_g").isNull()).alias("unknown")
    )


def safety(df: DataFrame, key: list[str], sampled: str, reported: str, limit: float) -> DataFrame:
    """The highest of sampled and reported peaks, and whether the limit was exceeded (null if nothing is known)."""
    d = df.groupBy(*key).agg(F.max(sampled).alias("sampled"), F.max(reported).alias("reported"))
    return d.withColumn("peak", F.greatest("sampled", "reported")).withColumn("exceeded", (F.col("sampled") > limit) | (F.col("reported") > limit))


def compared(model: DataFrame, reference: DataFrame, key: list[str], v: str) -> DataFrame:
    """Difference and ratio to a reference (the ratio only where that is positive): delta, ratio."""
    r = reference.select(*key, F.col(v).alias("_r"))
    d = model.join(r, key, "left")
    return d.select(*model.columns, F.col("_r").alias("reference"), (F.col(v) - F.col("_r")).alias("delta"), F.when(F.col("_r") > 0, F.col(v) / F.col("_r")).alias("ratio"))


def detection_scores(df: DataFrame, key: list[str], truth: str, found: str) -> DataFrame:
    """Precision, recall and F1 of a flag against another, 0 where there is nothing to divide by."""
    t, f = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(found), F.lit(False))
    d = df.groupBy(*key).agg(F.count_if(t & f).alias("hits"), F.count_if(~t & f).alias("false_alarms"), F.count_if(t & ~f).alias("misses"))
    h = F.col("hits").cast("double")
    or_zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return d.select(
        *d.columns, or_zero(h, F.col("hits") + F.col("false_alarms")).alias("precision"), or_zero(h, F.col("hits") + F.col("misses")).alias("recall"),
        or_zero(2 * h, 2 * F.col("hits") + F.col("false_alarms") + F.col("misses")).alias("f1"),
    )


def scoped(df: DataFrame, scopes: DataFrame, key: list[str], t: str, start: str, end: str, name: str) -> DataFrame:
    """Samples within half-open scopes whose boundaries are samples: rows of usable scopes, with the scope's name.

    A scope one of whose boundaries is no sample is left out as a whole; see :func:`scope_gate`.
    """
    ok = scope_gate(df, scopes, key, t, start, end).where("usable").drop("usable")
    return df.join(ok.select(*key, start, end, name), key).where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop(start, end)


def scope_gate(df: DataFrame, scopes: DataFrame, key: list[str], t: str, start: str, end: str) -> DataFrame:
    """Scopes with usable: whether both boundaries coincide with samples of their key."""
    clock = df.select(*key, t).distinct()
    side = lambda c, flag: clock.select(*key, F.col(t).alias(c), F.lit(True).alias(flag))
    d = scopes.join(side(start, "_s"), [*key, start], "left").join(side(end, "_e"), [*key, end], "left")
    return d.withColumn("usable", F.col("_s").isNotNull() & F.col("_e").isNotNull()).select(*scopes.columns, "usable")


def anchored_clock(df: DataFrame, snapshots: DataFrame, key: list[str], t: str, step: int, near: int) -> DataFrame:
    """A display clock whose snapshots (key, t) are anchors as well, if they lie within the record."""
    base = display_clock(df, key, t, step, near)
    ends = df.groupBy(*key).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    more = snapshots.select(*key, F.col(t).alias("at")).distinct().join(ends, key).where(F.col("at").between(F.col("_a"), F.col("_b"))).select(*key, "at")
    # A grid point is at most ``near`` from an anchor in its own cell of that width or a neighbouring one.
    cell = F.floor(F.col("at") / (near + 1))
    close = more.select(*key, F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"), F.col("at").alias("_s"))
    hit = base.withColumn("_c", cell).join(close, [*key, "_c"]).where(~F.col("anchor") & (F.abs(F.col("at") - F.col("_s")) <= near)).select(*key, "at").distinct()
    kept = base.join(hit.withColumn("_hit", F.lit(True)), [*key, "at"], "left").where(F.col("_hit").isNull()).select(*base.columns)
    fresh = more.join(kept.select(*key, "at"), [*key, "at"], "left_anti")
    return kept.unionByName(fresh.withColumn("anchor", F.lit(True)))


def display_clock(df: DataFrame, key: list[str], t: str, step: int, near: int) -> DataFrame:
    """A regular grid over each clock with both ends as anchors, which replace grid points within ``near``: key, at, anchor."""
    ends = df.groupBy(*key).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    grid = ends.select(*key, "_a", "_b", F.explode(steps(F.col("_a"), F.col("_b"), step)).alias("at"))
    close = (F.abs(F.col("at") - F.col("_a")) <= near) | (F.abs(F.col("at") - F.col("_b")) <= near)
    anchors = ends.select(*key, F.explode(F.array_distinct(F.array("_a", "_b"))).alias("at"), F.lit(True).alias("anchor"))
    return grid.where(~close).select(*key, "at", F.lit(False).alias("anchor")).unionByName(anchors)


def renamed(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Canonical names by a fixed map; unknown ones are kept apart as known = false."""
    place = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn("known", F.col(column).isin(*names)).withColumn(column, F.coalesce(place[F.col(column)], F.col(column)))


def slew(df: DataFrame, key: list[str], order: list[str], t: str, v: str, per_second: float) -> DataFrame:
    """The largest step in excess of a rate limit: steps, over, worst."""
    w = in_order(key, *order)
    dt = (F.col(t) - F.lag(t).over(w)) / 1e6
    d = df.withColumn("_x", F.abs(F.col(v) - F.lag(v).over(w)) - per_second * dt)
    return d.groupBy(*key).agg(F.count("_x").alias("steps"), F.count_if(F.col("_x") > 0).alias("over"), F.max("_x").alias("worst"))


def option_counts(df: DataFrame, option: str, current: Column) -> DataFrame:
    """Of each option, all rows and those of the current selection: option, total, current."""
    return df.groupBy(option).agg(F.count("*").alias("total"), F.count_if(current).alias("current"))


def natural_order(name: Column) -> Column:
    """A key that sorts numbers within names by value (each run of digits padded to 18 places)."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 18, "0")).otherwise(F.lower(p))), "")


def coverage_table(catalog: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Which catalogued tasks have evidence, and how much: key, rows, covered."""
    n = evidence.groupBy(key).agg(F.count("*").alias("_n"))
    d = catalog.select(key).distinct().join(n, key, "left")
    return d.select(key, F.coalesce("_n", F.lit(0)).alias("rows"), F.col("_n").isNotNull().alias("covered"))


def wiped_share(df: DataFrame, key: list[str], order: list[str], gate: Column, parts: dict[str, tuple[Column, float]]) -> DataFrame:
    """Work left after each row: 1 minus the least of several gated running sums, each against what it needs."""
    w = in_order(key, *order)
    done = [F.sum(F.when(F.coalesce(gate, F.lit(False)), F.coalesce(c.cast("double"), F.lit(0.0))).otherwise(0.0)).over(w) / need for c, need in parts.values()]
    least = F.least(*done) if len(done) > 1 else done[0]
    return df.withColumn("remaining", 1 - F.least(F.greatest(least, F.lit(0.0)), F.lit(1.0)))


def lookback_mean(df: DataFrame, key: list[str], t: str, tie: str, total: str, gap: str, back: int, unit: int, least: int | None = None) -> DataFrame:
    """Adds mean, the growth of a cumulative counter for each ``unit`` of time since the last sample at least ``back`` ago, and brief.

    Without such a sample the first one is taken. The mean is null where less
    than ``least`` (``back`` unless given) has passed, and where the counter is
    unknown, went down, or has a ``gap`` (behind a row) on the way. ``brief`` is
    true where too short a time is the only reason.
    """
    w, c = in_order(key, t, tie), logic.known(F.col(total))
    d = df.withColumn("_lb_n", c)
    before = F.last("_lb_n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    bad = F.coalesce(F.lag(gap).over(w), F.lit(False)) | F.col("_lb_n").isNull() | F.coalesce(F.col("_lb_n") < before, F.lit(False))
    d = d.withColumn("_lb_bad", F.sum(bad.cast("int")).over(w))
    d = d.withColumn("_lb_first", F.first(F.struct(F.col(t).alias("t"), F.col("_lb_n").alias("then"), F.col("_lb_bad").alias("bad"))).over(w))
    last = d.groupBy(*key, t).agg(F.max(F.struct(tie, F.struct(F.col(t).alias("t"), F.col("_lb_n").alias("then"), F.col("_lb_bad").alias("bad")).alias("s"))).alias("_s"))
    out = asof_backward(d, last.select(*key, (F.col(t) + back).alias(t), F.col("_s.s").alias("_lb_then")), key, t, ["_lb_then"])
    out = out.withColumn("_lb_from", F.coalesce("_lb_then", "_lb_first")).withColumn("_lb_span", F.col(t) - F.col("_lb_from.t"))
    sound, grown = (F.col("_lb_bad") == F.col("_lb_from.bad")) & F.col("_lb_from.then").isNotNull(), F.col("_lb_n") - F.col("_lb_from.then")
    long = F.col("_lb_span") >= (back if least is None else least)
    out = out.withColumn("mean", F.when(sound & long & (F.col("_lb_span") > 0), grown / (F.col("_lb_span") / unit))).withColumn("brief", F.coalesce(sound & ~long, F.lit(False)))
    return out.drop("_lb_n", "_lb_bad", "_lb_first", "_lb_then", "_lb_from", "_lb_span", "rt", "age")
