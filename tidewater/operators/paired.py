"""Phases, frames and episodes side by side: per-phase statistics, frames with states, a rollout on its reference's clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.numbers import ratio
from tidewater.operators.asof import asof_backward, bracket
from tidewater.operators.clock import in_order
from tidewater.operators.overlap import union_length
from tidewater.operators.segments import runs


def phase_statistics(df: DataFrame, key: list[str], phase: str, v: str, w: str) -> DataFrame:
    """Of each phase of each key: samples, known, time, mean and std by time, root mean square, greatest."""
    x, d = F.col(v), F.when(F.col(v).isNotNull(), F.col(w)).cast("double")
    mean, square = ratio(F.sum(x * d), F.sum(d)), ratio(F.sum(x * x * d), F.sum(d))
    return df.groupBy(*key, phase).agg(
        F.count("*").alias("samples"), F.count(v).alias("known"), F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("time"), mean.alias("mean"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.sqrt(square).alias("rms"), F.max(v).alias("most"),
    )


def phase_variability(stats: DataFrame, group: list[str], mean: str) -> DataFrame:
    """How a phase's mean varies over episodes, each with equal weight: episodes, known, mean, std, cv (null unless the mean is positive)."""
    d = stats.groupBy(*group).agg(F.count("*").alias("episodes"), F.count(mean).alias("known"), F.avg(mean).alias("mean"), F.stddev_pop(mean).alias("std"))
    return d.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")))


def contact_variation(df: DataFrame, key: list[str], v: str, w: str, on: float) -> DataFrame:
    """Mean, std and cv of the load by time, over all known rows and over those in contact (above ``on``)."""
    parts = {"all": F.col(v).isNotNull(), "contact": F.col(v) > on}
    aggs = []
    for n, ok in parts.items():
        x, d = F.when(ok, F.col(v)), F.when(ok, F.col(w)).cast("double")
        mean = ratio(F.sum(x * d), F.sum(d))
        aggs += [mean.alias(f"{n}_mean"), F.sqrt(F.greatest(ratio(F.sum(x * x * d), F.sum(d)) - mean * mean, F.lit(0.0))).alias(f"{n}_std")]
    out = df.groupBy(*key).agg(*aggs)
    cv = lambda n: F.when(F.col(f"{n}_mean") > 0, F.col(f"{n}_std") / F.col(f"{n}_mean")).alias(f"{n}_cv")
    return out.select("*", cv("all"), cv("contact"))


def fingertip_forces(forces: Column, fingers: int, taxels: int) -> Column:
    """Of a flat array of (normal, tangent, tangent) by taxel and finger: structs of the normal sum and the norm of the tangent vectors' sum."""
    at = lambda f, t, c: forces[(f * taxels + t) * 3 + c].cast("double")
    total = lambda f, c: sum((at(f, t, c) for t in range(1, taxels)), at(f, 0, c))
    return F.array(*[F.struct(total(f, 0).alias("normal"), F.hypot(total(f, 1), total(f, 2)).alias("tangent")) for f in range(fingers)])


def frames_with_states(frames: DataFrame, states: DataFrame, key: list[str], index: str, t: str) -> DataFrame:
    """Frames with the state they name (key and index): adds the state's columns, state_t, and causal (the state is there and not later)."""
    s = states.withColumnRenamed(t, "state_t")
    d = frames.join(s, [*key, index], "left")
    return d.withColumn("causal", F.coalesce(F.col("state_t") <= F.col(t), F.lit(False)))


def paired(reference: DataFrame, rollout: DataFrame, key: list[str], t: str, v: str, factor: float = 1.5) -> DataFrame:
    """A rollout held on its reference's clock, both counted from their first samples: key, t, dur, reference, rollout.

    Pairs end with the shorter of the two; a reference step beyond ``factor`` of its
    median takes no time; a rollout value expires after ``factor`` of its median steps.
    """
    def own(d: DataFrame, name: str) -> DataFrame:
        w = in_order(key, t)
        whole = in_order(key, t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = d.select(*key, (F.col(t) - F.min(t).over(whole)).alias(t), F.col(v).alias(name))
        d = d.withColumn("dur", F.coalesce(F.lead(t).over(w) - F.col(t), F.lit(0).cast("long")))
        d = d.withColumn("_c", F.percentile(F.when(F.col("dur") > 0, F.col("dur")), F.lit(0.5)).over(whole)).withColumn("_end", F.max(t).over(whole))
        return d.withColumn("dur", F.when(F.col("dur") > F.col("_c") * factor, 0).otherwise(F.col("dur")))

    left, right = own(reference, "reference"), own(rollout, "rollout")
    right = right.select(*key, t, "rollout", F.col("_c").alias("limit"), F.col("_end").alias("ends"))
    both = asof_backward(left, right, key, t, ["rollout", "limit", "ends"])
    both = both.where(F.col("rt").isNotNull() & (F.col(t) < F.least("_end", "ends")))
    held = F.when(F.col("age") <= F.col("limit") * factor, F.col("rollout"))
    dur = F.least(F.col("dur"), F.least("_end", "ends") - F.col(t))
    return both.select(*key, t, dur.alias("dur"), "reference", held.alias("rollout"))


def paired_report(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Of each pair: time, compared time, coverage, means by time, mean absolute difference and bias."""
    ok = F.col("reference").isNotNull() & F.col("rollout").isNotNull()
    d, gap = F.when(ok, F.col("dur")).cast("double"), F.col("rollout") - F.col("reference")
    mean = lambda x: ratio(F.sum(x * d), F.sum(d))
    return pairs.groupBy(*key).agg(
        F.sum("dur").alias("time"), F.coalesce(F.sum(d), F.lit(0.0)).cast("long").alias("compared"), ratio(F.coalesce(F.sum(d), F.lit(0.0)), F.sum("dur").cast("double")).alias("coverage"),
        mean(F.col("reference")).alias("reference"), mean(F.col("rollout")).alias("rollout"), mean(F.abs(gap)).alias("mae"), mean(gap).alias("bias"),
    )


def continuity(df: DataFrame, key: list[str], order: list[str], t: str, dur: str, contact: str, gap: str) -> DataFrame:
    """A key's contact as a whole: runs, time in contact, longest run, unknown time, span and the share of it that runs cover.

    A gap (behind a row) ends a run; unknown contact is none, and its time is counted apart.
    """
    r = runs(df, key, order, contact, F.lag(gap).over(in_order(key, *order)))
    per = r.where(F.coalesce(F.col(contact), F.lit(False))).groupBy(*key, "run").agg(F.min(t).alias("start"), F.max(F.col(t) + F.col(dur)).alias("end"))
    spans = per.groupBy(*key).agg(F.count("*").alias("runs"), F.max(F.col("end") - F.col("start")).alias("longest"))
    whole = df.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.col(contact), F.col(dur))), F.lit(0)).alias("time"), F.coalesce(F.sum(F.when(F.col(contact).isNull(), F.col(dur))), F.lit(0)).alias("unknown"),
        (F.max(t) - F.min(t)).alias("span"),
    )
    out = whole.join(spans, key, "left").join(union_length(per, key, "start", "end"), key, "left")
    out = out.na.fill(0, ["runs", "longest", "covered"])
    return out.select(*key, "runs", "time", "longest", "unknown", "span", ratio(F.col("covered").cast("double"), F.col("span")).alias("share"))


def onsets(df: DataFrame, key: list[str], order: list[str], t: str, contact: str) -> DataFrame:
    """The table of contacts: start, end (their last sample), samples, and whether the record cuts them on either side."""
    r = runs(df, key, order, contact)
    ends = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_a"), F.max(F.struct(*order)).alias("_b"))
    per = r.where(F.coalesce(F.col(contact), F.lit(False))).groupBy(*key, "run").agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("samples"), F.min(F.struct(*order)).alias("_s"), F.max(F.struct(*order)).alias("_e")
    )
    d = per.join(ends, key)
    return d.select(*key, "start", "end", "samples", (F.col("_s") == F.col("_a")).alias("cut_left"), (F.col("_e") == F.col("_b")).alias("cut_right"))


def onset_frames(contacts: DataFrame, frames: DataFrame, key: list[str], t: str, frame: str) -> DataFrame:
    """Frames around each contact's onset and release: key, start, end, before, on, last, after.

    ``before`` is the last frame ahead of the start and ``on`` the first at or behind it (even
    behind the end); ``last`` is the last frame at or ahead of the end and ``after`` the
    first behind it. A side that the record cuts has none, for its onset was not seen. All
    four marks of all contacts meet the frames in one union and sort by key; clocks are whole numbers.
    """
    mark = lambda name, at: F.struct(F.lit(name).alias("m"), at.cast("long").alias(t))
    a, b = F.col("start"), F.col("end")
    marks = contacts.select(*key, "start", "end", "cut_left", "cut_right", F.explode(F.array(mark("before", a - 1), mark("on", a), mark("last", b), mark("after", b + 1))).alias("_m"))
    near = bracket(marks.select(*key, "start", "end", "cut_left", "cut_right", "_m.*"), frames, key, t, [frame])
    pick = lambda name, side, cut: F.max(F.when((F.col("m") == name) & ~F.col(cut), F.col(f"{side}.{frame}"))).alias(name)
    return near.groupBy(*key, "start", "end").agg(pick("before", "prev", "cut_left"), pick("on", "next", "cut_left"), pick("last", "prev", "cut_right"), pick("after", "next", "cut_right"))
