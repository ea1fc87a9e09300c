"""Batches of trials: why each trial ended, rates with their own denominators, and cells of a planned experiment."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.logic import is_true
from tidewater.functions.numbers import ratio

#: Texts in an error's message (in any case) and the reason that they stand for, the first that is found counts.
ERROR_REASONS = (
    ("wrist target jump", "wrist_target_guard"),
    ("arm IK failed", "arm_ik_guard"),
    ("hand IK", "hand_ik_guard"),
    ("hand target is too far", "hand_ik_guard"),
    ("fell below", "object_dropped"),
    ("force exceeded", "force_guard"),
    ("resistance exceeded", "force_guard"),
    ("penetration exceeded", "penetration_guard"),
    ("Sponge penetration", "penetration_guard"),
    ("Hand/table penetration", "penetration_guard"),
    ("Hand/environment penetration", "penetration_guard"),
    ("Hand struck", "collision_guard"),
    ("Sponge element inverted", "sponge_integrity_guard"),
    ("nonfinite simulation", "nonfinite_state"),
)


@dataclass(frozen=True)
class Ending:
    """A way to end: when it applies, what it is called (null passes on to the next), and whether the trial then counts."""

    when: Column
    reason: Column
    counts: bool


def said(error: Column, reasons: tuple[tuple[str, str], ...] = ERROR_REASONS) -> Column:
    """The reason that an error's message stands for, or null."""
    text = F.lower(error)
    return F.coalesce(*[F.when(F.contains(text, F.lit(part.lower())), reason) for part, reason in reasons])


def last_kind(events: Column) -> Column:
    """The kind of the last guard event that has one, or null."""
    return F.try_element_at(F.filter(F.transform(events, lambda e: e["kind"]), lambda k: k.isNotNull()), F.lit(-1))


def endings() -> list[Ending]:
    """The ways to end of reports with record_error, events, physics_valid, status, success, stop_reason and error, in order of precedence."""
    c, lit = F.col, F.lit
    kind = lambda other: F.coalesce(last_kind(c("events")), lit(other))
    return [
        Ending(F.length("record_error") > 0, lit("record_error"), False),
        Ending(~c("physics_valid"), kind("physics_invalid"), False),
        Ending((c("status") == "success") & c("success"), lit("success"), True),
        Ending(c("stop_reason") == "request_limit", lit("request_limit"), True),
        Ending((c("stop_reason") == "time_limit") | (c("status") == "task_not_completed"), lit("time_limit"), True),
        Ending(c("stop_reason") == "guard", kind("guard"), True),
        Ending(c("stop_reason") == "fatal_error", lit("fatal_error"), False),
        Ending(lit(True), said(c("error")), True),
        Ending(lit(True), lit("infrastructure_or_contract_error"), False),
    ]


def ended(reports: DataFrame, ways: list[Ending]) -> DataFrame:
    """Adds termination and counts by the first way that applies and has a name; an unknown condition does not apply."""
    first = F.coalesce(*[F.when(is_true(w.when) & w.reason.isNotNull(), F.struct(w.reason.alias("r"), F.lit(w.counts).alias("c"))) for w in ways])
    return reports.withColumn("_e", first).withColumn("termination", F.col("_e.r")).withColumn("counts", F.col("_e.c")).drop("_e")


def batch_summary(planned: DataFrame, trials: DataFrame, batch: list[str], success: str, formal: str, started: str) -> DataFrame:
    """Batches of ended trials: planned, attempted, valid, successes, task_successes, rate (of valid trials), formal, formal_rate and terminations (a map).

    A batch is formal once as many trials are there as planned and all are formal;
    its formal rate is null otherwise. Successes of trials that do not count are
    task successes only. Planned batches without trials are there; the map's size is bounded by the ways to end.
    """
    each = trials.groupBy(*batch, "termination").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(started, F.lit(True))).alias("a"), F.count_if("counts").alias("v"),
        F.count_if(is_true(F.col(success)) & F.col("counts")).alias("s"), F.count_if(is_true(F.col(success))).alias("t"), F.count_if(is_true(F.col(formal))).alias("f"),
    )
    told = each.groupBy(*batch).agg(
        *[F.sum(x).alias(x) for x in "navstf"], F.map_from_entries(F.array_sort(F.collect_list(F.struct("termination", "n")))).alias("terminations")
    )
    d = planned.groupBy(*batch).agg(F.count("*").alias("planned")).join(told, batch, "left").na.fill(0, list("navstf"))
    formal_ = (F.col("n") == F.col("planned")) & (F.col("f") == F.col("n"))
    rate = ratio(F.col("s").cast("double"), F.col("v"))
    return d.select(
        *batch, "planned", F.col("a").alias("attempted"), F.col("v").alias("valid"), F.col("s").alias("successes"), F.col("t").alias("task_successes"),
        rate.alias("rate"), formal_.alias("formal"), F.when(formal_, rate).alias("formal_rate"), F.coalesce("terminations", F.create_map().cast("map<string,bigint>")).alias("terminations"),
    )


def cells(planned: DataFrame, reports: DataFrame, key: list[str], cell: list[str], numbers: list[str]) -> DataFrame:
    """Cells of a planned experiment against reports with status, success and quality.

    An interrupted report is no failure and is not evaluated; an exception is
    evaluated and counted apart. Gives planned, reported, unstarted, interrupted,
    exceptions, evaluated, then successes, quality and qualified (both) each with its
    rate of evaluated cases, and least, mean and most of each number over evaluated ones.
    """
    d = planned.select(*key, *cell).join(reports.select(*key, "status", "success", "quality", *numbers, F.lit(True).alias("_is")), key, "left")
    there = F.col("_is").isNotNull()
    done = there & ~F.coalesce(F.col("status") == "interrupted", F.lit(False))
    good, fine = is_true(F.col("success")), is_true(F.col("quality"))
    parts = {"successes": good, "quality": fine, "qualified": good & fine}
    seen = lambda x: F.when(done, F.col(x))
    out = d.groupBy(*cell).agg(
        F.count("*").alias("planned"), F.count_if(there).alias("reported"), F.count_if(~there).alias("unstarted"), F.count_if(there & ~done).alias("interrupted"),
        F.count_if(F.col("status") == "exception").alias("exceptions"), F.count_if(done).alias("evaluated"), *[F.count_if(done & c).alias(n) for n, c in parts.items()],
        *[f(seen(x)).alias(f"{x}_{name}") for x in numbers for name, f in (("least", F.min), ("mean", F.avg), ("most", F.max))],
    )
    return out.withColumns({f"{n}_rate": ratio(F.col(n).cast("double"), F.col("evaluated")) for n in parts})


def failures(planned: DataFrame, reports: DataFrame, key: list[str], cell: list[str], what: list[str], lists: list[str]) -> DataFrame:
    """Histograms of evaluated reports: cell, histogram, value, n. Columns of ``what`` count where success is not known true, arrays of ``lists`` whatever came of it."""
    d = planned.select(*key, *cell).join(reports, key).where(~F.coalesce(F.col("status") == "interrupted", F.lit(False)))
    entry = lambda n, v: F.struct(F.lit(n).alias("histogram"), v.cast("string").alias("value"))
    single = F.array_compact(F.array(*[F.when(~is_true(F.col("success")), entry(n, F.col(n))) for n in what]))
    of = lambda n: F.transform(F.coalesce(n, F.array().cast("array<string>")), lambda v: entry(n, v))
    many = [of(n) for n in lists]
    return d.select(*cell, F.explode(reduce(F.concat, [single, *many])).alias("_e")).groupBy(*cell, "_e.histogram", "_e.value").agg(F.count("*").alias("n"))
