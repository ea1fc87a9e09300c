"""Whole analyses of recordings, trials and populations, composed of the operators.

Each takes tables of any size and gives tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import aggregates, clock, cohorts, evidence, overlap, paired, progress, quantiles, segments


def analyze_tactile(samples: DataFrame, key: list[str], channel: str, t: str, tie: str, v: str, on: float, off: float, least: int) -> dict[str, DataFrame]:
    """A tactile record: channels (coverage, contact, impulse, peak), intensity (weighted statistics), episodes (contact by hysteresis)."""
    g = clock.gap_aware(samples, key, t, tie)
    each = [*key, channel]
    own = clock.gap_aware(samples, each, t, tie)
    state = segments.hysteresis(own, each, [t, tie], v, on, off, F.col(v).isNotNull() & ~F.coalesce(F.lag("gap").over(clock.in_order(each, t, tie)), F.lit(False)))
    return {
        "channels": aggregates.channel_stats(g, each, t, v, "dur", on),
        "intensity": aggregates.weighted_stats(g, each, v, "dur", [t, tie]),
        "episodes": segments.episodes(state, each, [t, tie], "state", t, "dur", least),
    }


def analyze_episode(samples: DataFrame, key: list[str], t: str, tie: str, done: str, v: str, edges: list[float]) -> dict[str, DataFrame]:
    """An episode's progress: bins (visits, time, signal) and milestones (when each edge was reached first)."""
    g = clock.gap_aware(samples, key, t, tie)
    reached = F.explode(F.array(*map(F.lit, edges[1:]))).alias("edge")
    stones = samples.select(*key, t, done, reached).where(F.col(done) >= F.col("edge")).groupBy(*key, "edge").agg(F.min(t).alias("reached"))
    return {"bins": progress.progress_bins(g, key, t, tie, done, "gap", v, edges), "milestones": stones}


def summarize_population(bins: DataFrame, group: list[str], value: str) -> DataFrame:
    """Bins over episodes, each with equal weight."""
    return progress.population(bins, group, value)


def compare_to_reference(model: DataFrame, reference: DataFrame, key: list[str], v: str) -> DataFrame:
    """A model's values against a reference population of the same key: its median, the difference and ratio to it, and where each value ranks."""
    middle = quantiles.quantiles(reference, key, v, {"reference": 0.5})
    ranked = quantiles.rank_interval(model, reference, key, v).join(middle, key, "left")
    gap = F.col(v) - F.col("reference")
    return ranked.withColumn("delta", gap).withColumn("ratio", F.when(F.col("reference") > 0, F.col(v) / F.col("reference")))


def assess_contact_quality(samples: DataFrame, key: list[str], t: str, tie: str, v: str, contact: float, limit: float) -> DataFrame:
    """One row for each key: continuity of contact and the load in excess of a limit."""
    g = clock.gap_aware(samples, key, t, tie).withColumn("_touch", F.col(v) > contact)
    whole = paired.continuity(g, key, [t, tie], t, "dur", "_touch", "gap")
    return whole.join(evidence.load_report(g, key, v, "dur", limit), key)


def build_review(samples: DataFrame, key: list[str], t: str, tie: str, v: str, tolerance: float, least: int, rise: float, previews: int = 3) -> DataFrame:
    """Plateaus and growth of a value as ranked events: kind, start, end, samples, rank (longest first) and preview for the first few."""
    g = clock.gap_aware(samples, key, t, tie)
    columns = [*key, "start", "end", "samples"]
    flat = segments.plateaus(g, key, [t, tie], t, v, tolerance, least, "gap").select(*columns, F.lit("plateau").alias("kind"))
    grown = segments.growth_runs(g, key, [t, tie], t, v, rise, "gap").select(*columns, F.lit("growth").alias("kind"))
    events = flat.unionByName(grown)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.col("end") - F.col("start")), "start", "kind"))
    return events.withColumn("rank", rank).withColumn("preview", F.col("rank") <= previews)


def review_coverage(samples: DataFrame, events: DataFrame, key: list[str], t: str) -> DataFrame:
    """How much of each record its events cover: span, covered, rest (they add up), events."""
    span = samples.groupBy(*key).agg((F.max(t) - F.min(t)).alias("span"))
    held = overlap.union_length(events, key, "start", "end").join(events.groupBy(*key).agg(F.count("*").alias("events")), key)
    d = span.join(held, key, "left").na.fill(0, ["covered", "events"])
    return d.select(*key, "span", F.col("covered").cast("long").alias("covered"), (F.col("span") - F.col("covered")).cast("long").alias("rest"), "events")


def summarize_trials(trials: DataFrame, identity: list[str], missing: dict[str, Column], invalid: dict[str, Column], success: str, formal: str) -> DataFrame:
    """Trials classified by evidence, then counted by identity, overall and apart for formal and diagnostic ones."""
    d = cohorts.classified(trials, missing, invalid, F.col(success))
    return cohorts.split_counts(d, identity, "evidence", success, formal)


def aggregate_reports(reports: DataFrame, task: str, outcome: str) -> DataFrame:
    """The macro average of success over tasks, each with equal weight."""
    return cohorts.macro_average(reports, task, F.col(outcome) == "pass")
