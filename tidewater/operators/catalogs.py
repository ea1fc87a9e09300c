"""Building and checking catalogs: nested members, stages, metrics, archives, definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.numbers import ratio


def flattened(groups: DataFrame, parent: list[str], members: str) -> DataFrame:
    """One row for each member (a struct) of each group, with the group's columns; groups without members go."""
    return groups.select(*parent, F.explode(members).alias("_m")).select(*parent, "_m.*")


def stage_counts(df: DataFrame, group: list[str], stages: str, eligible: Column) -> DataFrame:
    """Of every stage of an array of nullable flags: members, known, reached, rate, over eligible rows."""
    d = df.where(eligible).select(*group, F.posexplode(stages).alias("stage", "_s"))
    out = d.groupBy(*group, "stage").agg(F.count("*").alias("members"), F.count("_s").alias("known"), F.count_if("_s").alias("reached"))
    return out.withColumn("rate", ratio(F.col("reached").cast("double"), F.col("known")))


def metric_means(df: DataFrame, group: list[str], metrics: str) -> DataFrame:
    """Of every metric in a map: mean over episodes that know it, known, episodes."""
    d = df.select(*group, F.explode(metrics).alias("metric", "_x"))
    return d.groupBy(*group, "metric").agg(F.avg("_x").alias("mean"), F.count("_x").alias("known"), F.count("*").alias("episodes"))


def numeric_leaves(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each numeric leaf of the other columns, however deep in structs: path (dots between names), value."""

    def leaves(kind: T.DataType, at: Column, path: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in leaves(f.dataType, at.getField(f.name), f"{path}.{f.name}" if path else f.name)]
        return [F.struct(F.lit(path).alias("path"), at.cast("double").alias("value"))] if isinstance(kind, T.NumericType) else []

    every = [x for f in df.schema if f.name not in key for x in leaves(f.dataType, F.col(f.name), f.name)]
    return df.select(*key, F.explode(F.array(*every)).alias("_l")).select(*key, "_l.*")


def mismatched(recomputed: DataFrame, archived: DataFrame, key: list[str]) -> DataFrame:
    """Keys on which an archive and its recomputation differ, with the names of the fields that do (all, where one side lacks the key)."""
    fields = [c for c in archived.columns if c not in key]
    pack = lambda d, n: d.select(*key, F.struct(*fields).alias(n))
    both = pack(recomputed, "_a").join(pack(archived, "_b"), key, "full")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) | F.col("_a").isNull() | F.col("_b").isNull(), F.lit(c)) for c in fields]))
    return both.select(*key, wrong.alias("fields")).where(F.size("fields") > 0)


def definition_conflicts(df: DataFrame, group: list[str], definition: str) -> DataFrame:
    """Groups (by everything that identifies them) that hold more than one stage definition: definitions, members."""
    d = df.groupBy(*group).agg(F.countDistinct(definition).alias("definitions"), F.count("*").alias("members"))
    return d.where(F.col("definitions") > 1)


def batch_results(df: DataFrame, batch: list[str], identity: str, success: str, metric: str) -> DataFrame:
    """Rates and means of a batch, null unless all its rows share one known identity: rows, consistent, known, rate, mean."""
    d = df.groupBy(*batch).agg(
        F.count("*").alias("rows"), ((F.countDistinct(identity) == 1) & (F.count(identity) == F.count("*"))).alias("consistent"),
        F.count(success).alias("known"), F.count_if(F.col(success)).alias("_s"), F.avg(metric).alias("_m"),
    )
    ok = lambda c: F.when(F.col("consistent"), c)
    return d.select(*batch, "rows", "consistent", "known", ok(ratio(F.col("_s").cast("double"), F.col("known"))).alias("rate"), ok(F.col("_m")).alias("mean"))


def flagged_union(sources: dict[str, DataFrame], quarantined: dict[str, Column], countable: Column) -> DataFrame:
    """All sources' members with source, quarantined, and countable (never if quarantined)."""
    parts = [d.withColumn("source", F.lit(n)).withColumn("quarantined", F.coalesce(quarantined.get(n, F.lit(False)), F.lit(False))) for n, d in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("countable", F.coalesce(countable, F.lit(False)) & ~F.col("quarantined"))


def reason_histogram(df: DataFrame, group: list[str], reasons: str) -> DataFrame:
    """How often each reason of an array occurs in each group: reason, n."""
    return df.select(*group, F.explode(reasons).alias("reason")).groupBy(*group, "reason").agg(F.count("*").alias("n"))


def level_rollup(df: DataFrame, levels: list[str], success: str) -> DataFrame:
    """Counts at every single level, never across two: level, name, members, known, successes."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("name")) for c in levels]))
    d = df.select(each.alias("_l"), success).select("_l.*", success)
    return d.groupBy("level", "name").agg(F.count("*").alias("members"), F.count(success).alias("known"), F.count_if(success).alias("successes"))


def first_seen_order(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The names in the order in which they first occur: name, first (the row's order), rows."""
    return df.groupBy(name).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("rows"))


def checked_setting(df: DataFrame, key: list[str], value: str, valid: Column) -> DataFrame:
    """One setting by consensus: value and status verified, conflict, unknown, or invalid if any given value breaks the rule."""
    d = df.groupBy(*key).agg(
        F.countDistinct(value).alias("_n"), F.min(value).alias("_v"), F.count_if(F.col(value).isNotNull() & ~F.coalesce(valid, F.lit(False))).alias("_bad")
    )
    status = F.when(F.col("_bad") > 0, "invalid").when(F.col("_n") == 0, "unknown").when(F.col("_n") == 1, "verified").otherwise("conflict")
    return d.select(*key, status.alias("status")).join(d, key).select(*key, F.when(F.col("status") == "verified", F.col("_v")).alias(value), "status")


def merged_clips(parts: DataFrame, key: list[str]) -> DataFrame:
    """Clip summaries of several runs as one: counts add up, the excess is the largest."""
    return parts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("clipped").alias("clipped"), F.max("excess").alias("excess"))


def unified(sources: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One catalog of many sources that need not have the same columns: key, fields, source, sources and conflicts.

    A member's fields are those of its first source in the order given, whole; a
    repeated key within a source keeps its least row. ``sources`` names all that hold it and
    ``conflicts`` the fields of which two sources know different values. One shuffle by key.
    """
    parts = [d.withColumn("_n", F.lit(i)).withColumn("_s", F.lit(n)) for i, (n, d) in enumerate(sources.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    fields = [c for c in both.columns if c not in (*key, "_n", "_s")]
    first = F.min(F.struct("_n", F.struct(*fields).alias("f") if fields else F.lit(True).alias("f"))).alias("_f")
    spread = [F.when(F.min(c) != F.max(c), F.lit(c)) for c in fields]
    d = both.groupBy(*key).agg(first, F.array_compact(F.array(*spread).cast("array<string>")).alias("conflicts"), F.array_sort(F.collect_set(F.struct("_n", "_s"))).alias("_a"))
    named = F.array(*map(F.lit, sources))
    return d.select(*key, *[F.col(f"_f.f.{c}").alias(c) for c in fields], named[F.col("_f._n")].alias("source"), F.transform("_a", lambda x: x["_s"]).alias("sources"), "conflicts")


def stage_rows(groups: DataFrame, key: list[str], stages: str) -> DataFrame:
    """Flat rows of groups and their stages (a map from a name to a struct), ready for CSV; a group without stages keeps one row with none."""
    d = groups.select(*key, F.explode_outer(F.map_entries(stages)).alias("_e"))
    return d.select(*key, F.col("_e.key").alias("stage"), "_e.value.*")


def selection_totals(groups: DataFrame, selections: dict[str, Column], counts: list[str], rates: dict[str, tuple[str, str]]) -> DataFrame:
    """Totals over named selections of groups in one pass: selection, groups, the sum of each count, and rates (sums divided, null over nothing).

    Selections may overlap; one that nothing falls into is there with zeros.
    """
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in selections.items()]))
    each = groups.select(F.explode(names).alias("selection"), *counts).groupBy("selection").agg(F.count("*").alias("groups"), *[F.sum(c).alias(c) for c in counts])
    every = groups.sparkSession.createDataFrame([(n,) for n in selections], "selection string")
    d = F.broadcast(every).join(each, "selection", "left").na.fill(0, ["groups", *counts])
    return d.withColumns({n: ratio(F.col(a).cast("double"), F.col(b)) for n, (a, b) in rates.items()})
