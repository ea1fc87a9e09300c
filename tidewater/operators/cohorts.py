"""Trial statistics with explicit denominators, and catalog queries.

Unknown, invalid and missing trials stay visible; a success rate divides by valid
trials only; trials of different identities are never pooled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.identity import seeded_hash
from tidewater.functions.numbers import ratio, wilson


def outcome_bounds(df: DataFrame, key: list[str], outcome: str, configuration: str) -> DataFrame:
    """Counts of pass, fail and unknown; confirmed, possible and resolved shares; the 95 % interval.

    The interval is null if an outcome is unknown or configurations are mixed.
    """
    is_ = lambda x: F.count_if(F.col(outcome) == x).alias(x)
    d = df.groupBy(*key).agg(F.count("*").alias("trials"), is_("pass"), is_("fail"), is_("unknown"), F.countDistinct(configuration).alias("configurations"))
    n, p = F.col("trials"), F.col("pass")
    low, high = wilson(p, n)
    single = (F.col("unknown") == 0) & (F.col("configurations") == 1)
    return d.select(
        *d.columns, ratio(p.cast("double"), n).alias("confirmed"), ratio((p + F.col("unknown")).cast("double"), n).alias("possible"),
        ratio(p.cast("double"), p + F.col("fail")).alias("resolved"), F.when(single, low).alias("low"), F.when(single, high).alias("high"),
    )


def macro_average(df: DataFrame, task: str, success: Column) -> DataFrame:
    """The mean of the tasks' success shares, each task with equal weight: tasks, macro."""
    each = df.groupBy(task).agg(F.avg(success.cast("double")).alias("_share"))
    return each.agg(F.count("*").alias("tasks"), F.avg("_share").alias("macro"))


def split_counts(df: DataFrame, identity: list[str], status: str, success: str, formal: str) -> DataFrame:
    """Counts of each identity, overall and apart for formal and diagnostic trials: split, valid, invalid, missing, successes, rate.

    One pass: grouping sets over the identity with and without the formal flag.
    """
    mode = F.when(F.col(formal), "formal").otherwise("diagnostic")
    d = df.withColumn("_mode", mode)
    every = d.select(*identity, status, success, F.explode(F.array(F.lit("overall"), F.col("_mode"))).alias("split"))
    of = lambda x: F.count_if(F.col(status) == x).alias(x)
    wins = F.count_if((F.col(status) == "valid") & F.coalesce(F.col(success), F.lit(False))).alias("successes")
    out = every.groupBy(*identity, "split").agg(F.count("*").alias("members"), of("valid"), of("invalid"), of("missing"), wins)
    return out.withColumn("rate", ratio(F.col("successes").cast("double"), F.col("valid")))


def classified(df: DataFrame, missing: dict[str, Column], invalid: dict[str, Column], success: Column) -> DataFrame:
    """Adds evidence (valid, invalid or missing), reasons (all that apply, in order) and counted_success.

    Any invalid reason outweighs missing ones; success counts for valid trials only.
    """
    flags = lambda rules: [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    any_ = lambda rules: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in rules.values()])
    evidence = F.when(any_(invalid), "invalid").when(any_(missing), "missing").otherwise("valid")
    d = df.withColumn("evidence", evidence).withColumn("reasons", F.array_compact(F.array(*flags(missing), *flags(invalid))))
    return d.withColumn("counted_success", F.when(F.col("evidence") == "valid", success))


def deduplicated(df: DataFrame, fingerprint: list[str], order: list[str]) -> DataFrame:
    """Adds kept (the first of each fingerprint) and kept_as, the first order value of the kept row.

    ``order`` tells rows apart. The first ones come from a partial aggregation, so
    a hot fingerprint is combined before the shuffle and split in the join.
    """
    first = df.groupBy(*fingerprint).agg(F.min(F.struct(*order)).alias("_f"))
    d = df.join(first, fingerprint)
    return d.withColumn("kept", F.struct(*order) == F.col("_f")).withColumn("kept_as", F.col(f"_f.{order[0]}")).drop("_f")


def without_leaks(df: DataFrame, held_out: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in the held-out set (nulls match nothing)."""
    return df.join(held_out.select(*on).distinct(), on, "left_anti")


def merged_catalog(base: DataFrame, added: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Base and new members in one table, and the added rows that would change a base row of their key (must be empty).

    The base rows stay as they are. A row is a change if some column differs, null
    being a value; every added row that repeats a key is compared.
    """
    new = added.join(base.select(*key), key, "left_anti")
    rest = [c for c in base.columns if c not in key]
    theirs = added.select(*key, F.struct(*rest).alias("_new") if rest else F.lit(True).alias("_new"))
    ours = base.select(*key, F.struct(*rest).alias("_old") if rest else F.lit(True).alias("_old"))
    changed = ours.join(theirs, key).where(~F.col("_old").eqNullSafe(F.col("_new")))
    return base.unionByName(new), changed.select(*key, *[F.col(f"_new.{c}").alias(c) for c in rest])


def membership(base: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """Every key of either side once, with in_base and in_added."""
    a = base.select(*key).distinct().withColumn("in_base", F.lit(True))
    b = added.select(*key).distinct().withColumn("in_added", F.lit(True))
    return a.join(b, key, "full").na.fill(False, ["in_base", "in_added"])


def dealt(df: DataFrame, key: list[str], rows: int = 1 << 18) -> DataFrame:
    """``df`` dealt by key over as many tasks as it takes for about ``rows`` rows each, whatever its size.

    Rows are counted first (Parquet tables tell from their footers). Adaptive execution
    would join partitions by their compressed bytes, so a task's hash tables would grow with the input.
    """
    return df.repartition(df.count() // rows + 1, *key)


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows only in one of two tables of the same columns, repeats counted: side (missing or unexpected).

    One aggregation: each row's number on one side less that on the other.
    """
    both = expected.withColumn("_n", F.lit(1).cast("long")).union(actual.withColumn("_n", F.lit(-1).cast("long")))
    d = both.groupBy(*[F.col(f"`{c}`") for c in expected.columns]).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    # Repeats are written out in arrays of at most 65,536.
    d = d.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.abs("_n") - 1, F.lit(1 << 16).cast("long"))))
    side = F.when(F.col("_n") > 0, "missing").otherwise("unexpected")
    return d.withColumn("side", F.explode(F.array_repeat(side, F.least(F.lit(1 << 16), F.abs("_n") - F.col("_at")).cast("int")))).drop("_n", "_at")


def reconciled(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Embedded against sidecar values of each key: value (the known one) and status."""
    r = right.select(*key, F.col(value).alias("_other"))
    both = left.select(*key, F.col(value).alias("_own")).join(r, key, "full")
    a, b = F.col("_own"), F.col("_other")
    status = F.when(a.isNull() & b.isNull(), "absent").when(a.isNull(), "sidecar").when(b.isNull(), "embedded").when(a == b, "agreed").otherwise("conflict")
    return both.select(*key, F.when(status != "conflict", F.coalesce(a, b)).alias(value), status.alias("status"))


def gated(child: DataFrame, parent: DataFrame, key: list[str], parent_ok: str, own_ok: str) -> DataFrame:
    """Children are valid only under a valid parent: adds valid and why (own, parent, orphan or null)."""
    d = child.join(parent.select(*key, F.col(parent_ok).alias("_ok")), key, "left")
    why = F.when(F.col("_ok").isNull(), "orphan").when(~F.col("_ok"), "parent").when(~F.coalesce(F.col(own_ok), F.lit(False)), "own")
    return d.withColumn("why", why).withColumn("valid", why.isNull()).drop("_ok")


def consensus(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """What a key's rows say about one setting: value (if all agree) and status verified, unknown or conflict."""
    d = df.groupBy(*key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias("_v"))
    status = F.when(F.col("_n") == 0, "unknown").when(F.col("_n") == 1, "verified").otherwise("conflict")
    return d.select(*key, F.when(F.col("_n") == 1, F.col("_v")).alias(value), status.alias("status"))


def hash_split(df: DataFrame, group: list[str], key: str, share: float, seed: int) -> DataFrame:
    """Adds split: the first rows of each group by seeded hash are validation, at least one and never all.

    Exact, and no group is ranked in one task: rows are counted by the first bits
    of their hash, the running counts of these cells say which are taken whole,
    and only the one cell of a group in which the limit falls is ranked.
    """
    h = seeded_hash(seed, F.col(key))
    d = df.withColumn("_h", h).withColumn("_cell", F.substring("_h", 1, 3))
    cells = d.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_cell")) - F.col("_n")
    total = F.sum("_n").over(Window.partitionBy(*group))
    wanted = F.greatest(F.lit(1), F.least(F.col("_t") - 1, F.rint(F.col("_t") * share).cast("long")))
    cells = cells.withColumn("_before", before).withColumn("_t", total).withColumn("_left", wanted - F.col("_before")).drop("_t", "_before")
    d = d.join(cells, [*group, "_cell"])
    cut = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    ranked = d.where(cut).withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_cell").orderBy("_h", key)))
    out = d.where(~cut).withColumn("_r", F.lit(0)).unionByName(ranked)
    inside = F.when(F.col("_left") >= F.col("_n"), True).otherwise((F.col("_left") > 0) & (F.col("_r") <= F.col("_left")))
    return out.withColumn("split", F.when(inside, "validation").otherwise("train")).drop("_h", "_cell", "_n", "_left", "_r")


def hash_split_threshold(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds split by comparing the seeded hash with a threshold: no shuffle, shares hold on average."""
    head = F.conv(F.substring(seeded_hash(seed, F.col(key)), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(head < int(share * 2**32), "validation").otherwise("train"))


def faceted(df: DataFrame, facets: dict[str, str | None], text: str | None = None, over: list[Column] | None = None) -> DataFrame:
    """Rows that match every given facet (None or empty: all) and hold ``text`` in the joined fields, whatever its case."""
    for name, value in facets.items():
        if value:
            df = df.where(F.col(name) == value)
    if text and text.strip():
        df = df.where(F.lower(F.concat_ws(" ", *(over or []))).contains(text.strip().lower()))
    return df


def stage_category(stages: Column, eligible: Column, complete: Column) -> Column:
    """complete, partial, none or unknown, from an array of nullable stage flags."""
    some = F.exists(stages, lambda s: F.coalesce(s, F.lit(False)))
    none = (F.size(stages) > 0) & F.forall(stages, lambda s: F.coalesce(~s, F.lit(False)))
    known = F.when(complete, "complete").when(some, "partial").when(none, "none").otherwise("unknown")
    return F.when(eligible, known).otherwise("unknown")


def group_summary(df: DataFrame, group: list[str], eligible: str, native: str, complete: str) -> DataFrame:
    """Members, eligible and excluded ones, and known and successful ones by native outcome and by completion."""
    on = F.col(eligible)
    known = lambda c: F.count_if(on & F.col(c).isNotNull())
    wins = lambda c: F.count_if(on & F.coalesce(F.col(c), F.lit(False)))
    return df.groupBy(*group).agg(
        F.count("*").alias("members"), F.count_if(on).alias("eligible"), F.count_if(~on).alias("excluded"),
        known(native).alias("native_known"), wins(native).alias("native_success"),
        known(complete).alias("complete_known"), wins(complete).alias("complete_success"),
    )


def pooled_means(df: DataFrame, metric: list[str], mean: str, known: str) -> DataFrame:
    """Archived means pooled by how many episodes each rests on: metric, value, known."""
    d = df.where((F.col(known) > 0) & F.col(mean).isNotNull())
    return d.groupBy(*metric).agg(
        ratio(F.sum(F.col(mean) * F.col(known)), F.sum(known)).alias("value"), F.sum(known).cast("long").alias("known")
    )


def by_definition(df: DataFrame, group: list[str], definition: str, complete: str) -> DataFrame:
    """Completion of each stage definition apart (definitions are never pooled), by its hash: signature, known, successes."""
    d = df.where(F.col(complete).isNotNull()).withColumn("signature", F.sha2(F.col(definition), 256))
    return d.groupBy(*group, "signature").agg(F.count("*").alias("known"), F.count_if(complete).alias("successes"))


def same_rules(df: DataFrame, group: list[str], rule: str) -> DataFrame:
    """Whether each group's rows were judged by one rule set: group, rules, compatible."""
    d = df.groupBy(*group).agg(F.countDistinct(rule).alias("rules"))
    return d.withColumn("compatible", F.col("rules") == 1)


def planned_against_reported(planned: DataFrame, reports: DataFrame, key: list[str], group: list[str], status: str, value: str) -> DataFrame:
    """Experiment cells: planned, reported, evaluated, interrupted, success rate over evaluated ones, and the value's range, sum and count."""
    d = planned.join(reports, key, "left")
    known = F.col(status).isNotNull()
    done = F.col(status).isin("success", "failure")
    return d.groupBy(*group).agg(
        F.count("*").alias("planned"), F.count_if(known).alias("reported"), F.count_if(done).alias("evaluated"),
        F.count_if(known & ~done).alias("interrupted"),
        ratio(F.count_if(F.col(status) == "success").cast("double"), F.count_if(done)).alias("rate"),
        F.min(value).alias("least"), F.sum(value).alias("sum"), F.count(value).alias("values"), F.max(value).alias("most"),
    )


def bound_members(df: DataFrame, manifest: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Members as a manifest binds them: key and status bound (same digest), altered, unlisted or absent."""
    a, b = df.select(*key, F.col(digest).alias("_a")), manifest.select(*key, F.col(digest).alias("_b"))
    status = F.when(F.col("_b").isNull(), "unlisted").when(F.col("_a").isNull(), "absent").when(F.col("_a") == F.col("_b"), "bound").otherwise("altered")
    return a.join(b, key, "full").select(*key, status.alias("status"))


def declared_split(df: DataFrame, declared: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the split that was declared for their key; one that is declared twice differently or not at all has none and says why."""
    d = declared.groupBy(*key).agg(F.countDistinct("split").alias("_n"), F.min("split").alias("split"))
    out = df.join(d, key, "left")
    why = F.when(F.col("_n").isNull(), "undeclared").when(F.col("_n") > 1, "conflict")
    return out.withColumn("why", why).withColumn("split", F.when(F.col("_n") == 1, F.col("split"))).drop("_n")
