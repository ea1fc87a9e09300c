"""Integrity audits: rule tables, relations, jumps, duplicates, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.clock import in_order

#: Scale of a normal distribution's median absolute deviation (fixed value).
MAD_SCALE = 1.4826


def validated(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each key: samples, errors (rules that some row breaks or leaves unknown, in order), valid.

    All rules are evaluated in one aggregation; counts of broken rows come along.
    """
    broken = {n: F.count_if(~F.coalesce(c, F.lit(False))) for n, c in rules.items()}
    d = df.groupBy(*key).agg(F.count("*").alias("samples"), *[c.alias(f"_{n}") for n, c in broken.items()])
    errors = F.array_compact(F.array(*[F.when(F.col(f"_{n}") > 0, F.lit(n)) for n in rules]))
    counts = sum((F.col(f"_{n}") for n in rules), F.lit(0)).cast("long")
    return d.select(*key, "samples", errors.alias("errors"), counts.alias("broken")).withColumn("valid", F.size("errors") == 0)


def relation(df: DataFrame, key: list[str], order: list[str], a: str, b: str) -> DataFrame:
    """How two columns relate in each key: equal, equal to the next row's, and the largest differences."""
    w = in_order(key, *order)
    d = df.withColumn("_next", F.lead(b).over(w)).withColumn("_more", F.lead(F.lit(True)).over(w))
    same = F.col(a).eqNullSafe(F.col(b))
    later = F.when(F.col("_more"), F.col(a).eqNullSafe(F.col("_next")))
    return d.groupBy(*key).agg(
        F.bool_and(same).alias("equal"), F.coalesce(F.bool_and(later), F.lit(True)).alias("shifted_equal"),
        F.max(F.abs(F.col(a) - F.col(b))).alias("most"), F.max(F.abs(F.col(a) - F.col("_next"))).alias("shifted_most"),
    )


def jumps(df: DataFrame, key: list[str], order: list[str], v: str, absolute: float, factor: float = 8.0) -> DataFrame:
    """Steps beyond max(absolute, median + factor * 1.4826 * MAD) of a key's steps: step, threshold, spike.

    A spike goes straight back: the next step has the other sign and the value
    after it is within a quarter of the step from the one before.
    """
    w = in_order(key, *order)
    d = df.withColumn("_b", F.lag(v).over(w)).withColumn("_a", F.lead(v).over(w)).withColumn("step", F.abs(F.col(v) - F.lag(v).over(w)))
    middle = d.groupBy(*key).agg(F.percentile("step", F.lit(0.5)).alias("_m"))
    off = d.join(middle, key)
    spread = off.groupBy(*key, "_m").agg(F.percentile(F.abs(F.col("step") - F.col("_m")), F.lit(0.5)).alias("_d"))
    limit = F.greatest(F.lit(absolute), F.col("_m") + factor * MAD_SCALE * F.col("_d"))
    out = d.join(spread.select(*key, limit.alias("threshold")), key).where(F.col("step") > F.col("threshold"))
    back = ((F.col(v) - F.col("_b")) * (F.col("_a") - F.col(v)) < 0) & (F.abs(F.col("_a") - F.col("_b")) < 0.25 * F.col("step"))
    return out.withColumn("spike", F.coalesce(back, F.lit(False))).drop("_b", "_a")


def duplicate_runs(df: DataFrame, key: list[str], order: list[str], fingerprint: str) -> DataFrame:
    """Stretches of two or more rows in order with one fingerprint: start and end place, length."""
    w = in_order(key, *order)
    d = df.withColumn("_p", F.row_number().over(w))
    fresh = F.coalesce(~F.lag(fingerprint).over(w).eqNullSafe(F.col(fingerprint)), F.lit(True))
    d = d.withColumn("_f", fresh.cast("int")).withColumn("_g", F.sum("_f").over(w))
    out = d.groupBy(*key, "_g").agg(F.min("_p").alias("start"), F.max("_p").alias("end"), F.count("*").alias("length"))
    return out.where(F.col("length") > 1).drop("_g")


def first_seen(df: DataFrame, fingerprint: list[str], order: list[str], what: str) -> DataFrame:
    """Adds seen_as: the first row's ``what`` among all of one fingerprint, where this row is a later one.

    Two narrow aggregations instead of a window, so a hot fingerprint is combined before the shuffle.
    """
    first = df.groupBy(*fingerprint).agg(F.min(F.struct(*order, F.col(what).alias("_w"))).alias("_s"))
    d = df.join(first, fingerprint)
    same = F.struct(*[F.col(c) for c in order]) == F.struct(*[F.col(f"_s.{c}") for c in order])
    return d.withColumn("seen_as", F.when(~same, F.col("_s._w"))).drop("_s")


def fingerprint(df: DataFrame, key: list[str], fields: list[Column]) -> DataFrame:
    """A mergeable fingerprint of each key's rows, whatever their order: samples and the sum of row digests.

    Row digests are SHA-256 of the fields, each with its length in front (a null
    has none), so no two different rows spell alike. Two halves of 64 bits are
    summed exactly; nothing is collected. The value can be recomputed outside Spark;
    :func:`quick_fingerprint` is several times cheaper where it only has to be compared.
    """
    spell = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    row = F.sha2(F.concat(*[spell(c) for c in fields]), 256)
    signed = {f"_{i}": F.conv(F.substring("_row", i, 16), 16, -10).cast("long") for i in (1, 17)}
    d = df.select(*key, row.alias("_row")).select(*key, *[c.alias(n) for n, c in signed.items()])
    # Each half's two words of 32 bits are summed as longs; wide decimals are made once a key.
    sums = [x for n in signed for x in (F.sum(F.shiftrightunsigned(n, 32)).alias(f"{n}h"), F.sum(F.col(n).bitwiseAND(0xFFFFFFFF)).alias(f"{n}l"))]
    whole = lambda n: (F.col(f"{n}h").cast("decimal(19, 0)") * F.lit(1 << 32).cast("decimal(10, 0)") + F.col(f"{n}l")).cast("string")
    out = d.groupBy(*key).agg(F.count("*").alias("samples"), *sums)
    return out.select(*key, "samples", F.concat_ws(":", *[whole(n) for n in signed]).alias("fingerprint"))


def quick_fingerprint(df: DataFrame, key: list[str], fields: list[Column]) -> DataFrame:
    """Like :func:`fingerprint`, but from two salted 64-bit hashes of the fields' own types, without any strings: samples, a, b.

    The halves of each hash are summed as longs, so rows may come in any order and number
    (under 2^31 a key). Nulls are told apart by where they stand.
    """
    flat = [x for c in fields for x in (c.isNull(), c)]
    d = df.select(*key, *[F.xxhash64(F.lit(salt), *flat).alias(n) for n, salt in (("_a", 1), ("_b", 2))])
    half = lambda n: (F.sum(F.shiftright(n, 32)), F.sum(F.col(n).bitwiseAND(0xFFFFFFFF)))
    joined = lambda n: (F.shiftleft(half(n)[0], 32).bitwiseXOR(half(n)[1])).alias(n[1:])
    return d.groupBy(*key).agg(F.count("*").alias("samples"), joined("_a"), joined("_b"))


def twins(df: DataFrame, key: str, fields: list[Column]) -> DataFrame:
    """Keys whose rows equal those of a smaller key, whatever their order: key, samples, twin (the smallest such key)."""
    d = quick_fingerprint(df, [key], fields)
    # The least key of each print is combined before the shuffle, so a third of all keys may be alike.
    least = d.groupBy("samples", "a", "b").agg(F.min(key).alias("twin"))
    return d.join(least, ["samples", "a", "b"]).where(F.col("twin") != F.col(key)).select(key, "samples", "twin")


def duplicate_groups(df: DataFrame, fingerprint: list[str], member: str, most: int = 10) -> DataFrame:
    """Fingerprints of several members: members, and the ``most`` smallest of them (a report, so bounded)."""
    part = F.pmod(F.xxhash64(member), F.lit(64))
    first = lambda x: F.slice(F.array_sort(x), 1, most)
    d = df.withColumn("_p", part)
    # Parts of a hot fingerprint are ranked apart (Spark cuts ranks before the shuffle), then their first members together.
    ranked = d.withColumn("_r", F.row_number().over(Window.partitionBy(*fingerprint, "_p").orderBy(member))).where(F.col("_r") <= most)
    few = ranked.groupBy(*fingerprint).agg(first(F.collect_list(member)).alias("examples"))
    return df.groupBy(*fingerprint).agg(F.count("*").alias("members")).where(F.col("members") > 1).join(few, fingerprint)


def strict_prefix(df: DataFrame, key: list[str], t: str, tie: str, step: int, tolerance: int) -> DataFrame:
    """How far each clock keeps to a regular grid from its first sample: samples, on_grid, terminal_only.

    ``on_grid`` counts the samples before the first one off the grid; terminal_only
    says that none but the last is off.
    """
    w = in_order(key, t, tie)
    whole = Window.partitionBy(*key)
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_f", F.min(t).over(whole))
    off = F.abs(F.col(t) - F.col("_f") - F.col("_i") * step) > tolerance
    out = d.withColumn("_o", off).groupBy(*key).agg(
        F.count("*").alias("samples"), F.coalesce(F.min(F.when(F.col("_o"), F.col("_i"))), F.count("*")).alias("on_grid")
    )
    return out.withColumn("on_grid", F.col("on_grid").cast("long")).withColumn("terminal_only", F.col("on_grid") >= F.col("samples") - 1)


def monotone_log(df: DataFrame, key: list[str], order: str, t: str, flags: list[str]) -> DataFrame:
    """Checks of a state log: clock_ok (never back), flags_ok (none is unset again), and the last row's flags."""
    w = in_order(key, order)
    back = F.coalesce(F.col(t) < F.lag(t).over(w), F.lit(False))
    unset = [F.coalesce(F.lag(f).over(w) & ~F.col(f), F.lit(False)) for f in flags]
    bad = unset[0]
    for u in unset[1:]:
        bad = bad | u
    d = df.withColumn("_back", back).withColumn("_bad", bad)
    last = F.max(F.struct(F.col(order).alias("o"), *flags))
    return d.groupBy(*key).agg(
        (~F.bool_or("_back")).alias("clock_ok"), (~F.bool_or("_bad")).alias("flags_ok"), *[last.getField(f).alias(f) for f in flags]
    )
