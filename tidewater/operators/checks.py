"""Audits across streams and against sources: conservation, alignment, exports, provenance, batches, stored logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.numbers import dot, ratio
from tidewater.operators.clock import in_order


def conservation(grid: Column, total: Column, normal: Column, tangent: Column, basis: Column, tolerance: float) -> dict[str, Column]:
    """Whether a force adds up: the grid's sum is the total's norm along its normal, normal and tangent parts give the total, the basis (two 3-vectors) is orthonormal.

    ``total``, ``normal`` and ``tangent`` are 3-vectors, ``basis`` has six numbers; nulls are breaches.
    """
    near = lambda a, b: F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    u, v = F.slice(basis, 1, 3), F.slice(basis, 4, 3)
    parts = [near(normal[i].cast("double") + tangent[i], total[i]) for i in range(3)]
    sum_ = F.aggregate(grid, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return {
        "grid": near(sum_, F.sqrt(dot(normal, normal))),
        "parts": parts[0] & parts[1] & parts[2],
        "basis": near(dot(u, u), F.lit(1.0)) & near(dot(v, v), F.lit(1.0)) & near(dot(u, v), F.lit(0.0)),
        "projection": near(dot(normal, tangent), F.lit(0.0)),
    }


def breaches(df: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """Of each key: rows, and how many break each check."""
    return df.groupBy(*key).agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])


def aligned_forces(df: DataFrame, key: list[str], order: list[str], command: str, measured: str, gain: float, tolerance: float) -> DataFrame:
    """How well an actuator's measured force follows ``gain`` times the command of the row before: rows, off, worst and mean error."""
    w = in_order(key, *order)
    d = df.withColumn("_e", F.abs(F.col(measured) - gain * F.lag(command).over(w)))
    return d.groupBy(*key).agg(F.count("_e").alias("rows"), F.count_if(F.col("_e") > tolerance).alias("off"), F.max("_e").alias("worst"), F.avg("_e").alias("mean"))


def against_source(export: DataFrame, source: DataFrame, key: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """An export's fields against their source, row by row: field, rows, missing, extra, unequal nulls, off (beyond ``tolerance``), worst difference."""
    pack = lambda d, n: d.select(*key, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias(n))
    both = pack(export, "_a").join(pack(source, "_b"), key, "full")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a.{f}").alias("a"), F.col(f"_b.{f}").alias("b")) for f in fields])).alias("_f")
    d = both.select(F.col("_a").isNull().alias("_extra_side"), F.col("_b").isNull().alias("_lost_side"), each)
    there, off = ~F.col("_extra_side") & ~F.col("_lost_side"), F.abs(F.col("_f.a") - F.col("_f.b"))
    return d.groupBy(F.col("_f.field").alias("field")).agg(
        F.count("*").alias("rows"), F.count_if("_extra_side").alias("missing"), F.count_if("_lost_side").alias("extra"),
        F.count_if(there & (F.col("_f.a").isNull() != F.col("_f.b").isNull())).alias("nulls"), F.count_if(off > tolerance).alias("off"), F.max(off).alias("worst"),
    )


def provenance(files: DataFrame, recorded: DataFrame, path: str, digest: str) -> DataFrame:
    """Files against recorded digests: path and status matched, changed, unrecorded or lost."""
    a = files.select(path, F.col(digest).alias("_now"))
    b = recorded.select(path, F.col(digest).alias("_then"))
    status = F.when(F.col("_then").isNull(), "unrecorded").when(F.col("_now").isNull(), "lost").when(F.col("_now") == F.col("_then"), "matched").otherwise("changed")
    return a.join(b, path, "full").select(path, status.alias("status"))


def batch_assertions(df: DataFrame, batch: list[str], expected: Column, checks: dict[str, Column]) -> DataFrame:
    """A batch's quality: trials, expected, the names of failed checks (a check fails if a row breaks it or leaves it unknown), passed."""
    counts = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_{n}") for n, c in checks.items()]
    d = df.groupBy(*batch).agg(F.count("*").alias("trials"), F.max(expected).alias("expected"), *counts)
    failed = [F.when(F.col("trials") != F.col("expected"), F.lit("count")), *[F.when(F.col(f"_{n}") > 0, F.lit(n)) for n in checks]]
    return d.select(*batch, "trials", "expected", F.array_compact(F.array(*failed)).alias("failed")).withColumn("passed", F.size("failed") == 0)


def log_against_summary(log: DataFrame, summary: DataFrame, key: list[str], order: list[str], flags: list[str]) -> DataFrame:
    """The last row of each state log against the trial's summary: agrees, and the flags that differ (all, if either is absent)."""
    last = log.groupBy(*key).agg(F.max(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *flags)).alias("_l"))
    both = last.join(summary.select(*key, F.struct(*flags).alias("_s")), key, "full")
    wrong = [F.when(F.col("_l").isNull() | F.col("_s").isNull() | ~F.col(f"_l.{f}").eqNullSafe(F.col(f"_s.{f}")), F.lit(f)) for f in flags]
    out = both.select(*key, F.array_compact(F.array(*wrong)).alias("differ"))
    return out.withColumn("agrees", F.size("differ") == 0)


def suspect_repeats(df: DataFrame, key: list[str], order: list[str], image: str, position: str, least: float) -> DataFrame:
    """Rows whose image is that of the row before: identical, and suspect where the position moved by more than ``least`` all the same."""
    w = in_order(key, *order)
    d = df.withColumn("_same", F.lag(image).over(w) == F.col(image)).withColumn("_moved", F.abs(F.col(position) - F.lag(position).over(w)))
    return d.groupBy(*key).agg(F.count_if("_same").alias("identical"), F.count_if(F.col("_same") & (F.col("_moved") > least)).alias("suspect"))


def deadlines(df: DataFrame, key: list[str], t: str, tie: str, period: int) -> DataFrame:
    """Which rows a sampler of that period takes: the first at or after each deadline, missed deadlines being skipped: adds deadline."""
    d = df.withColumn("_n", F.ceil(F.col(t) / period).cast("long"))
    first = F.row_number().over(in_order([*key, "_n"], t, tie))
    return d.withColumn("_r", first).where(F.col("_r") == 1).withColumn("deadline", F.col("_n") * period).drop("_n", "_r")


def area_integrals(df: DataFrame, key: list[str], dur: str, area: str, whole: float, least: float) -> DataFrame:
    """An area over time: its integral, its mean share of the whole, and the time it was at least a share ``least``; unknown areas take no part."""
    a, d = F.col(area), F.when(F.col(area).isNotNull(), F.col(dur)).cast("double")
    share = ratio(F.sum(a * d), F.sum(d)) / whole
    held = F.coalesce(F.sum(F.when(a >= least * whole, F.col(dur))), F.lit(0)).cast("long")
    return df.groupBy(*key).agg(F.sum(a * d).alias("integral"), share.alias("share"), held.alias("covered"))


def opposed_grasp(thumb: Column, others: Column, least: float, most: float) -> Column:
    """Whether a thumb's force vector and the sum of the others' oppose each other: both loads at least ``least``, cosine at most ``most``.

    False, not unknown, where a cosine is undefined; unknown with an unknown vector.
    """
    norms = F.sqrt(dot(thumb, thumb)), F.sqrt(dot(others, others))
    cosine = F.when(norms[0] * norms[1] > 1e-12, dot(thumb, others) / (norms[0] * norms[1]))
    return (norms[0] >= least) & (norms[1] >= least) & F.when(norms[0].isNotNull() & norms[1].isNotNull(), F.coalesce(cosine <= most, F.lit(False)))
