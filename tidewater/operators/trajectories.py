"""Checks of recorded trajectories: speeds, turning rates and accelerations from poses, and recorded rates against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import logic, rotations
from tidewater.operators.clock import in_order


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _vector(name: str, size: int) -> Column:
    """An array of ``size`` finite numbers, or null."""
    c = F.transform(F.col(name), lambda x: logic.known(x))
    return F.when((F.size(c) == size) & F.forall(c, lambda x: x.isNotNull()), c)


def motion(df: DataFrame, key: list[str], t: str, tie: str, position: str, quaternion: str, unit: int, velocity: str | None = None, spin: str | None = None) -> DataFrame:
    """Steps between neighbouring rows, with what the poses say of them.

    Adds dt (in ``unit``), speed, spin (the turning rate), acceleration (between
    the middles of steps), and where rates are recorded the residuals
    velocity_residual and spin_residual: how far the mean of both rows' rates is
    from the step's own. All are null on a first row, where the clock stands or
    goes back, and where a number is missing; quaternions need not be of length 1.
    """
    w = in_order(key, t, tie)
    d = df.withColumn("_p", _vector(position, 3)).withColumn("_q", _vector(quaternion, 4))
    d = d.withColumn("_q", F.when(length(F.col("_q")) > 1e-12, F.col("_q")))
    for name, rate in (("_v", velocity), ("_w", spin)):
        d = d.withColumn(name, _vector(rate, 3) if rate else F.lit(None).cast("array<double>"))
    kept = ["_p", "_q", "_v", "_w"]
    d = d.withColumn("_b", F.lag(F.struct(t, *kept)).over(w)).withColumn("dt", (F.col(t) - F.col(f"_b.{t}")) / unit)
    per = lambda v: F.when(F.col("dt") > 0, F.transform(v, lambda x: x / F.col("dt")))
    d = d.withColumn("_l", per(_minus(F.col("_p"), F.col("_b._p")))).withColumn("_s", per(rotations.turn_between(F.col("_b._q"), F.col("_q"))))
    mean = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2)
    d = d.withColumn("velocity_residual", length(_minus(mean(F.col("_v"), F.col("_b._v")), F.col("_l"))))
    d = d.withColumn("spin_residual", length(_minus(mean(F.col("_w"), F.col("_b._w")), F.col("_s"))))
    step = F.struct(F.col("_l").alias("l"), F.col("dt").alias("dt"))
    # The last step with a positive time before: standing rows repeat a pose and are passed over.
    before = F.last(F.when(F.col("dt") > 0, step), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_a", F.when(F.col("dt") > 0, before))
    d = d.withColumn("acceleration", length(_minus(F.col("_l"), F.col("_a.l"))) / ((F.col("dt") + F.col("_a.dt")) / 2))
    return d.withColumn("speed", length(F.col("_l"))).withColumn("spin", length(F.col("_s"))).drop("_p", "_q", "_v", "_w", "_b", "_l", "_s", "_a")


def clock_faults(df: DataFrame, key: list[str], t: str, tie: str) -> DataFrame:
    """For each key: rows, standing (steps without time), backward (steps back in the order of ``tie``)."""
    d = df.withColumn("_d", F.col(t) - F.lag(t).over(in_order(key, tie)))
    return d.groupBy(*key).agg(F.count("*").alias("rows"), F.count_if(F.col("_d") == 0).alias("standing"), F.count_if(F.col("_d") < 0).alias("backward"))


def screened(df: DataFrame, key: list[str], t: str, tie: str, phase: str, thresholds: dict[str, float], top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Each metric of each key against a threshold above which a step is a candidate for review.

    First: key, metric, samples, most, p50, p95, p99, candidates. Second: the
    ``top`` largest candidates of each, as key, metric, rank, t, value, phase and
    changed (whether the phase differs from the row before); ties to the earlier
    row. Ranks are cut before the shuffle.
    """
    d = df.withColumn("_changed", F.coalesce(F.col(phase) != F.lag(phase).over(in_order(key, t, tie)), F.lit(False)))
    each = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(limit).alias("limit")) for n, limit in thresholds.items()]
    rows = d.select(*key, F.col(t).alias("t"), F.col(tie).alias("_tie"), F.col(phase).alias("phase"), F.col("_changed").alias("changed"), F.explode(F.array(*each)).alias("m"))
    rows = rows.select(*key, "t", "_tie", "phase", "changed", "m.*").where(F.col("value").isNotNull())
    mark = F.percentile("value", F.array(*map(F.lit, (0.5, 0.95, 0.99))))
    told = rows.groupBy(*key, "metric").agg(
        F.count("*").alias("samples"), F.max("value").alias("most"), mark.alias("_q"), F.count_if(F.col("value") > F.col("limit")).alias("candidates")
    )
    told = told.select(*key, "metric", "samples", "most", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "candidates")
    order = Window.partitionBy(*key, "metric").orderBy(F.desc("value"), "t", "_tie")
    found = rows.where(F.col("value") > F.col("limit")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return told, found.select(*key, "metric", "rank", "t", "value", "phase", "changed")
