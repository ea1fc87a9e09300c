"""Analytics of single tasks and the encoders of training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.identity import seeded_hash
from tidewater.functions.numbers import ratio
from tidewater.operators.clock import in_order
from tidewater.operators.features import composed, feature_stats, rigid_inverse
from tidewater.operators.segments import hold_timer


def finger_telemetry(df: DataFrame, key: list[str], order: list[str], t: str, load: str, slip: str, gap: str, on: float, least_slip: float, sustain: int) -> DataFrame:
    """Of each key: force by time (right ends), loss edges, longest time out of contact, slip by trapezoids, and the first sustained slip.

    A step behind a ``gap`` counts for nothing. Contact is a load above ``on``; a
    loss is a loaded sample before an unloaded one. Slip is sustained once its
    speed has exceeded ``least_slip`` for ``sustain`` without a break.
    """
    w = in_order(key, *order)
    late = F.coalesce(F.lag(gap).over(w), F.lit(False))
    d = df.withColumn("_late", late).withColumn("_dt", F.when(~F.col("_late"), F.col(t) - F.lag(t).over(w)))
    on_ = F.col(load) > on
    d = d.withColumn("_on", on_).withColumn("_loss", F.lag(on_).over(w) & ~on_ & ~F.col("_late"))
    d = d.withColumn("_area", 0.5 * (F.col(slip) + F.lag(slip).over(w)) * F.col("_dt"))
    d = hold_timer(d, key, order, t, ~F.col("_on"), F.col("_late"), "_out")
    d = hold_timer(d, key, order, t, F.col(slip) > least_slip, F.col("_late"), "_slip")
    return d.groupBy(*key).agg(
        F.sum(F.col(load) * F.col("_dt")).alias("impulse"), F.count_if("_loss").alias("losses"), F.max("_out").alias("longest_out"),
        F.sum("_area").alias("slip"), F.min(F.when(F.col("_slip") >= sustain, F.col(t))).alias("sustained"),
    )


def least_normal(load: Column, friction: Column, contacts: int = 2, margin: float = 1.0) -> Column:
    """The normal force on each of ``contacts`` faces that holds a tangential load by Coulomb friction, times a margin; null without friction."""
    return F.when(friction > 0, ratio(load * margin, friction * contacts))


def pressure_window(load: Column, friction: Column, limit: Column, contacts: int = 2) -> tuple[Column, Column]:
    """The window of normal forces that hold a load without exceeding a limit: its lower end, and its width (null where there is none)."""
    low = least_normal(load, friction, contacts)
    return low, F.when(limit >= low, limit - low)


def qualified(df: DataFrame, group: list[str], success: str, metric: str, seeds: int, rate: float, most: float) -> DataFrame:
    """A multi-seed audit: runs, successes, rate, worst metric, and qualified (enough runs, all outcomes known, rate and worst within the rules)."""
    d = df.groupBy(*group).agg(F.count("*").alias("runs"), F.count(success).alias("known"), F.count_if(success).alias("successes"), F.max(metric).alias("worst"))
    d = d.withColumn("rate", ratio(F.col("successes").cast("double"), F.col("known")))
    ok = (F.col("runs") >= seeds) & (F.col("known") == F.col("runs")) & (F.col("rate") >= rate) & (F.col("worst") <= most)
    return d.withColumn("qualified", F.coalesce(ok, F.lit(False)))


def cases(df: DataFrame, key: str, ranges: dict[str, Column], uniform: int, seed: int) -> DataFrame:
    """Randomised cases of every task: the nominal one, every corner of its ranges (plus and minus), and ``uniform`` drawn by hash.

    A row of ``df`` is a task with its own ranges. Gives key, case, kind, one column for each
    range, and case_seed. Draws are hashes of seed, task, case and name, so any executor makes
    the same ones.
    """
    corners, names = 2 ** len(ranges), list(ranges)
    of = df.select(key, *[c.alias(f"_{n}") for n, c in ranges.items()])
    d = of.withColumn("case", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(corners + uniform).cast("long"))))
    hashed = lambda *parts: F.conv(F.substring(seeded_hash(seed, F.concat_ws(":", F.col(key), F.col("case"), *parts)), 1, 8), 16, 10).cast("long")
    kind = F.when(F.col("case") == 0, "nominal").when(F.col("case") <= corners, "corner").otherwise("uniform")

    def at(j: int, name: str) -> Column:
        # Corners count up in binary, the first range slowest.
        bit = F.shiftright(F.col("case") - 1, len(names) - 1 - j).bitwiseAND(1)
        sign = F.when(F.col("kind") == "corner", 2.0 * bit - 1.0).when(F.col("kind") == "uniform", 2 * (hashed(F.lit(name)).cast("double") / 2**32) - 1).otherwise(0.0)
        return (sign * F.col(f"_{name}")).alias(name)

    return d.withColumn("kind", kind).select(key, "case", "kind", *[at(j, n) for j, n in enumerate(names)], hashed().alias("case_seed"))


def stage_start(df: DataFrame, key: list[str], order: list[str], t: str, condition: Column, gap: str, stable: int) -> DataFrame:
    """The first row of each key behind which the condition then holds for ``stable``: the row's columns (no row where it never does)."""
    w = in_order(key, *order)
    d = hold_timer(df, key, order, t, condition, F.coalesce(F.lag(gap).over(w), F.lit(False)), "_held")
    found = d.where(F.col("_held") >= stable).groupBy(*key).agg(F.min(F.col(t) - F.col("_held")).alias("_start"))
    at = d.join(found, key).where((F.col(t) == F.col("_start")) & F.col("_held").isNotNull())
    first = F.row_number().over(in_order(key, *order))
    return at.withColumn("_r", first).where(F.col("_r") == 1).select(*df.columns)


def in_camera(poses: Column, camera: Column) -> Column:
    """Each of an array of 4 by 4 poses in a camera's frame (both given in the world)."""
    back = rigid_inverse(camera)
    return F.transform(poses, lambda p: composed(back, p))


def train_statistics(sessions: list[DataFrame], split: DataFrame, session: str, array: str) -> DataFrame:
    """Feature statistics over the rows of all sessions whose session the split table assigns to training."""
    rows = sessions[0]
    for s in sessions[1:]:
        rows = rows.unionByName(s)
    train = split.where(F.col("split") == "train").select(session)
    return feature_stats(rows.join(train, session, "left_semi"), [], array)


def relocated(df: DataFrame, manifest: DataFrame, path: str, digest: str, old: str, new: str) -> DataFrame:
    """Paths below ``old`` rebuilt below ``new`` where the manifest has the same digest for the rest of the path: adds moved, and path as it then is.

    Others keep their path and have moved = false.
    """
    rest = F.substring(F.col(path), len(old) + 1, 1 << 30)
    d = df.withColumn("_rest", F.when(F.col(path).startswith(old), rest))
    m = manifest.select(F.col(path).alias("_rest"), F.col(digest).alias("_digest"))
    both = d.join(m, "_rest", "left").withColumn("moved", F.coalesce(F.col("_digest") == F.col(digest), F.lit(False)))
    return both.withColumn(path, F.when(F.col("moved"), F.concat(F.lit(new), "_rest")).otherwise(F.col(path))).drop("_rest", "_digest")
