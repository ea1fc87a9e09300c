"""Training features: next actions, windows, histories, statistics, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.asof import bracket
from tidewater.operators.clock import in_order


def next_action(df: DataFrame, key: list[str], order: list[str], state: list[str]) -> DataFrame:
    """Each row with the next row's state as next_<name>; the last row of a key has none and goes."""
    w = in_order(key, *order)
    d = df.withColumn("_more", F.lead(F.lit(True)).over(w))
    return d.select(*df.columns, *[F.lead(c).over(w).alias(f"next_{c}") for c in state], "_more").where("_more").drop("_more")


def action_windows(df: DataFrame, key: list[str], order: list[str], value: str, horizon: int, out: str = "actions") -> DataFrame:
    """Each row with the next ``horizon`` values as an array; rows that lack some go."""
    ahead = in_order(key, *order).rowsBetween(1, horizon)
    wrapped = F.collect_list(F.struct(F.col(value).alias("x"))).over(ahead)  # a struct, so that nulls stay
    return df.withColumn(out, F.transform(wrapped, lambda s: s["x"])).where(F.size(out) == horizon)


def history(df: DataFrame, key: list[str], order: list[str], value: str, stride: int, length: int, out: str = "history") -> DataFrame:
    """Each row with ``length`` values at ``stride``, oldest first, the first value repeated before the start."""
    w = in_order(key, *order)
    x = F.struct(F.col(value).alias("x"))
    at = [F.coalesce(F.lag(x, k * stride).over(w), F.first(x).over(w)).getField("x") for k in range(length - 1, -1, -1)]
    return df.withColumn(out, F.array(*at))


def continuous_signs(df: DataFrame, key: list[str], order: list[str], array: str) -> DataFrame:
    """Quaternions with signs such that neighbours are less than a right angle apart; after a right angle the sign starts anew."""
    w = in_order(key, *order)
    d = df.withColumn("_before", F.lag(array).over(w))
    dot = F.aggregate(F.zip_with("_before", array, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    d = d.withColumn("_dot", dot).withColumn("_part", F.sum(F.coalesce((F.col("_dot") == 0).cast("int"), F.lit(0))).over(w))
    d = d.withColumn("_turn", F.sum(F.coalesce((F.col("_dot") < 0).cast("int"), F.lit(0))).over(in_order([*key, "_part"], *order)))
    sign = F.when(F.col("_turn") % 2 == 1, -1.0).otherwise(1.0)
    return d.withColumn("_s", sign).withColumn(array, F.transform(array, lambda x: x.cast("double") * F.col("_s"))).drop("_before", "_dot", "_part", "_turn", "_s")


def feature_stats(df: DataFrame, key: list[str], array: str) -> DataFrame:
    """Of each array position: n, least, greatest, mean and population std, by partial aggregation."""
    x = df.select(*key, F.posexplode(array).alias("pos", "x"))
    return x.groupBy(*key, "pos").agg(
        F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")
    )


def window_stats(df: DataFrame, key: list[str], order: list[str], value: str, horizon: int) -> DataFrame:
    """Statistics over all overlapping windows of ``horizon`` next rows, without making them.

    A row counts once for each complete window that holds it. Gives key, n, mean, std.
    """
    w, whole = in_order(key, *order), Window.partitionBy(*key)
    d = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole))
    # Windows start at rows 1 .. n - horizon and hold the rows behind their start.
    first, last = F.greatest(F.lit(1), F.col("_i") - horizon), F.least(F.col("_n") - horizon, F.col("_i") - 1)
    d = d.withColumn("_w", F.greatest(F.lit(0), last - first + 1)).where((F.col("_w") > 0) & F.col(value).isNotNull())
    n, mean = F.sum("_w"), F.sum(F.col(value) * F.col("_w")) / F.sum("_w")
    square = F.sum(F.col(value) * F.col(value) * F.col("_w")) / F.sum("_w")
    return d.groupBy(*key).agg(
        n.cast("long").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std")
    )


def episode_offsets(df: DataFrame, episode: str, parts: int = 256) -> DataFrame:
    """Where each episode's rows start and end in the concatenation by episode: rows, start, end.

    Episodes are cut into ``parts`` ranges of about as many episodes each, however
    sparse their ids are; the ranges' bounds and totals are at most ``parts`` numbers.
    A running sum runs within each range.
    """
    per = df.groupBy(episode).agg(F.count("*").alias("rows"))
    points = F.percentile_approx(episode, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 100 * parts)
    # Asked for once, so that both uses below cut alike.
    bounds = sorted(set(per.agg(points.alias("p")).first().p or []))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(episode))) if bounds else F.lit(0)
    d = per.withColumn("_b", place)
    totals = d.groupBy("_b").agg(F.sum("rows").alias("_t")).agg(F.collect_list(F.struct("_b", "_t")).alias("_all"))
    lower = lambda r: F.aggregate(F.filter("_all", lambda x: x["_b"] < r["_b"]), F.lit(0).cast("long"), lambda s, x: s + x["_t"])
    base = totals.select(F.explode(F.transform("_all", lambda r: F.struct(r["_b"].alias("_b"), lower(r).alias("_base")))).alias("_r")).select("_r.*")
    inside = F.sum("rows").over(Window.partitionBy("_b").orderBy(episode))
    end = F.col("_in") + F.col("_base")
    out = d.withColumn("_in", inside).join(F.broadcast(base), "_b")
    return out.select(episode, "rows", (end - F.col("rows")).alias("start"), end.alias("end"))


def one_shard(df: DataFrame, episode: str, shard: str) -> DataFrame:
    """Whether every episode lies in one shard only: episode, shards, ok."""
    d = df.groupBy(episode).agg(F.countDistinct(shard).alias("shards"))
    return d.withColumn("ok", F.col("shards") == 1)


def action_is_next_state(df: DataFrame, key: list[str], order: list[str], action: str, state: str, tolerance: float) -> DataFrame:
    """Rows of each key whose action differs from the next state: steps, wrong, largest difference."""
    w = in_order(key, *order)
    d = df.withColumn("_off", F.abs(F.col(action) - F.lead(state).over(w)))
    return d.groupBy(*key).agg(F.count("_off").alias("steps"), F.count_if(F.col("_off") > tolerance).alias("wrong"), F.max("_off").alias("most"))


def scattered(values: Column, places: list[int], size: int) -> Column:
    """An array of ``size`` with the values at their places and 0 elsewhere."""
    where = {p: i for i, p in enumerate(places)}
    return F.array(*[values[where[i]] if i in where else F.lit(0.0) for i in range(size)])


def gathered(values: Column, places: list[int]) -> Column:
    """The values at the places, in order; the inverse of :func:`scattered`."""
    return F.array(*[values[p] for p in places])


def rigid_inverse(m: Column) -> Column:
    """The inverse of a rigid 4 by 4 transform, given row by row as 16 numbers."""
    at = lambda r, c: m[4 * r + c]
    move = [-(at(0, r) * m[3] + at(1, r) * m[7] + at(2, r) * m[11]) for r in range(3)]
    rows = [x for r in range(3) for x in (at(0, r), at(1, r), at(2, r), move[r])]
    return F.array(*rows, *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def composed(a: Column, b: Column) -> Column:
    """The product of two 4 by 4 transforms."""
    cell = lambda r, c: sum((a[4 * r + k] * b[4 * k + c] for k in range(1, 4)), a[4 * r] * b[c])
    return F.array(*[cell(r, c) for r in range(4) for c in range(4)])


def packed_grid(values: Column, rows: int, columns: int, low: float, high: float) -> Column:
    """A grid given row by row, clamped and transposed (column by column); null unless it has every cell."""
    clamp = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double")))
    out = F.array(*[clamp(values[r * columns + c]) for c in range(columns) for r in range(rows)])
    return F.when(F.size(values) == rows * columns, out)


def state_mask(places: list[int], size: int) -> Column:
    """1 at the places that a state vector uses, else 0."""
    return F.array(*[F.lit(int(i in set(places))) for i in range(size)])


def canonical_links(df: DataFrame, name: str, value: str, key: list[str], order: list[str], shown: bool = False) -> DataFrame:
    """Each key's values by name in canonical order: values (null where a name is absent, or 0 if ``shown``) and unknown names, which make a row unusable (ok)."""
    d = df.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("_m"))
    pick = [F.coalesce(F.try_element_at("_m", F.lit(n)), F.lit(0.0 if shown else None).cast("double")) for n in order]
    unknown = F.array_sort(F.array_except(F.map_keys("_m"), F.array(*map(F.lit, order))))
    return d.select(*key, F.array(*pick).alias("values"), unknown.alias("unknown")).withColumn("ok", F.size("unknown") == 0)


def rebuilt_actions(frames: DataFrame, states: DataFrame, commands: DataFrame, key: list[str], frame: str, t: str, measured: str, row: str, command: str) -> DataFrame:
    """Observations and actions as a release should have them: key, frame, observed, action.

    ``observed`` are the states' numbers on the line between the samples around the
    frame's clock; an action is the next frame's such numbers with the command at the next
    frame's ``row`` behind them. A recording's last frame has no action and goes; numbers
    outside the states' extent and commands that are not there make their array null.
    """
    near = bracket(frames, states, key, t, [measured])
    span = F.col("next.rt") - F.col("prev.rt")
    part = F.when(span > 0, (F.col(t) - F.col("prev.rt")) / span).otherwise(0.0)
    line = F.zip_with(F.col(f"prev.{measured}"), F.col(f"next.{measured}"), lambda a, b: a + (b - a) * part)
    d = near.withColumn("observed", line).join(commands.select(*key, row, F.col(command).alias("_c")), [*key, row], "left")
    w = in_order(key, frame)
    d = d.withColumn("_more", F.lead(F.lit(True)).over(w)).withColumn("action", F.lead(F.concat("observed", "_c")).over(w))
    return d.where("_more").select(*key, frame, "observed", "action")


def action_errors(rebuilt: DataFrame, published: DataFrame, key: list[str], frame: str, action: str, tolerance: float) -> DataFrame:
    """Published against rebuilt actions: key, frames, missing, extra, off (beyond ``tolerance`` or of another length), most, first_off (the smallest frame).

    An action that is null on one side only is off, one that is null on both is not; a number that is unknown within an action is off.
    """
    a, b = (d.select(*key, frame, F.struct(F.col(action).alias("x")).alias(n)) for d, n in ((rebuilt, "_a"), (published, "_b")))
    d = a.join(b, [*key, frame], "full")
    gap = F.array_max(F.zip_with(F.col("_a.x"), F.col("_b.x"), lambda x, y: F.coalesce(F.abs(x - y), F.lit(float("inf")))))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    wrong = both & F.coalesce(gap > tolerance, ~F.col("_a.x").eqNullSafe(F.col("_b.x")))
    d = d.withColumn("_gap", F.when(both, gap)).withColumn("_off", F.coalesce(wrong, F.lit(False)))
    return d.groupBy(*key).agg(
        F.count("*").alias("frames"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"),
        F.count_if("_off").alias("off"), F.max("_gap").alias("most"), F.min(F.when(F.col("_off"), F.col(frame))).alias("first_off"),
    )
