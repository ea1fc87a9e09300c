"""Poses and their motion: an event's value and id are a place and a turn, embeddings are quaternions."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import rotations
from tidewater.operators import trajectories
from tidewater.plans.registry import query, samples, table
from tidewater.plans.time import HOUR

LIMITS = {"speed": 0.5, "spin": 0.3, "acceleration": 0.4, "velocity_residual": 0.6, "spin_residual": 0.25}
MOTION_SQL = f"""{{samples}}, a AS (SELECT k, id, t, ch, v / 100 AS x, CAST(id % 7 AS DOUBLE) AS y, (id % 628) / 100.0::DOUBLE AS a, v IS NOT NULL AS known FROM s),
b AS (SELECT *, (t - lag(t) OVER w) / {HOUR}.0::DOUBLE AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, a - lag(a) OVER w AS da, coalesce(ch <> lag(ch) OVER w, false) AS changed FROM a WINDOW w AS (PARTITION BY k ORDER BY t, id)),
c AS (SELECT *, CASE WHEN dt > 0 AND dx IS NOT NULL THEN dx / dt END AS vx, CASE WHEN dt > 0 AND dx IS NOT NULL THEN dy / dt END AS vy, CASE WHEN dt > 0 THEN (da - {2 * pi} * round(da / {2 * pi})) / dt END AS w FROM b),
d AS (SELECT *, CASE WHEN dt > 0 THEN last_value(CASE WHEN dt > 0 THEN {{'vx': vx, 'vy': vy, 'dt': dt}} END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS q FROM c),
m AS (SELECT k, id, t, ch, changed, sqrt(vx * vx + vy * vy) AS speed, abs(w) AS spin, sqrt((vx - q.vx) ** 2 + (vy - q.vy) ** 2) / ((dt + q.dt) / 2) AS acceleration, sqrt((0.1 - vx) ** 2 + vy * vy) AS velocity_residual, abs(0.05 - w) AS spin_residual FROM d),
e AS (SELECT k, id, t, ch, changed, unnest([{', '.join(f"{{'metric': '{n}', 'value': {n}, 'most': {limit}}}" for n, limit in LIMITS.items())}], recursive := true) FROM m)"""


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    a = F.col("id") % 628 / 100.0
    # Twice a unit quaternion: lengths do not matter.
    quaternion = F.array(2 * F.cos(a / 2), F.lit(0.0), F.lit(0.0), 2 * F.sin(a / 2))
    s = s.withColumn("place", F.array(F.col("v") / 100, (F.col("id") % 7).cast("double"), F.lit(0.0))).withColumn("turn", quaternion)
    s = s.withColumn("rate", F.array(F.lit(0.1), F.lit(0.0), F.lit(0.0))).withColumn("turning", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.05)))
    return trajectories.motion(s, ["k"], "t", "id", "place", "turn", HOUR, "rate", "turning")


@query(f"""WITH {MOTION_SQL} SELECT k, metric, count(*) AS samples, round(max(value), 6) AS most, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
count(*) FILTER (value > e.most) AS candidates FROM e WHERE value IS NOT NULL GROUP BY k, metric""")
def trajectory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, _ = trajectories.screened(moved(spark, sf_dir), ["k"], "t", "id", "ch", LIMITS)
    return told.select(*[F.round(c, 6).alias(c) if c in ("most", "p50", "p95", "p99") else F.col(c) for c in told.columns])


@query(f"""WITH {MOTION_SQL} SELECT k, metric, CAST(rank AS INTEGER) AS rank, t, round(round(value, 9), 6) AS value, ch AS phase, changed FROM
(SELECT *, row_number() OVER (PARTITION BY k, metric ORDER BY round(value, 9) DESC, t, id) AS rank FROM e WHERE value > most) WHERE rank <= 20""")
def trajectory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest candidates of each user and metric; values equal to nine places are ties."""
    d = moved(spark, sf_dir)
    d = d.select(*[F.round(c, 9).alias(c) if c in LIMITS else F.col(c) for c in d.columns])
    _, found = trajectories.screened(d, ["k"], "t", "id", "ch", LIMITS)
    return found.withColumn("value", F.round("value", 6))


@query("""WITH {samples}, d AS (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY id) AS d FROM s)
SELECT k, count(*) AS rows, count(*) FILTER (d = 0) AS standing, count(*) FILTER (d < 0) AS backward FROM d GROUP BY k""")
def trajectory_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.clock_faults(samples(spark, sf_dir), ["k"], "t", "id")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings),
n AS (SELECT vec_id, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q)) * CASE WHEN q[1] < 0 THEN -1 ELSE 1 END) AS q FROM e),
v AS (SELECT vec_id, q, sqrt(q[2] ** 2 + q[3] ** 2 + q[4] ** 2) AS s FROM n)
SELECT vec_id, round(q[2] / s * 2 * atan2(s, q[1]), 6) AS rx, round(q[3] / s * 2 * atan2(s, q[1]), 6) AS ry, round(q[4] / s * 2 * atan2(s, q[1]), 6) AS rz, round(2 * atan2(s, q[1]), 6) AS turn, true AS rigid, false AS mirrored, 1.0::DOUBLE AS nano FROM v""")
def rotation_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis times angle of quaternions, by matrices; whether these are rotations, and their mirror images; a billionth of a radian told in billionths."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", rotations.matrix(F.slice("embedding", 1, 4)).alias("m"))
    tiny = rotations.matrix(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(5e-10)))
    still = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    d = d.select("vec_id", "m", rotations.rotation_vector(F.col("m")).alias("r"))
    mirrored = F.transform(F.col("m"), lambda x: -x)
    return d.select(
        "vec_id", *[F.round(F.col("r")[i], 6).alias(n) for i, n in enumerate(("rx", "ry", "rz"))], F.round(rotations.angle(still, F.col("m")), 6).alias("turn"),
        rotations.is_rigid(F.col("m"), 1e-9).alias("rigid"), rotations.is_rigid(mirrored, 1e-9).alias("mirrored"), F.round(rotations.angle(still, tiny) * 1e9, 3).alias("nano"),
    )
