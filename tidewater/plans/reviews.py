"""Reviews under contracts, over events: a trial is a user's events, evenly spaced unless it is about gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.contracts import CONTRACTS
from tidewater.operators import reviews
from tidewater.plans.registry import query, samples
from tidewater.plans.stages import LATE_SQL, hold_sql

K = ["k"]
STEP = 100_000
#: Unknown values stay in every third trial only.
EVEN_SQL = f"""e AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY t, id) AS p, CASE WHEN k % 3 = 0 THEN v ELSE coalesce(v, 30.0) END AS v FROM s),
b AS (SELECT *, p * {STEP} AS t, false AS late, count(*) OVER (PARTITION BY k) AS n FROM e)"""


def even(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("k").orderBy("t", "id"))
    v = F.when(F.col("k") % 3 == 0, F.col("v")).otherwise(F.coalesce("v", F.lit(30.0)))
    return samples(spark, sf_dir).withColumn("v", v).withColumn("t", place.cast("long") * STEP)


def reviewed(d: DataFrame, task: str, **gates: object) -> DataFrame:
    c = CONTRACTS[task]
    return reviews.review(d, K, "t", "id", task, c.digest, c.fields, F.lit(True), F.lit(True), **gates)


@query(f"""WITH {{samples}}, {EVEN_SQL}, a AS (SELECT *, CASE WHEN id % 401 = 0 THEN -5.0 ELSE v / 5000 END AS a FROM b),
c AS (SELECT *, CASE WHEN a BETWEEN 0 AND 1 THEN (a + a / 2) / 2 <= 0.05 AND a <= 0.10 END AS ok FROM a),
r AS (SELECT k, min(t) FILTER (ok) AS clean, bool_and(ok IS NOT NULL) AND k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AS covered, bool_or(p = n AND coalesce(ok, false)) AS fin FROM c GROUP BY k)
SELECT k, clean, (clean IS NOT NULL)::INT AS completed, false AS observed_failure, covered, CASE WHEN NOT covered THEN 'unknown' WHEN clean IS NOT NULL AND fin THEN 'pass' ELSE 'fail' END AS status FROM r""")
def review_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wiping contract: dirt below zero is outside its domain; some trials are not final, not sound, or contradict themselves."""
    a = F.when(F.col("id") % 401 == 0, -5.0).otherwise(F.col("v") / 5000)
    d = even(spark, sf_dir).select("k", "id", "t", F.array(a, a / 2).alias("dirt_remaining"))
    return reviewed(d, "vase-wipe", finalised=F.col("k") % 7 != 0, physics_valid=F.col("k") % 11 != 0, conflicting=F.col("k") % 13 == 0)


@query(f"""WITH {{samples}}, {EVEN_SQL}, c AS (SELECT *, CASE WHEN v <= 30 THEN false WHEN v IS NOT NULL AND id % 397 <> 0 THEN true END AS near, v >= 120 AS load, v > 1 AS support FROM b),
{hold_sql('c', 'x', 'near AND load')}, i AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY p) AS run FROM x),
y AS (SELECT *, coalesce(near, false) AND coalesce(max(coalesce(x_h >= 400000, false)) OVER (PARTITION BY k, run ORDER BY p), false) AS bottom FROM i),
{hold_sql('y', 'z', 'near AND (bottom OR support)')}, q AS (SELECT *, coalesce(z_h >= 300000, false) AND bottom AS ok FROM z),
r AS (SELECT k, min(t) FILTER (bottom) AS bottom_out, min(t) FILTER (ok) AS stable_seating, max(CASE WHEN p = n THEN CASE WHEN ok THEN 2 WHEN bottom THEN 1 ELSE 0 END END) AS completed,
  bool_and(near IS NOT NULL AND load IS NOT NULL) AS covered, bool_or(p = n AND coalesce(near, false)) AS fin FROM q GROUP BY k)
SELECT k, bottom_out, stable_seating, completed, false AS observed_failure, covered, CASE WHEN NOT covered THEN 'unknown' WHEN completed = 2 AND fin THEN 'pass' ELSE 'fail' END AS status FROM r""")
def review_seating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seating contract: above 30 a module is near the bottom, its load is a hundredth, an error of orientation below zero is unknown."""
    deep = F.when(F.col("v") > 30, 0.006).when(F.col("v").isNotNull(), 0.0)
    d = even(spark, sf_dir).select(
        "k", "id", "t", deep.alias("insertion_depth_m"), F.array(F.lit(0.0), F.lit(0.0)).alias("aperture_clearance_xy_m"),
        F.when(F.col("id") % 397 == 0, -0.001).otherwise(0.001).alias("orientation_error_rad"), F.lit(0.0).alias("maximum_socket_penetration_m"),
        F.lit(0.0).alias("linear_speed_m_s"), F.lit(0.0).alias("angular_speed_rad_s"), (F.col("v") / 100).alias("backstop_load_n"),
    )
    return reviewed(d, "install-ram")


UNPLUG_SQL = f"""{LATE_SQL}, e AS (SELECT k, id, t // 3600 AS t, v, ch FROM b0),
x AS (SELECT *, t - lag(t) OVER w AS d, row_number() OVER w AS p, count(*) OVER (PARTITION BY k) AS n FROM e WINDOW w AS (PARTITION BY k ORDER BY t, id)),
md AS (SELECT k, quantile_cont(d, 0.5) AS m FROM x GROUP BY k), b1 AS (SELECT x.*, coalesce(d > 1.5 * m, false) AS late FROM x JOIN md USING (k)),
u AS (SELECT k, id, t, p, n, late, 'fully_clear' AS name, v > 60 AS ok FROM b1 UNION ALL SELECT k, id, t, p, n, late, 'hand_held', ch <> 'error' FROM b1)"""


def unplugging(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return samples(spark, sf_dir).select(
        "k", "id", F.floor(F.col("t") / 3600).cast("long").alias("t"), F.when(F.col("v") > 60, -0.01).when(F.col("v").isNotNull(), 0.1).alias("insertion_depth_m"),
        F.lit(0.0).alias("socket_contact_count"), one(F.col("ch") != "error").alias("right_hand_contact_count"), one(F.col("ch") == "error").alias("table_contact_count"),
    )


@query(f"""WITH {UNPLUG_SQL} SELECT k, name, count(*) AS samples, count(ok) AS known, count(*) FILTER (ok) AS positive, round(count(ok) / count(*), 6) AS coverage,
CASE WHEN count(*) FILTER (ok) > 0 THEN 'observed' WHEN count(ok) > 0 THEN 'not_observed' ELSE 'missing' END AS status, coalesce(max(CASE WHEN p = n THEN ok::VARCHAR END), 'unknown') AS last FROM u GROUP BY k, name""")
def review_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = CONTRACTS["usb-unplug"]
    out = reviews.condition_coverage(unplugging(spark, sf_dir), K, "t", "id", "usb-unplug", c.fields, F.lit(True))
    return out.withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {UNPLUG_SQL}, i AS (SELECT *, sum(CASE WHEN coalesce(ok, false) AND NOT late THEN 0 ELSE 1 END) OVER (PARTITION BY k, name ORDER BY p) AS run FROM u)
SELECT k, name, min(t) AS start, max(t) AS "end", count(*) AS samples FROM i WHERE ok GROUP BY k, name, run""")
def review_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = CONTRACTS["usb-unplug"]
    return reviews.condition_intervals(unplugging(spark, sf_dir), K, "t", "id", "usb-unplug", c.fields, F.lit(True))
