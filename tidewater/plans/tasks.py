"""Single tasks' analytics over events, and encoders over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import clock, tasks
from tidewater.plans.cohorts import TRIALS_SQL, trials
from tidewater.plans.registry import query, samples, table
from tidewater.plans.time import HELD_SQL, HOUR

K, BY = ["k"], ["t", "id"]


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.gap_aware(samples(spark, sf_dir), K, "t", "id")


@query(f"""WITH {HELD_SQL}, a AS (SELECT k, id, t, v, id % 50 / 10.0::DOUBLE AS slip, coalesce(lag(gap) OVER w, false) AS late, v > 100 AS on_ FROM g WINDOW w AS (PARTITION BY k ORDER BY t, id)),
b AS (SELECT *, CASE WHEN NOT late THEN t - lag(t) OVER w END AS dt, lag(on_) OVER w AND NOT on_ AND NOT late AS loss, lag(slip) OVER w AS ps,
  sum(CASE WHEN on_ IS NOT DISTINCT FROM false AND NOT late THEN 0 ELSE 1 END) OVER w AS oi, sum(CASE WHEN slip > 1 AND NOT late THEN 0 ELSE 1 END) OVER w AS si FROM a WINDOW w AS (PARTITION BY k ORDER BY t, id)),
e AS (SELECT *, CASE WHEN on_ IS NOT DISTINCT FROM false THEN t - min(CASE WHEN on_ IS NOT DISTINCT FROM false THEN t END) OVER (PARTITION BY k, oi ORDER BY t, id) END AS out_, CASE WHEN slip > 1 THEN t - min(CASE WHEN slip > 1 THEN t END) OVER (PARTITION BY k, si ORDER BY t, id) END AS sl FROM b)
SELECT k, round(sum(v * dt) / 3.6e9, 3) AS impulse, count(*) FILTER (loss) AS losses, max(out_) AS longest_out, round(sum(0.5 * (slip + ps) * dt) / 3.6e9, 4) AS slip, min(t) FILTER (sl >= {4 * HOUR}) AS sustained FROM e GROUP BY k""")
def finger_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = held(spark, sf_dir).withColumn("slip", F.col("id") % 50 / 10.0)
    d = tasks.finger_telemetry(s, K, BY, "t", "v", "slip", "gap", 100.0, 1.0, 4 * HOUR)
    return d.withColumn("impulse", F.round(F.col("impulse") / 3.6e9, 3)).withColumn("slip", F.round(F.col("slip") / 3.6e9, 4))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS load, CAST(l_discount AS DOUBLE) AS mu, 2000.0 * l_tax AS lim FROM lineitem),
y AS (SELECT *, CASE WHEN mu > 0 THEN load / (mu * 2) END AS low FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(low, 4) AS low, round(CASE WHEN lim >= low THEN lim - low END, 4) AS width FROM y""")
def pressure_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, width = tasks.pressure_window(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), 2000.0 * F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(low, 4).alias("low"), F.round(width, 4).alias("width"))


@query(TRIALS_SQL + """, g AS (SELECT cust % 500 AS lot, count(*) AS runs, count(success) AS known, count(*) FILTER (success) AS successes, max(price) AS worst FROM tr GROUP BY ALL)
SELECT lot, runs, known, successes, worst, round(CASE WHEN known > 0 THEN successes / known END, 6) AS rate, coalesce(runs >= 3 AND known = runs AND successes / nullif(known, 0) >= 0.5 AND worst <= 450000, false) AS qualified FROM g""")
def seed_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tasks.qualified(trials(spark, sf_dir).withColumn("lot", F.col("cust") % 500), ["lot"], "success", "price", 3, 0.5, 450000.0)
    return d.withColumn("rate", F.round("rate", 6))


@query("""WITH d AS (SELECT s_suppkey AS k, 0.01 * (1 + s_nationkey % 3) AS rx, 0.01::DOUBLE AS ry, 0.3::DOUBLE AS rz, unnest(range(0, 29)) AS c FROM supplier),
u AS (SELECT *, CASE WHEN c = 0 THEN 'nominal' WHEN c <= 8 THEN 'corner' ELSE 'uniform' END AS kind, [CASE WHEN (c - 1) // 4 % 2 = 1 THEN 1 ELSE -1 END, CASE WHEN (c - 1) // 2 % 2 = 1 THEN 1 ELSE -1 END, CASE WHEN (c - 1) % 2 = 1 THEN 1 ELSE -1 END] AS corner,
  list_transform(['x', 'y', 'z'], lambda n: 2 * (('0x' || substr(sha256('11:' || k || ':' || c || ':' || n), 1, 8))::BIGINT / 4294967296.0::DOUBLE) - 1) AS drawn FROM d),
f AS (SELECT *, CASE kind WHEN 'nominal' THEN [0.0, 0, 0]::DOUBLE[] WHEN 'corner' THEN corner::DOUBLE[] ELSE drawn END AS s FROM u)
SELECT k AS s_suppkey, CAST(c AS BIGINT) AS "case", kind, round(s[1] * rx, 9) AS x, round(s[2] * ry, 9) AS y, round(s[3] * rz, 9) AS z, ('0x' || substr(sha256('11:' || k || ':' || c), 1, 8))::BIGINT AS case_seed FROM f""")
def randomised_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """29 cases of every supplier, whose nation sets one of the ranges."""
    ranges = {"x": 0.01 * (1 + F.col("s_nationkey") % 3), "y": F.lit(0.01), "z": F.lit(0.3)}
    d = tasks.cases(table(spark, sf_dir, "supplier"), "s_suppkey", ranges, 20, 11)
    return d.withColumns({c: F.round(c, 9) for c in ("x", "y", "z")})


@query(f"""WITH {HELD_SQL}, a AS (SELECT k, id, t, v, coalesce(v > 60, false) AS c, coalesce(lag(gap) OVER w, false) AS late FROM g WINDOW w AS (PARTITION BY k ORDER BY t, id)),
b AS (SELECT *, sum(CASE WHEN c THEN CASE WHEN late THEN 1 ELSE 0 END ELSE 1 END) OVER (PARTITION BY k ORDER BY t, id) AS i FROM a),
hh AS (SELECT *, CASE WHEN c THEN t - min(CASE WHEN c THEN t END) OVER (PARTITION BY k, i ORDER BY t, id) END AS held FROM b),
f AS (SELECT k, min(t - held) AS start FROM hh WHERE held >= {2 * HOUR} GROUP BY k)
SELECT k, arg_min(id, id) AS id, arg_min(v, id) AS v FROM hh JOIN f USING (k) WHERE t = start AND c GROUP BY k""")
def stage_start_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.stage_start(held(spark, sf_dir), K, BY, "t", F.col("v") > 60, "gap", 2 * HOUR).select("k", "id", "v")


@query("""WITH a AS (SELECT vec_id, vec_id % 63 / 10.0::DOUBLE AS r, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
SELECT vec_id, round(cos(r) * (x - 1) + sin(r) * (y - 2), 5) AS x, round(-sin(r) * (x - 1) + cos(r) * (y - 2), 5) AS y, round(z - 3, 5) AS z FROM a""")
def camera_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as poses, seen from a camera at (1, 2, 3) that is turned about z."""
    e, r, zero, one = F.col("embedding"), F.col("vec_id") % 63 / 10.0, F.lit(0.0), F.lit(1.0)
    at = [e[i].cast("double") for i in range(3)]
    pose = F.array(one, zero, zero, at[0], zero, one, zero, at[1], zero, zero, one, at[2], zero, zero, zero, one)
    camera = F.array(F.cos(r), -F.sin(r), zero, one, F.sin(r), F.cos(r), zero, F.lit(2.0), zero, zero, one, F.lit(3.0), zero, zero, zero, one)
    seen = table(spark, sf_dir, "embeddings").select("vec_id", tasks.in_camera(F.array(pose), camera)[0].alias("p"))
    return seen.select("vec_id", *[F.round(F.col("p")[4 * i + 3], 5).alias(n) for i, n in enumerate("xyz")])


@query("""WITH x AS (SELECT generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE label % 3 <> 0)
SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, round(min(x), 6) AS least, round(max(x), 6) AS most, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x GROUP BY pos""")
def train_only_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions merged; statistics of what the split assigns to training."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    split = e.select("label").distinct().withColumn("split", F.when(F.col("label") % 3 != 0, "train").otherwise("validation"))
    d = tasks.train_statistics([e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")], split, "label", "embedding")
    return d.select("pos", *[F.round(c, 6).alias(c) if c != "n" else F.col(c) for c in d.columns if c != "pos"])


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN '/old/' ELSE '/elsewhere/' END || page_id || '.html' AS path, sha256(html) AS digest FROM pages),
m AS (SELECT page_id, CASE WHEN page_id % 6 <> 0 THEN digest ELSE sha256(digest) END AS d FROM p WHERE page_id % 10 <> 0)
SELECT p.page_id, coalesce(page_id % 4 <> 0 AND m.d = p.digest, false) AS moved, CASE WHEN coalesce(page_id % 4 <> 0 AND m.d = p.digest, false) THEN '/new/site/' || page_id || '.html' ELSE path END AS path FROM p LEFT JOIN m USING (page_id)""")
def relocated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose path moves, if the manifest knows their digest."""
    i, digest = F.col("page_id"), F.sha2("html", 256)
    name = F.concat(i.cast("string"), F.lit(".html"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.when(i % 4 != 0, "/old/").otherwise("/elsewhere/"), name).alias("path"), digest.alias("digest"))
    m = table(spark, sf_dir, "pages").where(i % 10 != 0).select(name.alias("path"), F.when(i % 6 != 0, digest).otherwise(F.sha2(digest, 256)).alias("digest"))
    return tasks.relocated(p, m, "path", "digest", "/old/", "/new/site/").select("page_id", "moved", "path")
