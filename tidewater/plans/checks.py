"""Audits across streams, rotations, settings and samplers over the tables."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import maps, numbers, rotations
from tidewater.operators import asof, checks, clock, stages
from tidewater.operators.stages import Hold, Stage
from tidewater.plans.cohorts import TRIALS_SQL, trials
from tidewater.plans.registry import query, samples, table
from tidewater.plans.stages import LATE_SQL, hold_sql, latch_sql, report
from tidewater.plans.time import HELD_SQL, HOUR

K, BY = ["k"], ["t", "id"]


def doubles(i: int, n: int) -> str:
    return f"list_transform(embedding[{i}:{i + n - 1}], lambda x: CAST(x AS DOUBLE))"


@query(f"""WITH x AS (SELECT vec_id, label, {doubles(1, 3)} AS n, {doubles(4, 3)} AS d, {doubles(7, 8)} AS g FROM embeddings),
y AS (SELECT *, sqrt(list_dot_product(n, n)) AS nn, list_transform([1, 2, 3], lambda i: d[i] - n[i] * list_dot_product(n, d) / list_dot_product(n, n)) AS tt FROM x),
z AS (SELECT vec_id, label, vec_id % 7 <> 0 AS grid, vec_id % 5 <> 0 AS parts, vec_id % 11 <> 0 AS basis FROM y)
SELECT label, count(*) AS rows, count(*) FILTER (NOT grid) AS grid, count(*) FILTER (NOT parts) AS parts, count(*) FILTER (NOT basis) AS basis, CAST(0 AS BIGINT) AS projection FROM z GROUP BY label""")
def force_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forces made of parts of embeddings, with planted breaches in every seventh grid, fifth part and eleventh basis."""
    e, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    n, d = F.col("n"), F.col("d")
    e = e.select("vec_id", "label", part(1, 3).alias("n"), part(4, 3).alias("d"))
    along, norm = numbers.dot(n, d) / numbers.dot(n, n), F.sqrt(numbers.dot(n, n))
    e = e.withColumn("tangent", F.zip_with("d", "n", lambda x, y: x - y * along)).withColumn("norm", norm)
    grid = F.array_repeat(F.when(i % 7 == 0, F.col("norm") + 1).otherwise(F.col("norm")) / 8, 8)
    total = F.zip_with("n", "tangent", lambda x, y: x + y + F.when(i % 5 == 0, 0.5).otherwise(0.0))
    basis = F.array(F.when(i % 11 == 0, 2.0).otherwise(1.0), *map(F.lit, (0.0, 0.0, 0.0, 1.0, 0.0)))
    e = e.select("label", "n", "tangent", grid.alias("grid"), total.alias("total"), basis.alias("basis"))
    return checks.breaches(e, ["label"], checks.conservation(F.col("grid"), F.col("total"), F.col("n"), F.col("tangent"), F.col("basis"), 1e-6))


@query("""WITH {samples}, x AS (SELECT k, abs(CASE WHEN id % 23 = 0 THEN v ELSE 0.5 * lag(v) OVER w END - 0.5 * lag(v) OVER w) AS e FROM s WINDOW w AS (PARTITION BY k ORDER BY t, id))
SELECT k, count(e) AS rows, count(*) FILTER (e > 0.001) AS off, round(max(e), 6) AS worst, round(avg(e), 6) AS mean FROM x GROUP BY k""")
def actuator_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    measured = F.when(F.col("id") % 23 == 0, F.col("v")).otherwise(0.5 * F.lag("v").over(clock.in_order(K, *BY)))
    d = checks.aligned_forces(s.withColumn("m", measured), K, BY, "v", "m", 0.5, 0.001)
    return d.withColumns({c: F.round(c, 6) for c in ("worst", "mean")})


@query("""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 3 WHEN o_orderkey % 77 <> 0 THEN o_totalprice END AS price, o_custkey AS cust FROM orders WHERE o_orderkey % 40 <> 0),
b AS (SELECT o_orderkey AS id, o_totalprice AS price, o_custkey AS cust FROM orders WHERE o_orderkey % 33 <> 0),
j AS (SELECT a.id AS ai, b.id AS bi, unnest(['price', 'cust']) AS field, unnest([CAST(a.price AS DOUBLE), a.cust]) AS x, unnest([CAST(b.price AS DOUBLE), b.cust]) AS y FROM a FULL JOIN b USING (id))
SELECT field, count(*) AS rows, count(*) FILTER (ai IS NULL) AS missing, count(*) FILTER (bi IS NULL) AS extra, count(*) FILTER (ai IS NOT NULL AND bi IS NOT NULL AND (x IS NULL) <> (y IS NULL)) AS nulls,
count(*) FILTER (abs(x - y) > 0.5) AS off, round(max(abs(x - y)), 6) AS worst FROM j GROUP BY field""")
def export_against_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, price = F.col("id"), F.col("price")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))
    export = o.where(i % 40 != 0).withColumn("price", F.when(i % 50 == 0, price + 3).when(i % 77 != 0, price))
    return checks.against_source(export, o.where(i % 33 != 0), ["id"], ["price", "cust"], 0.5).withColumn("worst", F.round("worst", 6))


@query("""WITH a AS (SELECT page_id, sha256(html) AS h FROM pages WHERE page_id % 9 <> 0), b AS (SELECT page_id, CASE WHEN page_id % 8 = 0 THEN sha256(url) ELSE sha256(html) END AS h FROM pages WHERE page_id % 10 <> 0)
SELECT page_id, CASE WHEN b.h IS NULL THEN 'unrecorded' WHEN a.h IS NULL THEN 'lost' WHEN a.h = b.h THEN 'matched' ELSE 'changed' END AS status FROM a FULL JOIN b USING (page_id)""")
def provenance_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    now = p.where(i % 9 != 0).select("page_id", F.sha2("html", 256).alias("h"))
    then = p.where(i % 10 != 0).select("page_id", F.when(i % 8 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("h"))
    return checks.provenance(now, then, "page_id", "h")


@query(TRIALS_SQL + """, g AS (SELECT cust % 300 AS batch, count(*) AS trials, max(50) AS expected, count(*) FILTER (NOT coalesce(success IS NOT NULL, false)) AS a, count(*) FILTER (NOT coalesce(status <> 'invalid', false)) AS b, count(*) FILTER (NOT coalesce(price < 450000, false)) AS c FROM tr GROUP BY ALL)
SELECT batch, trials, CAST(expected AS INTEGER) AS expected, list_filter([CASE WHEN trials <> expected THEN 'count' END, CASE WHEN a > 0 THEN 'outcome' END, CASE WHEN b > 0 THEN 'valid' END, CASE WHEN c > 0 THEN 'price' END], lambda x: x IS NOT NULL) AS failed,
trials = expected AND a = 0 AND b = 0 AND c = 0 AS passed FROM g""")
def batch_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"outcome": F.col("success").isNotNull(), "valid": F.col("status") != "invalid", "price": F.col("price") < 450000}
    return checks.batch_assertions(trials(spark, sf_dir).withColumn("batch", F.col("cust") % 300), ["batch"], F.lit(50), rules)


@query("""WITH l AS (SELECT l_orderkey AS k, arg_max(l_returnflag = 'R', (l_linenumber, l_partkey, l_suppkey)) AS lifted, arg_max(l_linestatus = 'F', (l_linenumber, l_partkey, l_suppkey)) AS seated FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS lifted, o_orderkey % 2 = 0 AS seated FROM orders WHERE o_orderkey % 19 <> 0),
j AS (SELECT k, list_filter([CASE WHEN l.k IS NULL OR s.k IS NULL OR l.lifted IS DISTINCT FROM s.lifted THEN 'lifted' END, CASE WHEN l.k IS NULL OR s.k IS NULL OR l.seated IS DISTINCT FROM s.seated THEN 'seated' END], lambda x: x IS NOT NULL) AS differ FROM l FULL JOIN s USING (k))
SELECT k, differ, len(differ) = 0 AS agrees FROM j""")
def log_against_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("lifted"), (F.col("l_linestatus") == "F").alias("seated")
    )
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 19 != 0)
    summary = o.select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("lifted"), (F.col("o_orderkey") % 2 == 0).alias("seated"))
    return checks.log_against_summary(log, summary, ["k"], ["l_linenumber", "l_partkey", "l_suppkey"], ["lifted", "seated"])


@query("""WITH {samples}, x AS (SELECT k, ch = lag(ch) OVER w AS same, abs(v - lag(v) OVER w) AS moved FROM s WINDOW w AS (PARTITION BY k ORDER BY t, id))
SELECT k, count(*) FILTER (same) AS identical, count(*) FILTER (same AND moved > 100) AS suspect FROM x GROUP BY k""")
def suspect_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.suspect_repeats(samples(spark, sf_dir), K, BY, "ch", "v", 100.0)


@query(f"""WITH {{samples}}, n AS (SELECT *, CAST(ceil(t / {6 * HOUR}.0) AS BIGINT) AS n FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY k, n ORDER BY t, id) AS r FROM n)
SELECT k, id, n * {6 * HOUR} AS deadline FROM r WHERE r = 1""")
def sampler_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.deadlines(samples(spark, sf_dir), K, "t", "id", 6 * HOUR).select("k", "id", "deadline")


@query(f"""WITH {HELD_SQL}, d AS (SELECT k, v, CASE WHEN gap THEN 0 ELSE dur END AS d FROM g)
SELECT k, round(sum(v * d) / 3.6e9, 3) AS integral, round(CASE WHEN sum(d) FILTER (v IS NOT NULL) <> 0 THEN sum(v * d) / sum(d) FILTER (v IS NOT NULL) END / 500, 6) AS share, CAST(coalesce(sum(d) FILTER (v >= 250), 0) AS BIGINT) AS covered FROM d GROUP BY k""")
def area_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = checks.area_integrals(clock.gap_aware(samples(spark, sf_dir), K, "t", "id"), K, "dur", "v", 500.0, 0.5)
    return d.withColumn("integral", F.round(F.col("integral") / 3.6e9, 3)).withColumn("share", F.round("share", 6))


@query(f"""WITH x AS (SELECT vec_id, vec_id % 13 <> 0 OR vec_id % 10 = 0 AS known, CASE WHEN vec_id % 10 = 0 THEN [0.0, 0, 0]::DOUBLE[] ELSE {doubles(1, 3)} END AS a, {doubles(4, 3)} AS b FROM embeddings),
y AS (SELECT *, CASE WHEN known THEN sqrt(list_dot_product(a, a)) END AS na, sqrt(list_dot_product(b, b)) AS nb, CASE WHEN known THEN list_dot_product(a, b) END AS ab FROM x)
SELECT vec_id, na >= 0.025 AND nb >= 0.025 AND CASE WHEN na IS NOT NULL THEN coalesce(CASE WHEN na * nb > 1e-12 THEN ab / (na * nb) END <= 0.5, false) END AS grasp FROM y""")
def opposed_grasp(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.transform(F.slice("embedding", i, 3), lambda x: x.cast("double"))
    thumb = F.when(F.col("vec_id") % 10 == 0, F.array_repeat(F.lit(0.0), 3)).when(F.col("vec_id") % 13 != 0, part(1))
    d = table(spark, sf_dir, "embeddings").select("vec_id", thumb.alias("a"), part(4).alias("b"))
    return d.select("vec_id", checks.opposed_grasp(F.col("a"), F.col("b"), 0.025, 0.5).alias("grasp"))


@query(f"""WITH x AS (SELECT vec_id, {doubles(1, 4)} AS a, {doubles(5, 4)} AS b FROM embeddings),
n AS (SELECT vec_id, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS c FROM x)
SELECT vec_id, round(2 * acos(least(1, abs(c))), 5) AS angle, round(2 * acos(least(1, abs(c))), 5) AS again FROM n""")
def rotation_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles between two quaternions' rotations, by matrices, and once more through their 6-number forms."""
    part = lambda i: F.slice("embedding", i, 4)
    d = table(spark, sf_dir, "embeddings").select("vec_id", rotations.matrix(part(1)).alias("a"), rotations.matrix(part(5)).alias("b"))
    again = rotations.angle(rotations.from_six(rotations.six(F.col("a"))), rotations.from_six(rotations.six(F.col("b"))))
    return d.select("vec_id", F.round(rotations.angle(F.col("a"), F.col("b")), 5).alias("angle"), F.round(again, 5).alias("again"))


@query(f"""WITH {{samples}}, a AS (SELECT k, id, t, (id % 628) / 100.0::DOUBLE - {pi} AS r FROM s), b AS (SELECT *, r - lag(r) OVER (PARTITION BY k ORDER BY t, id) AS d FROM a),
c AS (SELECT k, r + 2 * {pi} * sum(coalesce(-floor((d + {pi}) / (2 * {pi})), 0)) OVER (PARTITION BY k ORDER BY t, id) AS u FROM b)
SELECT k, round(max(u) - min(u), 5) AS range FROM c GROUP BY k""")
def unwrapped_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an angle turned in all, from its unwrapped course (its peak to peak)."""
    s = samples(spark, sf_dir).withColumn("r", F.col("id") % 628 / 100.0 - pi)
    u = rotations.unwrapped(s, K, BY, "r", "u")
    return u.groupBy("k").agg(F.round(F.max("u") - F.min("u"), 5).alias("range"))


@query("""SELECT o_orderkey, o_custkey % 7 AS top, CASE WHEN o_orderkey % 3 = 0 THEN 'over' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE o_custkey % 5 END AS depth FROM orders""")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested settings merged, then read back by path."""
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    base = F.to_json(F.struct((c % 7).alias("top"), F.struct(F.col("o_orderstatus").alias("status"), F.struct((c % 5).alias("depth")).alias("deep")).alias("inner")))
    over = F.when(F.col("o_orderkey") % 3 == 0, F.lit('{"inner":{"status":"over","deep":{"depth":9}}}')).otherwise(F.lit("{}"))
    m = maps.deep_merge(base, over)
    return o.select(
        "o_orderkey", maps.path_get(m, "top", "long").alias("top"), maps.path_get(m, "inner.status", "string").alias("status"), maps.path_get(m, "inner.deep.depth", "long").alias("depth")
    )


@query("""SELECT event_id, event_type AS kept, round(CASE WHEN event_id % 4 <> 0 THEN greatest(0, least(1, value * 0.001 / (0.1 * (event_id % 4)))) END, 6) AS shown FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_id, NULL, round(CASE WHEN event_id % 4 <> 0 THEN greatest(0, least(1, value * 0.001 / (0.1 * (event_id % 4)))) END, 6) FROM events WHERE event_type NOT IN ('click', 'view')""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in display units on a clamped scale, and of a map only what is allowed to be shown."""
    m = maps.whitelisted(F.create_map(F.col("event_type"), F.col("event_type")), ["click", "view"])
    shown = maps.display(F.col("value"), 0.1 * (F.col("event_id") % 4), 0.001)
    return table(spark, sf_dir, "events").select("event_id", F.get(F.map_values(m), F.lit(0)).alias("kept"), F.round(shown, 6).alias("shown"))


@query(f"""WITH {LATE_SQL}, {hold_sql('b0', 'd', 'v > 60')}, {latch_sql('d', 'l1', f'd_h >= {2 * HOUR}')}, rep AS (SELECT k, min(t) FILTER (p = l1_f) AS picked_up, count(*) AS samples, count(*) FILTER (late) AS gaps FROM l1 GROUP BY k)
SELECT k, picked_up, CAST(CASE WHEN picked_up IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS highest_stage, CAST(NULL AS BOOLEAN) AS complete, CASE WHEN picked_up IS NULL THEN 'picked_up' END AS failure_stage, samples, gaps FROM rep""")
def stage_whiteboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whiteboard: the only stage is the pickup, and completion is never claimed."""
    d = report(spark, sf_dir, [Stage("picked_up", (Hold(lambda _: F.col("v") > 60, 2 * HOUR),))])
    return d.withColumn("success", F.lit(None).cast("boolean")).withColumnRenamed("success", "complete")


TELEMETRY_SQL = f"""WITH {{samples}}, f AS (SELECT k, id, t, t // {24 * HOUR} AS cell FROM s WHERE ch = 'view'), r AS (SELECT *, row_number() OVER (PARTITION BY k, cell ORDER BY t, id) AS r FROM f),
q AS (SELECT k, t, arg_max(v, id) AS v, max(id) AS i FROM s WHERE ch = 'click' AND v IS NOT NULL GROUP BY k, t), sc AS (SELECT k, greatest(1.0, quantile_cont(abs(v), 0.99)) AS scale FROM s WHERE ch = 'click' GROUP BY k)"""


@query(TELEMETRY_SQL + """ SELECT f.k, f.id, q.v AS load, round((f.t - q.t) / 1000.0, 3) AS age_ms, round(CASE WHEN q.v IS NOT NULL THEN least(1, greatest(0, q.v / scale)) END, 5) AS share
FROM (SELECT * FROM r WHERE r = 1) f ASOF LEFT JOIN q ON f.k = q.k AND f.t >= q.t LEFT JOIN sc ON sc.k = f.k""")
def telemetry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame a day with the latest load before it, its age, and its share of the 99th percentile."""
    s = samples(spark, sf_dir)
    frames = s.where(F.col("ch") == "view").withColumn("cell", F.floor(F.col("t") / (24 * HOUR)))
    frames = frames.withColumn("r", F.row_number().over(clock.in_order(["k", "cell"], *BY))).where(F.col("r") == 1).select("k", "id", "t")
    loads = s.where((F.col("ch") == "click") & F.col("v").isNotNull()).select("k", "t", F.col("id").alias("i"), F.col("v").alias("load"))
    scale = s.where(F.col("ch") == "click").groupBy("k").agg(F.greatest(F.lit(1.0), F.percentile(F.abs("v"), F.lit(0.99))).alias("scale"))
    d = asof.asof_backward(frames, loads, K, "t", ["i", "load"], tie="i").join(scale, "k", "left")
    return d.select("k", "id", "load", F.round(F.col("age") / 1000.0, 3).alias("age_ms"), F.round(maps.display(F.col("load"), F.col("scale")), 5).alias("share"))
