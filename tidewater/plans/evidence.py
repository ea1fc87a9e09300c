"""Contact-quality, scope and catalog queries over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import clock, evidence
from tidewater.plans.cohorts import TRIALS_SQL, trials
from tidewater.plans.registry import query, samples, table
from tidewater.plans.time import HELD_SQL, HOUR

K, BY = ["k"], ["t", "id"]
D_SQL = HELD_SQL + ", d AS (SELECT *, CASE WHEN gap THEN 0 ELSE dur END AS d FROM g)"


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.gap_aware(samples(spark, sf_dir), K, "t", "id")


@query(f"""WITH {D_SQL} SELECT k, CAST(sum(CASE WHEN v > 300 THEN d ELSE 0 END) AS BIGINT) AS over, round(sum(greatest(v - 300, 0) * d) FILTER (v IS NOT NULL) / 1e6, 2) AS excess,
CAST(sum(CASE WHEN v IS NOT NULL THEN d ELSE 0 END) AS BIGINT) AS known,
CASE WHEN coalesce(bool_or(v > 300), false) THEN 'fail' WHEN bool_and(v IS NOT NULL) THEN 'pass' ELSE 'unknown' END AS status FROM d GROUP BY k""")
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evidence.load_report(held(spark, sf_dir), K, "v", "dur", 300.0)
    return d.withColumn("excess", F.round(F.col("excess") / 1e6, 2))


@query(f"""WITH {D_SQL}, b AS (SELECT *, ch <> 'signup' AS want, v > 40 AS touch FROM d), wb AS (SELECT *, want AND coalesce(NOT touch, false) AS b FROM b),
i AS (SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t, id) AS i FROM wb), l AS (SELECT *, sum(CASE WHEN b THEN d ELSE 0 END) OVER (PARTITION BY k, i) AS l FROM i),
r AS (SELECT k, CAST(sum(CASE WHEN want THEN d ELSE 0 END) AS BIGINT) AS expected, CAST(sum(CASE WHEN want AND coalesce(touch, false) THEN d ELSE 0 END) AS BIGINT) AS touching,
CAST(sum(CASE WHEN want AND touch IS NULL THEN d ELSE 0 END) AS BIGINT) AS unknown, CAST(max(l) AS BIGINT) AS longest FROM l GROUP BY k)
SELECT *, CASE WHEN expected = 0 THEN 'unknown' WHEN longest > {12 * HOUR} THEN 'fail' WHEN unknown = 0 THEN 'pass' ELSE 'unknown' END AS status FROM r""")
def contact_interruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = held(spark, sf_dir).withColumn("want", F.col("ch") != "signup").withColumn("touch", F.col("v") > 40)
    return evidence.interruptions(d, K, BY, "want", "touch", "dur", 12 * HOUR)


@query(f"""WITH {D_SQL}, s2 AS (SELECT *, CASE WHEN NOT lag(gap) OVER w THEN v - lag(v) OVER w END AS st FROM d WINDOW w AS (PARTITION BY k ORDER BY t, id)),
r AS (SELECT k, round(sum(st), 4) AS change, count(st) AS steps, last(v ORDER BY t, id) AS final FROM s2 GROUP BY k)
SELECT *, CASE WHEN final IS NULL THEN 'unknown' WHEN final >= 50 THEN 'pass' ELSE 'fail' END AS status FROM r""")
def observed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.effects(held(spark, sf_dir), K, BY, "v", "gap", 50.0).withColumn("change", F.round("change", 4))


@query(f"""WITH {D_SQL}, x AS (SELECT *, CASE WHEN NOT gap THEN lead(v) OVER (PARTITION BY k ORDER BY t, id) - v END AS gain FROM d)
SELECT k, CAST(sum(CASE WHEN gain > 0 THEN d ELSE 0 END) AS BIGINT) AS with_progress, CAST(sum(CASE WHEN gain <= 0 THEN d ELSE 0 END) AS BIGINT) AS without_progress,
CAST(sum(CASE WHEN gain IS NULL THEN d ELSE 0 END) AS BIGINT) AS unknown FROM x WHERE ch = 'view' GROUP BY k""")
def contact_with_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = held(spark, sf_dir).withColumn("touch", F.col("ch") == "view")
    return evidence.contact_effect(d, K, BY, "touch", "v", "dur", 0.0, "gap")


@query("""WITH {samples}, x AS (SELECT k, max(v) FILTER (ch <> 'error') AS sampled, max(v) FILTER (ch = 'error') AS reported FROM s GROUP BY k)
SELECT k, sampled, reported, greatest(sampled, reported) AS peak, (sampled > 450) OR (reported > 450) AS exceeded FROM x""")
def threshold_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("ch") == "error"
    d = samples(spark, sf_dir).withColumn("a", F.when(~error, F.col("v"))).withColumn("b", F.when(error, F.col("v")))
    return evidence.safety(d, K, "a", "b", 450.0)


@query("""WITH {samples}, m AS (SELECT ch, k, max(v) AS v FROM s WHERE k % 2 = 1 GROUP BY ch, k), r AS (SELECT ch, max(v) - 480 AS r FROM s WHERE k % 2 = 0 GROUP BY ch)
SELECT ch, k, v, round(r, 4) AS reference, round(v - r, 4) AS delta, round(CASE WHEN r > 0 THEN v / r END, 4) AS ratio FROM m LEFT JOIN r USING (ch)""")
def reference_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    model = s.where(F.col("k") % 2 == 1).groupBy("ch", "k").agg(F.max("v").alias("v"))
    reference = s.where(F.col("k") % 2 == 0).groupBy("ch").agg((F.max("v") - 480).alias("v"))
    return evidence.compared(model, reference, ["ch"], "v").withColumns({c: F.round(c, 4) for c in ("reference", "delta", "ratio")})


@query("""WITH {samples}, x AS (SELECT ch, coalesce(v > 100, false) AS a, coalesce(v > 80 AND id % 3 <> 0, false) AS b FROM s),
c AS (SELECT ch, count(*) FILTER (a AND b) AS hits, count(*) FILTER (NOT a AND b) AS false_alarms, count(*) FILTER (a AND NOT b) AS misses FROM x GROUP BY ch)
SELECT *, round(CASE WHEN hits + false_alarms > 0 THEN hits / (hits + false_alarms) ELSE 0 END, 6) AS precision, round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 0 END, 6) AS recall,
round(CASE WHEN 2 * hits + false_alarms + misses > 0 THEN 2 * hits / (2 * hits + false_alarms + misses) ELSE 0 END, 6) AS f1 FROM c""")
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).withColumn("a", F.col("v") > 100).withColumn("b", (F.col("v") > 80) & (F.col("id") % 3 != 0))
    return evidence.detection_scores(d, ["ch"], "a", "b").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


SCOPES_SQL = """WITH {samples}, q AS (SELECT k, min(t) AS a, max(t) AS b FROM s GROUP BY k), sc AS (SELECT k, a, CASE WHEN k % 3 = 0 THEN b - 1 ELSE b END AS b, 'whole' AS scope FROM q),
u AS (SELECT sc.*, EXISTS (SELECT 1 FROM s WHERE s.k = sc.k AND s.t = sc.a) AND EXISTS (SELECT 1 FROM s WHERE s.k = sc.k AND s.t = sc.b) AS usable FROM sc)"""


def scopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = samples(spark, sf_dir)
    q = s.groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return s, q.withColumn("b", F.when(F.col("k") % 3 == 0, F.col("b") - 1).otherwise(F.col("b"))).withColumn("scope", F.lit("whole"))


@query(SCOPES_SQL + " SELECT k, a, b, scope, usable FROM u")
def scope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, sc = scopes(spark, sf_dir)
    return evidence.scope_gate(s, sc, K, "t", "a", "b")


@query(SCOPES_SQL + " SELECT s.k, s.id, scope FROM s JOIN u ON s.k = u.k AND usable AND t >= a AND t < b")
def scoped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, sc = scopes(spark, sf_dir)
    return evidence.scoped(s, sc, K, "t", "a", "b", "scope").select("k", "id", "scope")


@query(f"""WITH {{samples}}, e AS (SELECT k, min(t) AS a, max(t) AS b FROM s GROUP BY k), gr AS (SELECT k, a, b, unnest(range(a, b + 1, {24 * HOUR})) AS "at" FROM e)
SELECT k, "at", false AS anchor FROM gr WHERE abs("at" - a) > {HOUR} AND abs("at" - b) > {HOUR} UNION ALL SELECT k, a, true FROM e UNION ALL SELECT k, b, true FROM e WHERE b <> a""")
def display_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.display_clock(samples(spark, sf_dir), K, "t", 24 * HOUR, HOUR)


@query("""WITH {samples} SELECT CASE ch WHEN 'view' THEN 'thumb' WHEN 'click' THEN 'index' ELSE ch END AS ch, ch IN ('view', 'click') AS known, count(*) AS n FROM s GROUP BY 1, 2""")
def canonical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evidence.renamed(samples(spark, sf_dir), "ch", {"view": "thumb", "click": "index"})
    return d.groupBy("ch", "known").agg(F.count("*").alias("n"))


@query("""WITH {samples}, x AS (SELECT k, abs(v - lag(v) OVER w) - 0.01 * ((t - lag(t) OVER w) / 1e6) AS x FROM s WINDOW w AS (PARTITION BY k ORDER BY t, id))
SELECT k, count(x) AS steps, count(*) FILTER (x > 0) AS over, round(max(x), 4) AS worst FROM x GROUP BY k""")
def slew_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.slew(samples(spark, sf_dir), K, BY, "t", "v", 0.01).withColumn("worst", F.round("worst", 4))


@query(TRIALS_SQL + " SELECT model, count(*) AS total, count(*) FILTER (task = '2-HIGH' AND outcome = 'pass') AS current FROM tr GROUP BY model")
def option_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.option_counts(trials(spark, sf_dir), "model", (F.col("task") == "2-HIGH") & (F.col("outcome") == "pass"))


@query("""SELECT 'Ckpt-' || s_suppkey || '-b' || s_nationkey AS name, 'ckpt-' || lpad(CAST(s_suppkey AS VARCHAR), 18, '0') || '-b' || lpad(CAST(s_nationkey AS VARCHAR), 18, '0') AS place FROM supplier""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Ckpt-"), F.col("s_suppkey").cast("string"), F.lit("-b"), F.col("s_nationkey").cast("string"))
    d = table(spark, sf_dir, "supplier").select(name.alias("name"))
    return d.withColumn("place", evidence.natural_order(F.col("name")))


@query("""SELECT n_nationkey, count(c_custkey) AS rows, count(c_custkey) > 0 AS covered FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500 GROUP BY 1""")
def coverage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 9500).select(F.col("c_nationkey").alias("n_nationkey"))
    return evidence.coverage_table(table(spark, sf_dir, "nation"), rich, "n_nationkey")


@query("""WITH {samples}, x AS (SELECT k, id, sum(CASE WHEN ch <> 'error' THEN coalesce(v, 0) ELSE 0 END) OVER w / 5000 AS a, sum(CASE WHEN ch <> 'error' THEN 1.0::DOUBLE ELSE 0 END) OVER w / 40 AS b FROM s WINDOW w AS (PARTITION BY k ORDER BY t, id))
SELECT k, id, round(1 - least(greatest(least(a, b), 0), 1), 6) AS remaining FROM x""")
def cleaning_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"work": (F.col("v"), 5000.0), "strokes": (F.lit(1), 40.0)}
    d = evidence.wiped_share(samples(spark, sf_dir), K, BY, F.col("ch") != "error", parts)
    return d.select("k", "id", F.round("remaining", 6).alias("remaining"))


@query(TRIALS_SQL + """ SELECT task, count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'fail') AS fail, count(*) FILTER (outcome = 'unknown') AS unknown FROM tr GROUP BY task""")
def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials(spark, sf_dir).groupBy("task").pivot("outcome", ["pass", "fail", "unknown"]).count()


@query(f"""WITH {{samples}}, e AS (SELECT k, min(t) AS a, max(t) AS b FROM s GROUP BY k), gr AS (SELECT k, a, b, unnest(range(a, b + 1, {24 * HOUR})) AS "at" FROM e),
base AS (SELECT k, "at", false AS anchor FROM gr WHERE abs("at" - a) > {2 * HOUR} AND abs("at" - b) > {2 * HOUR} UNION ALL SELECT DISTINCT k, unnest([a, b]), true FROM e),
sn AS (SELECT DISTINCT k, t AS "at" FROM s WHERE id % 40 = 0),
kept AS (SELECT * FROM base WHERE anchor OR NOT EXISTS (SELECT 1 FROM sn WHERE sn.k = base.k AND abs(sn."at" - base."at") <= {2 * HOUR}))
SELECT * FROM kept UNION ALL SELECT k, "at", true FROM sn WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.k = sn.k AND kept."at" = sn."at")""")
def anchored_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily display clock with some events as snapshots."""
    s = samples(spark, sf_dir)
    return evidence.anchored_clock(s, s.where(F.col("id") % 40 == 0).select("k", "t"), K, "t", 24 * HOUR, 2 * HOUR)
