"""Scopes of sampled predicates and the algebra of interval sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import intervals
from tidewater.plans.registry import query, samples
from tidewater.plans.time import HOUR, K

#: Keys divisible by 11 have a sample without a time; those by 7 one that stands still.
CLOCK_SQL = """{samples}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, id) AS p FROM s),
x AS (SELECT k, id, p, CASE WHEN k % 11 = 0 AND p = 2 THEN NULL WHEN k % 7 = 0 AND p = 3 THEN lag(t) OVER (PARTITION BY k ORDER BY p) ELSE t END AS t, v > 60 AS loaded, CASE WHEN ch <> 'error' THEN ch = 'click' END AS clicked FROM o),
y AS (SELECT *, lead(t) OVER w - t AS dur FROM x WINDOW w AS (PARTITION BY k ORDER BY p)),
m AS (SELECT k, bool_or(t IS NULL OR coalesce(dur <= 0, false)) AS bad, 1.5 * quantile_cont(dur, 0.5) AS cut FROM y GROUP BY k),
z AS (SELECT y.*, bad, NOT bad AND coalesce(dur <= cut, false) AS ok FROM y JOIN m USING (k)),
e AS (SELECT *, 'loaded' AS name, loaded AS c FROM z UNION ALL SELECT *, 'clicked', clicked FROM z)"""


def observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    w = Window.partitionBy("k").orderBy("t", "id")
    d = samples(spark, sf_dir).withColumn("p", F.row_number().over(w)).withColumn("before", F.lag("t").over(w))
    at = F.when((F.col("k") % 11 == 0) & (F.col("p") == 2), None).when((F.col("k") % 7 == 0) & (F.col("p") == 3), F.col("before")).otherwise(F.col("t"))
    return d.withColumn("t", at), {"loaded": F.col("v") > 60, "clicked": F.when(F.col("ch") != "error", F.col("ch") == "click")}


@query(f"""WITH {CLOCK_SQL}, r AS (SELECT *, p - row_number() OVER (PARTITION BY k, name ORDER BY p) AS run FROM e WHERE ok AND c)
SELECT k, name, min(t) AS start, max(t + dur) AS "end", count(*) AS samples, CAST(row_number() OVER (PARTITION BY k, name ORDER BY min(t)) AS INTEGER) AS place FROM r GROUP BY k, name, run""")
def predicate_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, predicates = observed(spark, sf_dir)
    return intervals.predicate_scopes(d, K, "t", ["p"], predicates)


@query(f"""WITH {CLOCK_SQL}, a AS (SELECT k, name, count(*) AS samples, count(c) FILTER (NOT bad) AS known, count(*) FILTER (NOT bad AND c) AS positive,
CAST(coalesce(sum(dur) FILTER (ok AND c IS NOT NULL), 0) AS BIGINT) AS known_time, CAST(coalesce(sum(dur) FILTER (ok AND c), 0) AS BIGINT) AS observed_time,
CASE WHEN NOT bool_or(bad) AND count(*) > 1 THEN max(t) - min(t) END AS span, bool_or(bad) AS bad FROM e GROUP BY k, name)
SELECT * EXCLUDE (bad), round(CASE WHEN span <> 0 THEN known_time / span END, 6) AS coverage, known = samples AND coalesce(known_time = span, false) AS "full",
CASE WHEN positive > 0 THEN 'observed' WHEN known > 0 THEN 'not_observed' ELSE 'missing' END AS status, CASE WHEN bad THEN 'clock' WHEN known = 0 THEN 'unknown' END AS reason FROM a""")
def predicate_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, predicates = observed(spark, sf_dir)
    return intervals.predicate_availability(d, K, "t", ["p"], predicates).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {{samples}}, a AS (SELECT k, t AS x, t + {30 * HOUR} AS y FROM s WHERE ch = 'click'), b AS (SELECT k, t AS x, t + {20 * HOUR} AS y FROM s WHERE ch = 'view'),
z AS (SELECT k, min(t) AS x, max(t) AS y FROM s GROUP BY k HAVING min(t) < max(t)),
g AS (SELECT k, x AS p FROM a UNION SELECT k, y FROM a UNION SELECT k, x FROM b UNION SELECT k, y FROM b UNION SELECT k, x FROM z UNION SELECT k, y FROM z),
c AS (SELECT k, p, lead(p) OVER (PARTITION BY k ORDER BY p) AS q FROM g),
n AS (SELECT c.*, EXISTS (SELECT 1 FROM a WHERE a.k = c.k AND a.x <= p AND a.y > p) AS ina, EXISTS (SELECT 1 FROM b WHERE b.k = c.k AND b.x <= p AND b.y > p) AS inb,
  EXISTS (SELECT 1 FROM z WHERE z.k = c.k AND z.x <= p AND z.y > p) AS inz FROM c WHERE q IS NOT NULL),
o AS (SELECT 'both' AS part, k, p, q, ina AND inb AS i FROM n UNION ALL SELECT 'first', k, p, q, ina AND NOT inb FROM n UNION ALL SELECT 'either', k, p, q, ina OR inb FROM n UNION ALL SELECT 'neither', k, p, q, inz AND NOT ina AND NOT inb FROM n),
l AS (SELECT *, sum(CASE WHEN i THEN 0 ELSE 1 END) OVER (PARTITION BY part, k ORDER BY p) AS island FROM o)
SELECT part, k, min(p) AS x, max(q) AS y FROM l WHERE i GROUP BY part, k, island""")
def interval_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 hours from each click against 20 hours from each view: both, the first only, either, and neither within the record."""
    s = samples(spark, sf_dir)
    held = lambda ch, hours: s.where(F.col("ch") == ch).select("k", F.col("t").alias("x"), (F.col("t") + hours * HOUR).alias("y"))
    a, b, extent = held("click", 30), held("view", 20), s.groupBy("k").agg(F.min("t").alias("x"), F.max("t").alias("y"))
    either = intervals.united(a, b, K, "x", "y")
    parts = {"both": intervals.intersected(a, b, K, "x", "y"), "first": intervals.subtracted(a, b, K, "x", "y"), "either": either, "neither": intervals.subtracted(extent, either, K, "x", "y")}
    tagged = [d.select(F.lit(n).alias("part"), "k", "x", "y") for n, d in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])
