"""Declared metrics over reports as JSON texts, and reports published as one set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import metrics
from tidewater.plans.cohorts import TRIALS_SQL, trials
from tidewater.plans.registry import query, table
from tidewater.sources import sets, tables

METRICS = metrics.declared([
    {"name": "price", "path": ["totals", "price"], "unit": "eur"},
    {"name": "load", "path": ["channels", "main", "load"], "unit": "N"},
    {"name": "age", "path": ["channels", "main", "age"], "unit": "s"},
])


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each order as text. Planted: a key twice (13), NaN (17), cut texts (19), numbers as texts (7), flags (9), stale blocks (5)."""
    i = F.col("o_orderkey")
    price, cust = F.col("o_totalprice").cast("double").cast("string"), F.col("o_custkey").cast("string")
    status = F.when(i % 5 == 0, ', "status": "stale"').when(i % 6 == 0, ', "status": null').otherwise(', "status": "available"')
    load = F.when(i % 7 == 0, F.concat(F.lit('"'), cust, F.lit('"'))).when(i % 9 == 0, "true").otherwise(cust)
    extra = F.when(i % 13 == 0, ', "load": 1').when(i % 17 == 0, ', "age": NaN').when(i % 4 == 0, ', "age": 1.5e1').otherwise("")
    whole = F.concat(F.lit('{"totals": {"price": '), price, F.lit('}, "channels": {"main": {"load": '), load, extra, status, F.lit("}}}"))
    text = F.when(i % 19 == 0, F.substring(whole, 1, 30)).when(i % 23 != 0, whole)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", text.alias("report"))


@query("""WITH o AS (SELECT o_orderkey AS i, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_custkey AS DOUBLE) AS cust FROM orders),
b AS (SELECT *, i % 13 = 0 OR i % 17 = 0 OR i % 19 = 0 OR i % 23 = 0 AS bad, CASE WHEN i % 5 = 0 THEN 'status_stale' WHEN i % 6 = 0 THEN 'status_unknown' END AS off FROM o),
m AS (SELECT i, o_orderstatus, 'price' AS metric, 'eur' AS unit, price AS x, CASE WHEN bad THEN 'document' END AS why FROM b
UNION ALL SELECT i, o_orderstatus, 'load', 'N', CASE WHEN i % 7 <> 0 AND i % 9 <> 0 THEN cust END, CASE WHEN bad THEN 'document' ELSE off END FROM b
UNION ALL SELECT i, o_orderstatus, 'age', 's', CASE WHEN i % 4 = 0 THEN 15.0 END, CASE WHEN bad THEN 'document' ELSE off END FROM b)
SELECT i AS o_orderkey, metric, unit, CASE WHEN why IS NULL THEN x END AS value, coalesce(why, CASE WHEN x IS NULL THEN 'missing' END) AS reason FROM m""")
def declared_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.measured(reports(spark, sf_dir), ["o_orderkey"], "report", METRICS)


@query("""WITH o AS (SELECT o_orderkey AS i, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS price FROM orders), b AS (SELECT *, i % 13 = 0 OR i % 17 = 0 OR i % 19 = 0 OR i % 23 = 0 AS bad FROM o)
SELECT o_orderstatus, 'price' AS metric, 'eur' AS unit, count(*) AS reports, count(*) FILTER (NOT bad) AS known, count(*) FILTER (bad) AS unreadable, round(avg(price) FILTER (NOT bad), 4) AS mean FROM b GROUP BY o_orderstatus""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.measured(reports(spark, sf_dir), ["o_orderkey", "o_orderstatus"], "report", METRICS[:1])
    return metrics.summary(d, ["o_orderstatus"]).withColumn("mean", F.round("mean", 4))


@query(TRIALS_SQL + """ SELECT 'trials' AS report, task, CAST(NULL AS VARCHAR) AS model, count(*) AS n FROM tr GROUP BY task
UNION ALL SELECT 'models', NULL, model, count(*) FILTER (status = 'valid') FROM tr GROUP BY model UNION ALL SELECT 'pairs', task, model, count(success) FROM tr GROUP BY task, model""")
def published_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reports published as one set, published again without effect, verified, and read by the manifest."""
    tr, path = trials(spark, sf_dir), tables.scratch(spark, "set")
    whole = {
        "trials": tr.groupBy("task").agg(F.lit(None).cast("string").alias("model"), F.count("*").alias("n")),
        "models": tr.groupBy(F.lit(None).cast("string").alias("task"), "model").agg(F.count_if(F.col("status") == "valid").alias("n")),
        "pairs": tr.groupBy("task", "model").agg(F.count("success").alias("n")),
    }
    first = sets.publish_set(whole, path)
    if sets.publish_set(whole, path) != first or sets.verify_set(spark, path):
        raise OSError(f"{path}: a repeated set differs")
    a, b, c = (d.select(F.lit(n).alias("report"), "task", "model", "n") for n, d in sets.read_set(spark, path).items())
    return a.unionByName(b).unionByName(c)
