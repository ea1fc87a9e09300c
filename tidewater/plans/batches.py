"""Batch queries: orders are reports of trials, market segments batches, priorities cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import batches
from tidewater.plans.registry import query, table

#: Messages of failed trials, by a number of the order.
MESSAGES = ("Arm ik failed at waypoint", "the hand IK diverged", "object fell below the table", "normal force EXCEEDED 20 N", "Hand struck the wall", "no such device")

REPORT_SQL = """WITH o AS (SELECT o_orderkey AS i, o_custkey AS cust, o_orderpriority AS level, o_totalprice AS price, o_orderstatus AS s, c_mktsegment AS batch FROM orders JOIN customer ON o_custkey = c_custkey),
rep AS (SELECT *, CASE WHEN i % 41 = 0 THEN 'disk full' ELSE '' END AS record_error, CASE i % 9 WHEN 0 THEN ['slip', NULL] WHEN 1 THEN ['slip', 'force'] WHEN 2 THEN NULL ELSE [] END AS events,
  CASE WHEN i % 37 = 0 THEN false WHEN i % 5 <> 0 THEN true END AS physics_valid, CASE s WHEN 'F' THEN 'success' WHEN 'P' THEN 'task_not_completed' ELSE 'error' END AS status, s = 'F' AND i % 7 <> 0 AS success,
  ['request_limit', 'guard', 'fatal_error', 'other', NULL][1 + (i // 3) % 5] AS stop_reason, ['Arm ik failed at waypoint', 'the hand IK diverged', 'object fell below the table', 'normal force EXCEEDED 20 N', 'Hand struck the wall', 'no such device', NULL][1 + (i // 5) % 7] AS error,
  i % 13 <> 0 OR cust % 2 = 0 AS formal, CASE WHEN i % 11 <> 0 THEN i % 3 <> 0 END AS started FROM o WHERE i % 17 <> 0 OR batch = 'MACHINERY'),
t AS (SELECT *, list_filter(events, lambda x: x IS NOT NULL)[-1] AS kind FROM rep),
e AS (SELECT *, CASE WHEN record_error <> '' THEN 'record_error' WHEN NOT physics_valid THEN coalesce(kind, 'physics_invalid') WHEN status = 'success' AND success THEN 'success' WHEN stop_reason = 'request_limit' THEN 'request_limit'
  WHEN status = 'task_not_completed' THEN 'time_limit' WHEN stop_reason = 'guard' THEN coalesce(kind, 'guard') WHEN stop_reason = 'fatal_error' THEN 'fatal_error' WHEN lower(error) LIKE '%arm ik failed%' THEN 'arm_ik_guard'
  WHEN lower(error) LIKE '%hand ik%' THEN 'hand_ik_guard' WHEN lower(error) LIKE '%fell below%' THEN 'object_dropped' WHEN lower(error) LIKE '%force exceeded%' THEN 'force_guard' WHEN lower(error) LIKE '%hand struck%' THEN 'collision_guard' ELSE 'infrastructure_or_contract_error' END AS termination,
  CASE WHEN record_error <> '' OR NOT coalesce(physics_valid, true) THEN false WHEN (status = 'success' AND success) OR coalesce(stop_reason = 'request_limit', false) OR status = 'task_not_completed' OR coalesce(stop_reason = 'guard', false) THEN true
  WHEN stop_reason = 'fatal_error' THEN false ELSE coalesce(regexp_matches(lower(error), 'arm ik failed|hand ik|fell below|force exceeded|hand struck'), false) END AS counts FROM t)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned trials: i, cust, level, price, s, batch."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("batch"))
    d = o.join(c, "o_custkey")
    return d.select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("level"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("s"), "batch")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the orders, but for every 17th (of machinery all)."""
    d, i, s = orders(spark, sf_dir), F.col("i"), F.col("s")
    one = lambda n, *texts: F.array(*[F.lit(x) for x in texts])[(F.floor(i / n) % len(texts)).cast("int")]
    kinds = lambda *names: F.array(*[F.struct(F.lit(n).cast("string").alias("kind")) for n in names])
    nothing = F.array().cast("array<struct<kind:string>>")
    events = F.when(i % 9 == 0, kinds("slip", None)).when(i % 9 == 1, kinds("slip", "force")).when(i % 9 != 2, nothing)
    return d.where((i % 17 != 0) | (F.col("batch") == "MACHINERY")).select(
        "*", F.when(i % 41 == 0, "disk full").otherwise("").alias("record_error"), events.alias("events"), F.when(i % 37 == 0, False).when(i % 5 != 0, True).alias("physics_valid"),
        F.when(s == "F", "success").when(s == "P", "task_not_completed").otherwise("error").alias("status"), ((s == "F") & (i % 7 != 0)).alias("success"),
        one(3, "request_limit", "guard", "fatal_error", "other", None).alias("stop_reason"), one(5, *MESSAGES, None).alias("error"),
        ((i % 13 != 0) | (F.col("cust") % 2 == 0)).alias("formal"), F.when(i % 11 != 0, i % 3 != 0).alias("started"),
    )


@query(REPORT_SQL + " SELECT i, termination, counts FROM e")
def trial_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each trial ended, and whether it counts."""
    return batches.ended(reports(spark, sf_dir), batches.endings()).select("i", "termination", "counts")


@query(REPORT_SQL + """, p AS (SELECT batch, level, count(*) AS planned FROM o GROUP BY ALL),
a AS (SELECT batch, level, count(*) AS n, count(*) FILTER (coalesce(started, true)) AS attempted, count(*) FILTER (counts) AS valid, count(*) FILTER (success AND counts) AS successes, count(*) FILTER (success) AS task_successes, bool_and(formal) AS formal FROM e GROUP BY ALL),
h AS (SELECT batch, level, string_agg(termination || '=' || n, ' ' ORDER BY termination) AS terminations FROM (SELECT batch, level, termination, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL)
SELECT batch, level, planned, coalesce(attempted, 0) AS attempted, coalesce(valid, 0) AS valid, coalesce(successes, 0) AS successes, coalesce(task_successes, 0) AS task_successes, round(CASE WHEN valid > 0 THEN successes / valid END, 6) AS rate,
coalesce(n = planned AND a.formal, false) AS formal, round(CASE WHEN n = planned AND a.formal AND valid > 0 THEN successes / valid END, 6) AS formal_rate, coalesce(terminations, '') AS terminations FROM p LEFT JOIN a USING (batch, level) LEFT JOIN h USING (batch, level)""")
def batch_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and priorities as batches; only where all trials are there and formal is there a formal rate."""
    d = batches.ended(reports(spark, sf_dir), batches.endings())
    out = batches.batch_summary(orders(spark, sf_dir), d, ["batch", "level"], "success", "formal", "started")
    said = F.array_join(F.transform(F.array_sort(F.map_entries("terminations")), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return out.withColumns({"rate": F.round("rate", 6), "formal_rate": F.round("formal_rate", 6), "terminations": said})


CELL_SQL = """WITH p AS (SELECT o_orderkey AS i, o_orderpriority AS level, o_orderkey % 3 AS kind FROM orders), r AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 19 = 0 THEN 'exception' WHEN o_orderkey % 5 = 0 THEN 'interrupted' ELSE 'completed' END AS status,
  o_orderstatus = 'F' AND o_orderkey % 19 <> 0 AS success, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice < 300000 END AS quality, CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS stage, CASE WHEN o_totalprice >= 300000 THEN ['load', 'load', 'slip'] WHEN o_orderkey % 7 = 0 THEN NULL ELSE [] END AS violations FROM orders WHERE o_orderkey % 11 <> 0),
j AS (SELECT p.*, r.* EXCLUDE (i), r.i IS NOT NULL AS here, r.i IS NOT NULL AND status <> 'interrupted' AS done FROM p LEFT JOIN r USING (i))"""


def planned_and_reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, i, price = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    planned = o.select(i.alias("i"), F.col("o_orderpriority").alias("level"), (i % 3).alias("kind"))
    failed = F.col("o_orderstatus") != "F"
    found = o.where(i % 11 != 0).select(
        i.alias("i"), F.when(i % 19 == 0, "exception").when(i % 5 == 0, "interrupted").otherwise("completed").alias("status"), (~failed & (i % 19 != 0)).alias("success"),
        F.when(i % 7 != 0, price < 300000).alias("quality"), F.when(i % 19 != 0, price).alias("price"), F.when(failed, F.col("o_orderstatus")).alias("stage"),
        F.when(price >= 300000, F.array(*map(F.lit, ("load", "load", "slip")))).when(i % 7 != 0, F.array().cast("array<string>")).alias("violations"),
    )
    return planned, found


@query(CELL_SQL + """ SELECT level, kind, count(*) AS planned, count(*) FILTER (here) AS reported, count(*) FILTER (NOT here) AS unstarted, count(*) FILTER (here AND NOT done) AS interrupted, count(*) FILTER (status = 'exception') AS exceptions, count(*) FILTER (done) AS evaluated,
count(*) FILTER (done AND success) AS successes, count(*) FILTER (done AND quality) AS quality, count(*) FILTER (done AND success AND quality) AS qualified, round(min(price) FILTER (done), 2) AS price_least, round(avg(price) FILTER (done), 2) AS price_mean, round(max(price) FILTER (done), 2) AS price_most,
round(CASE WHEN count(*) FILTER (done) > 0 THEN count(*) FILTER (done AND success) / count(*) FILTER (done) END, 6) AS successes_rate, round(CASE WHEN count(*) FILTER (done) > 0 THEN count(*) FILTER (done AND quality) / count(*) FILTER (done) END, 6) AS quality_rate,
round(CASE WHEN count(*) FILTER (done) > 0 THEN count(*) FILTER (done AND success AND quality) / count(*) FILTER (done) END, 6) AS qualified_rate FROM j GROUP BY level, kind""")
def experiment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned cells with every denominator, exceptions counted."""
    d = batches.cells(*planned_and_reported(spark, sf_dir), ["i"], ["level", "kind"], ["price"])
    return d.withColumns({c: F.round(c, 6) for c in d.columns if c.endswith("_rate")}).withColumns({c: F.round(c, 2) for c in d.columns if c.startswith("price_")})


@query(CELL_SQL + """ SELECT level, kind, 'stage' AS histogram, stage AS value, count(*) AS n FROM j WHERE done AND NOT success GROUP BY ALL
UNION ALL SELECT level, kind, 'violations', value, count(*) FROM (SELECT level, kind, unnest(violations) AS value FROM j WHERE done) GROUP BY level, kind, value""")
def experiment_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of failed stages and of broken quality rules."""
    return batches.failures(*planned_and_reported(spark, sf_dir), ["i"], ["level", "kind"], ["stage"], ["violations"])
