"""Reading, publishing and streaming: tables that are written, closed and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.numbers import micros
from tidewater.operators import reviews
from tidewater.functions.contracts import CONTRACTS
from tidewater.plans.registry import query, samples, table
from tidewater.plans.stages import LATE_SQL, hold_sql, latch_sql
from tidewater.plans.time import HOUR
from tidewater.sources import tables
from tidewater.streaming import records
from tidewater.streaming import stages as stream


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders published by status (written beside, read back, compared, renamed), then read by columns."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    path = tables.scratch(spark, "published")
    tables.publish(o, path, ["o_orderstatus"])
    return tables.read_columns(spark, path, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("SELECT region.r_regionkey AS key, r_name AS name, CAST(row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS line FROM region")
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as one file of JSON lines, read with line numbers."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    path = tables.scratch(spark, "lines")
    r.orderBy("key").coalesce(1).write.json(path)
    return tables.read_lines(spark, path, "key long, name string").select("key", "name", "line")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def manifest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what an authoritative manifest names, its number checked."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    manifest = o.where(F.col("o_orderkey") % 3 == 0).select("o_orderkey")
    return tables.published_only(o, manifest, ["o_orderkey"], manifest.count())


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN quality END AS q, CASE WHEN doc_id % 5 = 0 THEN toxic END AS x FROM labels WHERE doc_id % 4 <> 0), b AS (SELECT doc_id, quality + 10 AS q, toxic + 10 AS x FROM labels WHERE doc_id % 2 = 0)
SELECT doc_id, coalesce(a.q, b.q) AS q, coalesce(a.x, b.x) AS x FROM a FULL JOIN b USING (doc_id)""")
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, i = table(spark, sf_dir, "labels"), F.col("doc_id")
    a = lab.where(i % 4 != 0).select("doc_id", F.when(i % 3 != 0, F.col("quality")).alias("q"), F.when(i % 5 == 0, F.col("toxic")).alias("x"))
    b = lab.where(i % 2 == 0).select("doc_id", (F.col("quality") + 10).alias("q"), (F.col("toxic") + 10).alias("x"))
    return tables.merged_fields([a, b], ["doc_id"])


@query("""WITH d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0), b AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)
SELECT id, CAST(sum(n) AS BIGINT) AS batches FROM (SELECT id, 0 AS n FROM d UNION ALL SELECT id, 1 FROM b) GROUP BY id""")
def discovered_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials given by themselves and through two kinds of batches, each once."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    batch = lambda n: o.where(F.col("id") % n == 0).groupBy("c").agg(F.collect_list(F.struct("id")).alias("members"))
    return tables.discovered(o.where(F.col("id") % 5 == 0).select("id"), batch(2).unionByName(batch(7)), "members", ["id"])


@query("""WITH f AS (SELECT p_partkey % 40 AS episode, ['head', 'left', 'right'][1 + p_partkey % 3] AS camera, p_size AS bytes FROM part WHERE p_partkey % 9 <> 0)
SELECT CAST(episode AS BIGINT) AS episode, list_sort(list(DISTINCT camera)) AS cameras, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY episode""")
def episode_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of episodes and cameras; every ninth is named otherwise."""
    i, camera = F.col("p_partkey"), F.array(*map(F.lit, ("head", "left", "right")))[(F.col("p_partkey") % 3).cast("int")]
    name = F.when(i % 9 != 0, F.concat(F.lit("episode_"), (i % 40).cast("string"), F.lit("_"), camera, F.lit(".mp4"))).otherwise("notes.txt")
    files = table(spark, sf_dir, "part").select(name.alias("file"), F.col("p_size").cast("long").alias("bytes"))
    return tables.listing(files, "file", r"^episode_(\d+)_([a-z]+)\.mp4$", "bytes")


@query("""WITH c AS (SELECT p_partkey, list_filter(['right', 'head', 'left', CASE WHEN p_partkey % 11 = 0 THEN 'roof' END, CASE WHEN p_partkey % 7 = 0 THEN 'left' END], lambda x: x IS NOT NULL AND (x <> 'head' OR p_partkey % 5 <> 0)) AS c FROM part)
SELECT p_partkey, CASE WHEN len(list_distinct(c)) = len(c) AND NOT list_contains(c, 'roof') AND list_contains(c, 'head') THEN ['head', 'left', 'right'] END AS cameras FROM c""")
def canonical_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    c = F.array_compact(F.array(F.lit("right"), F.when(i % 5 != 0, "head"), F.lit("left"), F.when(i % 11 == 0, "roof"), F.when(i % 7 == 0, "left")))
    return table(spark, sf_dir, "part").select("p_partkey", tables.canonical_cameras(c, ["head", "left", "right"], "head").alias("cameras"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of samples: k, id, t, ch, v."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return e.select(
        F.col("user_id").cast("long").alias("k"), F.col("event_id").cast("long").alias("id"), micros(F.col("ts")).alias("t"), F.col("event_type").alias("ch"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("v"), "ts",
    )


@query("""WITH r AS (SELECT user_id AS k, event_id * 2 + j AS id, event_id AS e, j, event_id * 1000 - CASE WHEN event_id % 397 = 0 THEN 1000000000 ELSE 0 END + CASE WHEN event_id % 23 = 0 AND j = 1 THEN 1 ELSE 0 END AS t,
  event_id * 1000 - CASE WHEN event_id % 397 = 0 THEN 1000000000 ELSE 0 END - CASE WHEN event_id % 13 = 0 THEN 2000 ELSE 1000 END AS start, CASE WHEN event_id % 17 <> 0 THEN floor(value) END AS x FROM events, (VALUES (0), (1)) j(j) WHERE j = 0 OR event_id % 19 <> 0),
l AS (SELECT *, t < lag(t) OVER w AS back, lag(j) OVER w AS pj, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(t - start = 1000) OVER w AS pe FROM r WINDOW w AS (PARTITION BY k ORDER BY id)),
m AS (SELECT *, min(id) FILTER (back) OVER (PARTITION BY k) AS stop FROM l),
y AS (SELECT *, CASE WHEN id > stop THEN 'ended' WHEN id = stop THEN 'rewind' WHEN j = 0 THEN CASE WHEN t - start <> 1000 THEN 'inexact' WHEN x IS NULL THEN 'unknown' ELSE 'captured' END WHEN pj = 0 AND pt = t AND pe AND px IS NOT NULL THEN 'used' ELSE 'none' END AS why FROM m)
SELECT k, t, id, why, CASE WHEN why = 'used' THEN px END AS value, coalesce(sum(CASE WHEN why = 'used' THEN px * 1000 END) OVER (PARTITION BY k ORDER BY id), 0) AS total FROM y""")
def stream_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a capture of one step and its observation; some are twice as long, unobserved, late, unknown or go back."""
    e, i = event_stream(spark, sf_dir), F.col("id")
    base = i * 1000 - F.when(i % 397 == 0, 1_000_000_000).otherwise(0)
    both = F.when(i % 19 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = e.select("k", i.alias("e"), F.floor("v").cast("double").alias("x"), base.alias("b"), F.explode(both).alias("j"))
    off = lambda n, by: F.when(F.col("e") % n == 0, by)
    d = rows.select(
        "k", (F.col("e") * 2 + F.col("j")).alias("id"), (F.col("b") + F.when(F.col("j") == 1, F.coalesce(off(23, 1), F.lit(0))).otherwise(0)).alias("t"),
        (F.col("b") - off(13, 2000).otherwise(1000)).alias("start"), F.when(F.col("j") == 0, "capture").otherwise("observe").alias("kind"), "x",
    )
    return records.closed(records.captured_steps(d, "k", "id", "t", "start", "kind", "x", 1000), "captures")


@query(f"""WITH RECURSIVE {{samples}}, x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, id) AS p FROM s),
r AS (SELECT k, p, t, id, ch, t AS last, 'transition' AS why FROM x WHERE p = 1
UNION ALL SELECT x.k, x.p, x.t, x.id, x.ch, CASE WHEN x.ch <> r.ch OR x.t - r.last >= {6 * HOUR} THEN x.t ELSE r.last END, CASE WHEN x.ch <> r.ch THEN 'transition' WHEN x.t - r.last >= {6 * HOUR} THEN 'interval' END
FROM r JOIN x ON x.k = r.k AND x.p = r.p + 1)
SELECT k, t, id, ch AS state, why FROM r WHERE why IS NOT NULL""")
def stream_state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a stream's state, and a record every six hours without one, logged by a closed sink."""
    return records.closed(records.state_log(event_stream(spark, sf_dir), "k", "t", "id", "ch", 6 * HOUR), "state-log")


@query("""WITH {samples}, x AS (SELECT k, t, id, [lag(v, 2, f) OVER w, lag(v, 1, f) OVER w, v] AS history FROM (SELECT *, first(v) OVER (PARTITION BY k ORDER BY t, id) AS f FROM s) WINDOW w AS (PARTITION BY k ORDER BY t, id))
SELECT * FROM x""")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.closed(records.history_stream(event_stream(spark, sf_dir), "k", "t", "id", "v", 3), "history")


@query("""WITH {samples}, a AS (SELECT *, CASE WHEN ch = 'click' THEN 'stage' WHEN ch = 'view' THEN 'commit' ELSE 'other' END AS kind FROM s),
b AS (SELECT *, lag(kind) OVER w AS pk, lag(t) OVER w AS pt, lag(v) OVER w AS pv, lead(kind) OVER w AS nk FROM a WINDOW w AS (PARTITION BY k ORDER BY t, id)),
c AS (SELECT *, kind = 'commit' AND pk IS NOT DISTINCT FROM 'stage' AS done, kind = 'stage' AND nk IS NOT NULL AND nk <> 'commit' AS lost FROM b),
d AS (SELECT *, sum(CASE WHEN done THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN lost THEN 1 ELSE 0 END) OVER w AS l FROM c WINDOW w AS (PARTITION BY k ORDER BY t, id))
SELECT k, CAST(n AS BIGINT) AS step, pt AS t, pv AS value, CAST(l - coalesce(lag(l) OVER (PARTITION BY k ORDER BY n), 0) AS BIGINT) AS skipped FROM d WHERE done""")
def stream_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks stage a step, views commit it."""
    kind = F.when(F.col("ch") == "click", "stage").when(F.col("ch") == "view", "commit").otherwise("other")
    e = event_stream(spark, sf_dir).withColumn("kind", kind)
    return records.closed(records.committed_steps(e, "k", "t", "id", "kind", "v"), "commits")


@query(f"""WITH {{samples}}, d AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY k ORDER BY t, id) > {24 * HOUR}, false) AS late, row_number() OVER (PARTITION BY k ORDER BY t, id) AS p FROM s),
{hold_sql('d', 'x1', 'v > 60')}, {latch_sql('x1', 'l1', f'x1_h >= {2 * HOUR}')}, {hold_sql('l1', 'x2', 'v > 40')}, {latch_sql('x2', 'l2', f'x2_h >= {4 * HOUR} AND p >= l1_f')},
r AS (SELECT k, min(t) FILTER (p = l1_f) AS drag, min(t) FILTER (p = l2_f) AS grasp, count(*) AS samples, count(*) FILTER (late) AS gaps FROM l2 GROUP BY k)
SELECT k, drag, grasp, (drag IS NOT NULL)::INT + (grasp IS NOT NULL)::INT AS highest_stage, samples, gaps, CAST(0 AS BIGINT) AS rewinds FROM r""")
def stream_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a stream: the last report of each key."""
    program = [stream.StreamStage("drag", F.col("v") > 60, 2 * HOUR), stream.StreamStage("grasp", F.col("v") > 40, 4 * HOUR)]
    reports, path = stream.stage_stream(event_stream(spark, sf_dir), "k", "t", "id", 24 * HOUR, program), tables.scratch(spark, "stages")
    keep = lambda batch, number: batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)
    run = reports.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}-state").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    every = spark.read.parquet(path)
    last = every.groupBy("k").agg(F.max_by(F.struct(*reports.columns[1:]), "_batch").alias("r"))
    return last.select("k", "r.*")


@query(f"""WITH {LATE_SQL}, e AS (SELECT k, id, t // 3600 AS t, v, ch FROM b0), x AS (SELECT *, t - lag(t) OVER w AS dt, row_number() OVER w AS p, count(*) OVER (PARTITION BY k) AS n FROM e WINDOW w AS (PARTITION BY k ORDER BY t, id)),
md AS (SELECT k, quantile_cont(dt, 0.5) AS m FROM x GROUP BY k), b1 AS (SELECT x.*, coalesce(dt > 1.5 * m, false) AS late FROM x JOIN md USING (k)),
{hold_sql('b1', 'z', "v > 60 AND ch <> 'error'")}, {latch_sql('z', 'l1', 'z_h >= 2000000')},
r AS (SELECT k, min(t) FILTER (p = l1_f) AS extracted_and_held, bool_and(v IS NOT NULL AND NOT late AND coalesce(dt > 0, true)) AS covered, bool_or(p = n AND coalesce(v > 60 AND ch <> 'error', false)) AS fin FROM l1 GROUP BY k)
SELECT k, extracted_and_held, (extracted_and_held IS NOT NULL)::INT AS completed, false AS observed_failure, covered, CASE WHEN NOT covered THEN 'unknown' WHEN extracted_and_held IS NOT NULL AND fin THEN 'pass' ELSE 'fail' END AS status FROM r""")
def review_unplug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unplug contract over events: above 60 the plug is clear, errors are on the table, hours are seconds."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    d = samples(spark, sf_dir).select(
        "k", "id", F.floor(F.col("t") / 3600).cast("long").alias("t"), F.when(F.col("v") > 60, -0.01).when(F.col("v").isNotNull(), 0.1).alias("insertion_depth_m"),
        F.lit(0.0).alias("socket_contact_count"), one(F.col("ch") != "error").alias("right_hand_contact_count"), one(F.col("ch") == "error").alias("table_contact_count"),
    )
    c = CONTRACTS["usb-unplug"]
    return reviews.review(d, ["k"], "t", "id", "usb-unplug", c.digest, c.fields, F.lit(True), F.lit(True))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders")
def published_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "csv")
    tables.publish_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def inspected_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes of one scene with three cameras, of which ten succeeded at least."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit("desk").alias("scene"), F.array(*map(F.lit, ("head", "left", "right"))).alias("cameras"))
    o = o.withColumn("success", F.col("o_orderstatus") == "F")
    return tables.inspected(o, "scene", "cameras", ["head", "left"], "success", 10).select("o_orderkey", "o_orderstatus")
