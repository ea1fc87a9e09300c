"""Catalog building: members of groups, stage counts, metric means, archives against recomputation, definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.identity import identity
from tidewater.operators import aggregates, catalogs, cohorts, quantiles
from tidewater.plans.cohorts import STAGES_SQL, TRIALS_SQL, staged, trials
from tidewater.plans.registry import query, table
from tidewater.sources import tables

ORDERED_SQL = """, li AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN true WHEN 'N' THEN false END AS s, l_linenumber AS line FROM lineitem),
st AS (SELECT id, list(s ORDER BY line, s NULLS FIRST) AS stages FROM li GROUP BY id), j AS (SELECT tr.*, stages FROM tr JOIN st USING (id))"""


def in_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with the flags of their stages in order (R: reached, N: not, A: unknown); lines without a number come last."""
    s = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "N", False)
    of = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").isNull().alias("no"), F.col("l_linenumber").alias("i"), s.alias("x"))))
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(of, lambda r: r["x"]).alias("stages"))
    return trials(spark, sf_dir).join(per, "id")


@query(TRIALS_SQL + " SELECT cust, model, id, outcome FROM tr")
def flattened_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' groups of trials, flattened with the group's columns."""
    groups = trials(spark, sf_dir).groupBy("cust", "model").agg(F.collect_list(F.struct("id", "outcome")).alias("trials"))
    return catalogs.flattened(groups, ["cust", "model"], "trials")


@query(TRIALS_SQL + ORDERED_SQL + """, e AS (SELECT task, i - 1 AS stage, stages[i] AS s FROM j, range(1, 20) r(i) WHERE i <= len(stages) AND status = 'valid')
SELECT task, CAST(stage AS INTEGER) AS stage, count(*) AS members, count(s) AS known, count(*) FILTER (s) AS reached,
round(CASE WHEN count(s) > 0 THEN count(*) FILTER (s) / count(s) END, 6) AS rate FROM e GROUP BY task, stage""")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalogs.stage_counts(in_stages(spark, sf_dir), ["task"], "stages", F.col("status") == "valid")
    return d.withColumn("rate", F.round("rate", 6))


@query(TRIALS_SQL + ORDERED_SQL + """, e AS (SELECT task, model, outcome, i - 1 AS stage, stages[i] AS s FROM j, range(1, 20) r(i) WHERE i <= len(stages) AND status = 'valid')
SELECT task, model, CAST(stage AS INTEGER) AS stage, count(*) AS members, count(s) AS known, count(*) FILTER (s) AS reached,
round(CASE WHEN count(s) > 0 THEN count(*) FILTER (s) / count(s) END, 6) AS rate FROM e GROUP BY task, model, stage""")
def group_stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group summary's stages, by identity."""
    d = catalogs.stage_counts(in_stages(spark, sf_dir), ["task", "model"], "stages", F.col("status") == "valid")
    return d.withColumn("rate", F.round("rate", 6))


@query(TRIALS_SQL + """, m AS (SELECT task, unnest(['price', 'share']) AS metric, unnest([price, CASE WHEN success THEN price / 500000 END]) AS x FROM tr)
SELECT task, metric, round(avg(x), 4) AS mean, count(x) AS known, count(*) AS episodes FROM m GROUP BY task, metric""")
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("price"), F.col("price"), F.lit("share"), F.when(F.col("success"), F.col("price") / 500000))
    d = catalogs.metric_means(trials(spark, sf_dir).withColumn("m", m), ["task"], "m")
    return d.withColumn("mean", F.round("mean", 4))


@query("""WITH l AS (SELECT unnest(['size.price', 'size.lines.quantity', 'discount']) AS path, unnest([CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE), CAST(CASE WHEN l_linenumber > 1 THEN l_discount END AS DOUBLE)]) AS value FROM lineitem)
SELECT path, count(*) AS total, count(value) AS known, round(min(value), 4) AS min, round(max(value), 4) AS max,
round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS p75 FROM l GROUP BY path""")
def numeric_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.struct(F.col("l_extendedprice").alias("price"), F.struct(F.col("l_quantity").alias("quantity"), "l_returnflag").alias("lines")).alias("size"),
        F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("discount"),
    )
    d = quantiles.distribution(catalogs.numeric_leaves(li, []), ["path"], "value").drop("mean")
    return d.select("path", "total", "known", *[F.round(c, 4).alias(c) for c in ("min", "max", "p25", "median", "p75")])


@query(TRIALS_SQL + """, s AS (SELECT task, model, count(*) AS members, count(*) FILTER (status = 'valid') AS eligible FROM tr GROUP BY task, model),
a AS (SELECT task, model, members + CASE WHEN members % 5 = 0 THEN 1 ELSE 0 END AS members, eligible + CASE WHEN members % 3 = 0 THEN 1 ELSE 0 END AS eligible FROM s)
SELECT task, model, list_filter([CASE WHEN s.members <> a.members THEN 'members' END, CASE WHEN s.eligible <> a.eligible THEN 'eligible' END], lambda x: x IS NOT NULL) AS fields
FROM s JOIN a USING (task, model) WHERE s.members <> a.members OR s.eligible <> a.eligible""")
def recomputed_against_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive with planted errors against what the trials give."""
    now = trials(spark, sf_dir).groupBy("task", "model").agg(F.count("*").alias("members"), F.count_if(F.col("status") == "valid").alias("eligible"))
    wrong = lambda k: F.when(F.col("members") % k == 0, 1).otherwise(0)
    archived = now.select("task", "model", (F.col("members") + wrong(5)).alias("members"), (F.col("eligible") + wrong(3)).alias("eligible"))
    return catalogs.mismatched(now, archived, ["task", "model"])


@query(TRIALS_SQL + """ SELECT id, 'site' AS source, price > 400000 AS quarantined, status = 'valid' AND NOT price > 400000 AS countable FROM tr WHERE id % 2 = 0
UNION ALL SELECT id, 'touch', false, status = 'valid' FROM tr WHERE id % 2 = 1""")
def quarantine_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    sources = {"site": t.where(F.col("id") % 2 == 0), "touch": t.where(F.col("id") % 2 == 1)}
    d = catalogs.flagged_union(sources, {"site": F.col("price") > 400000}, F.col("status") == "valid")
    return d.select("id", "source", "quarantined", "countable")


@query(TRIALS_SQL + STAGES_SQL + """, g AS (SELECT task, model, cust % 100 AS checkpoint, count(DISTINCT definition) AS definitions, count(*) AS members FROM j GROUP BY ALL)
SELECT * FROM g WHERE definitions > 1""")
def definition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = staged(spark, sf_dir).withColumn("checkpoint", F.col("cust") % 100)
    return catalogs.definition_conflicts(d, ["task", "model", "checkpoint"], "definition")


@query(TRIALS_SQL + """, g AS (SELECT cust % 200 AS batch, CASE WHEN cust % 3 <> 0 THEN model ELSE 'one' END AS rule, success, price FROM tr)
SELECT batch, count(*) AS rows, count(DISTINCT rule) = 1 AS consistent, count(success) AS known,
round(CASE WHEN count(DISTINCT rule) = 1 AND count(success) > 0 THEN count(*) FILTER (success) / count(success) END, 6) AS rate,
round(CASE WHEN count(DISTINCT rule) = 1 THEN avg(price) END, 3) AS mean FROM g GROUP BY batch""")
def staged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("cust") % 3 != 0, F.col("model")).otherwise("one")
    d = trials(spark, sf_dir).withColumn("batch", F.col("cust") % 200).withColumn("rule", rule)
    return catalogs.batch_results(d, ["batch"], "rule", "success", "price").withColumns({"rate": F.round("rate", 6), "mean": F.round("mean", 3)})


@query(TRIALS_SQL + """, g AS (SELECT task, model, formal, count(*) AS members, count(success) AS known FROM tr GROUP BY ALL)
SELECT sha256('{"formal":' || CASE WHEN formal THEN 'true' ELSE 'false' END || ',"model":"' || model || '","task":"' || task || '"}') AS group_id, task, model, formal, members, known FROM g""")
def published_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups under an id of their whole identity."""
    d = trials(spark, sf_dir).groupBy("task", "model", "formal").agg(F.count("*").alias("members"), F.count("success").alias("known"))
    return d.select(identity(formal=F.col("formal"), model=F.col("model"), task=F.col("task")).alias("group_id"), *d.columns)


@query(TRIALS_SQL + """, f AS (SELECT task, unnest(list_filter([CASE WHEN success IS NULL THEN 'missing_outcome' END, CASE WHEN price > 440000 THEN 'missing_price' END, CASE WHEN price < 60000 THEN 'price_too_low' END], lambda x: x IS NOT NULL)) AS reason FROM tr)
SELECT task, reason, count(*) AS n FROM f GROUP BY task, reason""")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("price")
    missing = {"missing_outcome": F.col("success").isNull(), "missing_price": price > 440000}
    d = cohorts.classified(trials(spark, sf_dir), missing, {"price_too_low": price < 60000}, F.col("success"))
    return catalogs.reason_histogram(d, ["task"], "reasons")


@query(TRIALS_SQL + """, l AS (SELECT unnest(['task', 'model']) AS level, unnest([task, model]) AS name, success FROM tr)
SELECT level, name, count(*) AS members, count(success) AS known, count(*) FILTER (success) AS successes FROM l GROUP BY level, name""")
def task_policy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.level_rollup(trials(spark, sf_dir), ["task", "model"], "success")


@query(TRIALS_SQL + " SELECT task, min(id) AS first, count(*) AS rows FROM tr GROUP BY task")
def first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalogs.first_seen_order(trials(spark, sf_dir), "task", ["id"])
    return d.select("task", F.col("first.id").alias("first"), "rows")


@query(TRIALS_SQL + """, c AS (SELECT cust, CASE WHEN id % 3 <> 0 THEN CAST(cust % 7 + id % 2 AS INTEGER) - 1 END AS horizon FROM tr),
g AS (SELECT cust, count(DISTINCT horizon) AS n, min(horizon) AS v, count(*) FILTER (horizon <= 0) AS bad FROM c GROUP BY cust)
SELECT cust, CASE WHEN bad = 0 AND n = 1 THEN v END AS horizon, CASE WHEN bad > 0 THEN 'invalid' WHEN n = 0 THEN 'unknown' WHEN n = 1 THEN 'verified' ELSE 'conflict' END AS status FROM g""")
def horizon_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.when(F.col("id") % 3 != 0, (F.col("cust") % 7 + F.col("id") % 2).cast("int") - 1)
    return catalogs.checked_setting(trials(spark, sf_dir).withColumn("horizon", h), ["cust"], "horizon", F.col("horizon") > 0)


@query(TRIALS_SQL + """, a AS (SELECT task, model, avg(price) AS mean, count(success) AS known, count(*) FILTER (status = 'valid' AND cust % 9 = 0) AS eligible FROM tr GROUP BY task, model)
SELECT model, round(sum(mean * known) / sum(known), 4) AS value, CAST(sum(known) AS BIGINT) AS known FROM a WHERE known > 0 AND eligible > 0 GROUP BY model""")
def eligible_archive_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived means pooled over the groups that hold a trial whose stages may be judged."""
    ok = F.count_if((F.col("status") == "valid") & (F.col("cust") % 9 == 0))
    per = trials(spark, sf_dir).groupBy("task", "model").agg(F.avg("price").alias("mean"), F.count("success").alias("known"), ok.alias("eligible"))
    return cohorts.pooled_means(per.where(F.col("eligible") > 0), ["model"], "mean", "known").withColumn("value", F.round("value", 4))


@query(TRIALS_SQL + STAGES_SQL + " SELECT id, task FROM j WHERE model = 'MACHINERY' AND definition IN ('A,R', 'N')")
def suite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One suite, and of it the groups of chosen stage definitions."""
    d = cohorts.faceted(staged(spark, sf_dir), {"model": "MACHINERY"})
    return d.where(F.col("definition").isin("A,R", "N")).select("id", "task")


CLIP_SQL = """WITH x AS (SELECT label, vec_id % 3 AS run, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@query(CLIP_SQL + """ SELECT label, CAST(pos AS INTEGER) AS pos, count(*) AS n, count(*) FILTER (x > 0.1 OR x < -0.1) AS clipped, round(max(greatest(x - 0.1, -0.1 - x, 0)), 6) AS excess FROM x GROUP BY label, pos""")
def merged_clip_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of three runs, by stage (label) and joint, merged: the same as of all rows."""
    e = table(spark, sf_dir, "embeddings").withColumn("run", F.col("vec_id") % 3)
    runs = [aggregates.clip_counts(e.where(F.col("run") == i), ["label"], "embedding", -0.1, 0.1) for i in range(3)]
    d = catalogs.merged_clips(runs[0].unionByName(runs[1]).unionByName(runs[2]), ["label", "pos"])
    return d.withColumn("excess", F.round("excess", 6))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS outcome, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END END AS outcome, o_orderpriority AS task FROM orders WHERE o_orderkey % 2 = 0),
c AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS price, CASE WHEN o_orderkey % 13 = 0 THEN 'none' ELSE o_orderpriority END AS task FROM orders WHERE o_orderkey % 4 <> 3),
u AS (SELECT id, 0 AS n, 'trials' AS s, outcome, price, NULL AS task FROM a UNION ALL SELECT id, 1, 'batches', outcome, NULL, task FROM b UNION ALL SELECT id, 2, 'staged', NULL, price, task FROM c),
g AS (SELECT id, arg_min(struct_pack(outcome := outcome, price := price, task := task), n) AS f, arg_min(s, n) AS source, list(s ORDER BY n) AS sources, list_filter([CASE WHEN min(outcome) <> max(outcome) THEN 'outcome' END, CASE WHEN min(price) <> max(price) THEN 'price' END, CASE WHEN min(task) <> max(task) THEN 'task' END], lambda x: x IS NOT NULL) AS conflicts FROM u GROUP BY id)
SELECT id, f.outcome AS outcome, f.price AS price, f.task AS task, source, sources, conflicts FROM g""")
def unified_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from three sources with different columns and some other values."""
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.floor("o_totalprice").cast("long")
    a = o.where(i % 3 == 0).select(i.alias("id"), F.col("o_orderstatus").alias("outcome"), price.alias("price"))
    b = o.where(i % 2 == 0).select(i.alias("id"), F.when(i % 7 != 0, F.when(i % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("outcome"), F.col("o_orderpriority").alias("task"))
    c = o.where(i % 4 != 3).select(i.alias("id"), (price + F.when(i % 11 == 0, 1).otherwise(0)).alias("price"), F.when(i % 13 == 0, "none").otherwise(F.col("o_orderpriority")).alias("task"))
    return catalogs.unified({"trials": a, "batches": b, "staged": c}, ["id"])


@query(TRIALS_SQL + ORDERED_SQL + """, e AS (SELECT task, model, i, stages[i] AS s FROM j, range(1, 20) r(i) WHERE i <= len(stages) AND status = 'valid'),
r AS (SELECT task, model, 'stage_' || (i - 1) AS stage, CAST(count(s) AS VARCHAR) AS known, CAST(count(*) FILTER (s) AS VARCHAR) AS reached FROM e GROUP BY task, model, i),
t AS (SELECT DISTINCT task, model FROM tr)
SELECT task, model, stage, known, reached FROM t LEFT JOIN r USING (task, model)""")
def stage_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of each group as a map, made flat, published as CSV and read again."""
    d = catalogs.stage_counts(in_stages(spark, sf_dir), ["task", "model"], "stages", F.col("status") == "valid")
    entry = F.struct(F.concat(F.lit("stage_"), "stage").alias("k"), F.struct("known", "reached").alias("v"))
    maps = d.groupBy("task", "model").agg(F.map_from_entries(F.collect_list(entry)).alias("stages"))
    groups = trials(spark, sf_dir).select("task", "model").distinct().join(maps, ["task", "model"], "left")
    path = tables.scratch(spark, "stage-csv")
    tables.publish_csv(catalogs.stage_rows(groups, ["task", "model"], "stages"), path)
    return spark.read.option("header", True).csv(path)


@query(TRIALS_SQL + """, g AS (SELECT task, model, count(*) AS members, count(*) FILTER (status = 'valid') AS eligible, count(*) FILTER (status = 'valid' AND success IS NOT NULL) AS known, count(*) FILTER (status = 'valid' AND success) AS successes FROM tr GROUP BY task, model),
s AS (SELECT *, unnest(['all', CASE WHEN model = 'MACHINERY' THEN 'machinery' END, CASE WHEN task LIKE '1%' OR task LIKE '2%' THEN 'urgent' END]) AS selection FROM g),
n AS (SELECT unnest(['all', 'machinery', 'urgent', 'nothing']) AS selection), a AS (SELECT selection, count(*) AS groups, sum(members) AS members, sum(eligible) AS eligible, sum(known) AS known, sum(successes) AS successes FROM s GROUP BY selection)
SELECT selection, coalesce(groups, 0) AS groups, CAST(coalesce(members, 0) AS BIGINT) AS members, CAST(coalesce(eligible, 0) AS BIGINT) AS eligible, CAST(coalesce(known, 0) AS BIGINT) AS known, CAST(coalesce(successes, 0) AS BIGINT) AS successes,
round(successes / nullif(known, 0), 6) AS rate FROM n LEFT JOIN a USING (selection)""")
def selection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of several selections of groups, rates from the summed counts."""
    d = trials(spark, sf_dir).withColumn("ok", F.col("status") == "valid")
    groups = cohorts.group_summary(d, ["task", "model"], "ok", "success", "success").select("task", "model", "members", "eligible", F.col("native_known").alias("known"), F.col("native_success").alias("successes"))
    chosen = {"all": F.lit(True), "machinery": F.col("model") == "MACHINERY", "urgent": F.col("task").rlike("^[12]"), "nothing": F.col("task").isNull()}
    out = catalogs.selection_totals(groups, chosen, ["members", "eligible", "known", "successes"], {"rate": ("successes", "known")})
    return out.withColumn("rate", F.round("rate", 6))
