"""Trial and catalog queries: orders are trials, priorities tasks, market segments models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import cohorts
from tidewater.plans.registry import query, table

TRIALS_SQL = """WITH tr AS (
  SELECT o_orderkey AS id, o_orderpriority AS task, c_mktsegment AS model, o_custkey AS cust, o_totalprice AS price,
         CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'unknown' END AS outcome,
         CASE WHEN o_totalprice < 60000 THEN 'invalid' WHEN o_totalprice > 440000 THEN 'missing' ELSE 'valid' END AS status,
         o_orderkey % 4 <> 0 AS formal, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS success
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment as trials."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    code, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("task"), F.col("c_mktsegment").alias("model"),
        F.col("o_custkey").alias("cust"), price.alias("price"),
        F.when(code == "F", "pass").when(code == "O", "fail").otherwise("unknown").alias("outcome"),
        F.when(price < 60000, "invalid").when(price > 440000, "missing").otherwise("valid").alias("status"),
        (F.col("o_orderkey") % 4 != 0).alias("formal"), F.when(code == "F", True).when(code == "O", False).alias("success"),
    )


@query(TRIALS_SQL + """, g AS (SELECT task, cust, count(*) AS trials, count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'fail') AS fail,
  count(*) FILTER (outcome = 'unknown') AS unknown, count(DISTINCT model) AS configurations FROM tr GROUP BY task, cust),
w AS (SELECT *, 1.959963984540054::DOUBLE AS z, pass / trials AS p, trials::DOUBLE AS n FROM g),
x AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS half FROM w)
SELECT task, cust, trials, pass, fail, unknown, configurations, round(pass / trials, 6) AS confirmed, round((pass + unknown) / trials, 6) AS possible,
round(CASE WHEN pass + fail > 0 THEN pass / (pass + fail) END, 6) AS resolved,
round(CASE WHEN unknown = 0 AND configurations = 1 THEN mid - half END, 6) AS low, round(CASE WHEN unknown = 0 AND configurations = 1 THEN mid + half END, 6) AS high FROM x""")
def cohort_outcomes_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cohorts.outcome_bounds(trials(spark, sf_dir), ["task", "cust"], "outcome", "model")
    return d.withColumns({c: F.round(c, 6) for c in ("confirmed", "possible", "resolved", "low", "high")})


@query(TRIALS_SQL + """, t AS (SELECT task, avg(CASE WHEN outcome = 'pass' THEN 1.0::DOUBLE ELSE 0 END) AS share FROM tr GROUP BY task)
SELECT count(*) AS tasks, round(avg(share), 8) AS macro FROM t""")
def macro_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.macro_average(trials(spark, sf_dir), "task", F.col("outcome") == "pass").withColumn("macro", F.round("macro", 8))


@query(TRIALS_SQL + """, e AS (SELECT *, unnest(['overall', CASE WHEN formal THEN 'formal' ELSE 'diagnostic' END]) AS split FROM tr)
SELECT task, model, split, count(*) AS members, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid,
count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'valid' AND success) AS successes,
round(CASE WHEN count(*) FILTER (status = 'valid') > 0 THEN count(*) FILTER (status = 'valid' AND success) / count(*) FILTER (status = 'valid') END, 6) AS rate
FROM e GROUP BY task, model, split""")
def identity_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cohorts.split_counts(trials(spark, sf_dir), ["task", "model"], "status", "success", "formal")
    return d.withColumn("rate", F.round("rate", 6))


@query(TRIALS_SQL + """, f AS (SELECT id, success, success IS NULL AS m1, price > 440000 AS m2, price < 60000 AS i1, success AND NOT formal AS i2 FROM tr)
SELECT id, CASE WHEN i1 OR coalesce(i2, false) THEN 'invalid' WHEN m1 OR m2 THEN 'missing' ELSE 'valid' END AS evidence,
list_filter([CASE WHEN m1 THEN 'missing_outcome' END, CASE WHEN m2 THEN 'missing_price' END, CASE WHEN i1 THEN 'price_too_low' END, CASE WHEN i2 THEN 'success_without_protocol' END], lambda x: x IS NOT NULL) AS reasons,
CASE WHEN NOT (i1 OR coalesce(i2, false)) AND NOT (m1 OR m2) THEN success END AS counted_success FROM f""")
def trial_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, success = F.col("price"), F.col("success")
    missing = {"missing_outcome": success.isNull(), "missing_price": price > 440000}
    invalid = {"price_too_low": price < 60000, "success_without_protocol": success & ~F.col("formal")}
    return cohorts.classified(trials(spark, sf_dir), missing, invalid, success).select("id", "evidence", "reasons", "counted_success")


@query("""WITH f AS (SELECT doc_id, sha256(text) AS h FROM documents), r AS (SELECT doc_id, row_number() OVER w AS n, first(doc_id) OVER w AS kept_as FROM f WINDOW w AS (PARTITION BY h ORDER BY doc_id))
SELECT doc_id, n = 1 AS kept, kept_as FROM r""")
def content_dedupe_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return cohorts.deduplicated(d, ["h"], ["doc_id"]).select("doc_id", "kept", "kept_as")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 3)""")
def leakage_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").where(F.col("c_nationkey") == 3).select(F.col("c_custkey").alias("o_custkey"))
    return cohorts.without_leaks(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), held, ["o_custkey"])


@query(TRIALS_SQL + """, r AS (SELECT task, id, count(*) OVER (PARTITION BY task) AS n, row_number() OVER (PARTITION BY task ORDER BY sha256('7:' || id), id) AS r FROM tr)
SELECT task, id, CASE WHEN r <= greatest(1, least(n - 1, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT))) THEN 'validation' ELSE 'train' END AS split FROM r""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.hash_split(trials(spark, sf_dir), ["task"], "id", 0.1, 7).select("task", "id", "split")


@query("""SELECT o_orderkey, CASE WHEN ('0x' || substr(sha256('7:' || o_orderkey), 1, 8))::BIGINT < 429496729 THEN 'validation' ELSE 'train' END AS split FROM orders""")
def hash_split_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.hash_split_threshold(table(spark, sf_dir, "orders"), "o_orderkey", 0.1, 7).select("o_orderkey", "split")


@query(TRIALS_SQL + """ SELECT id, task, model FROM tr WHERE model = 'MACHINERY' AND outcome = 'pass'
AND contains(lower(concat_ws(' ', task, model, 'seed_' || lpad(CAST(id AS VARCHAR), CAST(greatest(4, len(CAST(id AS VARCHAR))) AS INTEGER), '0'), outcome)), 'seed_01')""")
def facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.concat(F.lit("seed_"), F.when(F.col("id") < 10000, F.lpad(F.col("id").cast("string"), 4, "0")).otherwise(F.col("id").cast("string")))
    over = [F.col("task"), F.col("model"), seed, F.col("outcome")]
    d = cohorts.faceted(trials(spark, sf_dir), {"model": "MACHINERY", "outcome": "pass", "task": None}, " SEED_01 ", over)
    return d.select("id", "task", "model")


@query(TRIALS_SQL + """, e AS (SELECT *, status = 'valid' AS ok, CASE WHEN cust % 5 <> 0 THEN price > 200000 END AS whole FROM tr)
SELECT task, model, count(*) AS members, count(*) FILTER (ok) AS eligible, count(*) FILTER (NOT ok) AS excluded,
count(*) FILTER (ok AND success IS NOT NULL) AS native_known, count(*) FILTER (ok AND success) AS native_success,
count(*) FILTER (ok AND whole IS NOT NULL) AS complete_known, count(*) FILTER (ok AND whole) AS complete_success FROM e GROUP BY task, model""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trials(spark, sf_dir).withColumn("ok", F.col("status") == "valid").withColumn("whole", F.when(F.col("cust") % 5 != 0, F.col("price") > 200000))
    return cohorts.group_summary(d, ["task", "model"], "ok", "success", "whole")


@query(TRIALS_SQL + """, a AS (SELECT task, model, avg(price) AS mean, count(*) FILTER (success IS NOT NULL) AS known FROM tr GROUP BY task, model)
SELECT model, round(sum(mean * known) / sum(known), 4) AS value, CAST(sum(known) AS BIGINT) AS known FROM a WHERE known > 0 GROUP BY model""")
def weighted_archive_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = trials(spark, sf_dir).groupBy("task", "model").agg(F.avg("price").alias("mean"), F.count("success").alias("known"))
    return cohorts.pooled_means(per, ["model"], "mean", "known").withColumn("value", F.round("value", 4))


STAGES_SQL = """, li AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN true WHEN 'N' THEN false END AS s, l_returnflag AS f FROM lineitem),
st AS (SELECT id, list(s) AS stages, array_to_string(list_sort(list(DISTINCT f)), ',') AS definition FROM li GROUP BY id),
j AS (SELECT tr.*, stages, definition FROM tr JOIN st USING (id))"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with stage flags from their lines (R: reached, N: not, A: unknown) and a definition."""
    flag = F.col("l_returnflag")
    s = F.when(flag == "R", True).when(flag == "N", False)
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.transform(F.collect_list(F.struct(s.alias("x"))), lambda r: r["x"]).alias("stages"),
        F.array_join(F.array_sort(F.collect_set(flag)), ",").alias("definition"),
    )
    return trials(spark, sf_dir).join(per, "id")


@query(TRIALS_SQL + STAGES_SQL + """ SELECT id, CASE WHEN status <> 'valid' THEN 'unknown' WHEN price > 300000 THEN 'complete'
WHEN len(list_filter(stages, lambda x: x)) > 0 THEN 'partial' WHEN len(list_filter(stages, lambda x: x IS NULL)) = 0 THEN 'none' ELSE 'unknown' END AS category FROM j""")
def stage_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = cohorts.stage_category(F.col("stages"), F.col("status") == "valid", F.col("price") > 300000)
    return staged(spark, sf_dir).select("id", category.alias("category"))


@query(TRIALS_SQL + STAGES_SQL + """ SELECT task, sha256(definition) AS signature, count(*) AS known, count(*) FILTER (success) AS successes
FROM j WHERE success IS NOT NULL GROUP BY task, definition""")
def definition_signature_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.by_definition(staged(spark, sf_dir), ["task"], "definition", "success")


@query(TRIALS_SQL + """ SELECT cust, CASE WHEN count(DISTINCT outcome) = 1 THEN min(outcome) END AS outcome,
CASE WHEN count(DISTINCT outcome) = 0 THEN 'unknown' WHEN count(DISTINCT outcome) = 1 THEN 'verified' ELSE 'conflict' END AS status FROM tr GROUP BY cust""")
def metadata_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.consensus(trials(spark, sf_dir), ["cust"], "outcome")


@query("""WITH a AS (SELECT doc_id, quality AS x FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, toxic AS y FROM labels WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN x IS NULL OR y IS NULL OR x = y THEN coalesce(x, y) END AS label,
CASE WHEN x IS NULL AND y IS NULL THEN 'absent' WHEN x IS NULL THEN 'sidecar' WHEN y IS NULL THEN 'embedded' WHEN x = y THEN 'agreed' ELSE 'conflict' END AS status
FROM a FULL JOIN b USING (doc_id)""")
def sidecar_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    a = lab.where(F.col("doc_id") % 3 != 0).select("doc_id", F.col("quality").alias("label"))
    return cohorts.reconciled(a, lab.where(F.col("doc_id") % 2 == 0).select("doc_id", F.col("toxic").alias("label")), ["doc_id"], "label")


@query("""WITH p AS (SELECT c_custkey, c_acctbal > 0 AS ok FROM customer WHERE c_nationkey <> 7)
SELECT o_orderkey, CASE WHEN ok IS NULL THEN 'orphan' WHEN NOT ok THEN 'parent' WHEN o_totalprice <= 100000 THEN 'own' END AS why,
ok IS NOT NULL AND ok AND o_totalprice > 100000 AS valid FROM orders LEFT JOIN p ON c_custkey = o_custkey""")
def parent_gates_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice") > 100000).alias("own"))
    parent = table(spark, sf_dir, "customer").where(F.col("c_nationkey") != 7).select("c_custkey", (F.col("c_acctbal") > 0).alias("ok"))
    return cohorts.gated(child, parent, ["c_custkey"], "ok", "own").select("o_orderkey", "why", "valid")


@query("""WITH a AS (SELECT o_custkey % 50 AS x, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey % 50 AS x, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 1)
SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'unexpected' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def member_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda r: table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == r).select((F.col("o_custkey") % 50).alias("x"), F.col("o_orderstatus").alias("s"))
    return cohorts.differences(part(0), part(1))


MERGE_SQL = TRIALS_SQL + """, a AS (SELECT id, CASE WHEN id % 7 <> 0 THEN task END AS task FROM tr WHERE id % 3 <> 1),
b AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'other' WHEN id % 14 <> 0 THEN task END AS task FROM tr WHERE id % 3 <> 0)"""


def merge_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A base and what is added to it: both hold a third of the trials, some of these with another or no task."""
    t, i = trials(spark, sf_dir).select("id", "task"), F.col("id")
    base = t.where(i % 3 != 1).withColumn("task", F.when(i % 7 != 0, F.col("task")))
    return base, t.where(i % 3 != 0).withColumn("task", F.when(i % 11 == 0, "other").when(i % 14 != 0, F.col("task")))


@query(MERGE_SQL + " SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def merged_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.merged_catalog(*merge_sides(spark, sf_dir), ["id"])[0]


@query(MERGE_SQL + " SELECT id, b.task FROM a JOIN b USING (id) WHERE a.task IS DISTINCT FROM b.task")
def changed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added rows that would change an old member: a merge must have none."""
    return cohorts.merged_catalog(*merge_sides(spark, sf_dir), ["id"])[1]


@query(MERGE_SQL + " SELECT id, a.id IS NOT NULL AS in_base, b.id IS NOT NULL AS in_added FROM a FULL JOIN b USING (id)")
def membership_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.membership(*merge_sides(spark, sf_dir), ["id"])


@query(TRIALS_SQL + """ SELECT task, cust, count(DISTINCT model) AS rules, count(DISTINCT model) = 1 AS compatible FROM tr GROUP BY task, cust""")
def rule_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.same_rules(trials(spark, sf_dir), ["task", "cust"], "model")


@query("""WITH p AS (SELECT c_custkey, c_mktsegment AS cell FROM customer),
r AS (SELECT o_custkey AS c_custkey, arg_max(CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' ELSE 'interrupted' END, (o_orderdate, o_orderkey)) AS status, CAST(max(o_totalprice) * 100 AS BIGINT) AS value FROM orders GROUP BY o_custkey)
SELECT cell, count(*) AS planned, count(status) AS reported, count(*) FILTER (status IN ('success', 'failure')) AS evaluated, count(*) FILTER (status = 'interrupted') AS interrupted,
round(CASE WHEN count(*) FILTER (status IN ('success', 'failure')) > 0 THEN count(*) FILTER (status = 'success') / count(*) FILTER (status IN ('success', 'failure')) END, 6) AS rate,
min(value) AS least, CAST(sum(value) AS BIGINT) AS sum, count(value) AS "values", max(value) AS most FROM p LEFT JOIN r USING (c_custkey) GROUP BY cell""")
def planned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's latest order is the report of its cell; prices are whole cents."""
    code = F.col("o_orderstatus")
    status = F.when(code == "F", "success").when(code == "O", "failure").otherwise("interrupted")
    latest = F.max(F.struct("o_orderdate", "o_orderkey", status.alias("s"))).getField("s").alias("status")
    cents = F.round(F.max("o_totalprice") * 100).cast("long").alias("value")
    reports = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(latest, cents)
    planned = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("cell"))
    d = cohorts.planned_against_reported(planned, reports, ["c_custkey"], ["cell"], "status", "value")
    return d.withColumn("rate", F.round("rate", 6))


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 6 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256('x' || text) ELSE sha256(text) END AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id, CASE WHEN b.h IS NULL THEN 'unlisted' WHEN a.h IS NULL THEN 'absent' WHEN a.h = b.h THEN 'bound' ELSE 'altered' END AS status FROM a FULL JOIN b USING (doc_id)""")
def bound_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    here = d.where(i % 6 != 0).select("doc_id", F.sha2("text", 256).alias("h"))
    listed = d.where(i % 7 != 0).select("doc_id", F.when(i % 5 == 0, F.sha2(F.concat(F.lit("x"), "text"), 256)).otherwise(F.sha2("text", 256)).alias("h"))
    return cohorts.bound_members(here, listed, ["doc_id"], "h")


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM customer WHERE c_custkey % 8 <> 0 UNION ALL SELECT c_custkey, 'train' FROM customer WHERE c_custkey % 25 = 0),
g AS (SELECT c_custkey, count(DISTINCT split) AS n, min(split) AS split FROM d GROUP BY 1)
SELECT o_orderkey, CASE WHEN n = 1 THEN split END AS split, CASE WHEN n IS NULL THEN 'undeclared' WHEN n > 1 THEN 'conflict' END AS why FROM orders LEFT JOIN g ON c_custkey = o_custkey""")
def declared_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, i = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), F.col("o_custkey")
    first = c.where(i % 8 != 0).withColumn("split", F.when(i % 10 == 0, "validation").otherwise("train"))
    declared = first.unionByName(c.where(i % 25 == 0).withColumn("split", F.lit("train")))
    return cohorts.declared_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), declared, ["o_custkey"]).select("o_orderkey", "split", "why")
