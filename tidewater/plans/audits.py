"""Integrity queries over events, lineitem and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import audits, cohorts
from tidewater.plans.registry import query, samples, table
from tidewater.plans.time import HOUR

K, BY = ["k"], ["t", "id"]


@query("""WITH {samples}, f AS (SELECT k, coalesce(v >= 0.05, false) AS a, coalesce(v < 450, false) AS b, ch <> 'error' AS c FROM s),
g AS (SELECT k, count(*) AS samples, count(*) FILTER (NOT a) AS na, count(*) FILTER (NOT b) AS nb, count(*) FILTER (NOT c) AS nc FROM f GROUP BY k)
SELECT k, samples, list_filter([CASE WHEN na > 0 THEN 'known_force' END, CASE WHEN nb > 0 THEN 'force_limit' END, CASE WHEN nc > 0 THEN 'no_error_phase' END], lambda x: x IS NOT NULL) AS errors,
na + nb + nc AS broken, na + nb + nc = 0 AS valid FROM g""")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"known_force": F.col("v") >= 0.05, "force_limit": F.col("v") < 450, "no_error_phase": F.col("ch") != "error"}
    return audits.validated(samples(spark, sf_dir), K, rules)


@query("""WITH {samples}, x AS (SELECT k, v AS a, round(v) AS b, t, id FROM s), y AS (SELECT *, lead(b) OVER w AS nb, lead(1) OVER w AS more FROM x WINDOW w AS (PARTITION BY k ORDER BY t, id))
SELECT k, bool_and(a IS NOT DISTINCT FROM b) AS equal, coalesce(bool_and(a IS NOT DISTINCT FROM nb) FILTER (more IS NOT NULL), true) AS shifted_equal,
round(max(abs(a - b)), 6) AS most, round(max(abs(a - nb)), 6) AS shifted_most FROM y GROUP BY k""")
def column_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).withColumn("b", F.round("v"))
    return audits.relation(d, K, BY, "v", "b").withColumns({c: F.round(c, 6) for c in ("most", "shifted_most")})


@query("""WITH {samples}, n AS (SELECT * FROM s WHERE v IS NOT NULL), d AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, abs(v - lag(v) OVER w) AS step FROM n WINDOW w AS (PARTITION BY k ORDER BY t, id)),
m AS (SELECT k, quantile_cont(step, 0.5) AS m FROM d GROUP BY k), q AS (SELECT k, any_value(m) AS m, quantile_cont(abs(step - m), 0.5) AS d FROM d JOIN m USING (k) GROUP BY k),
l AS (SELECT k, greatest(100.0::DOUBLE, m + 3 * 1.4826::DOUBLE * d) AS threshold FROM q)
SELECT d.k, id, round(step, 6) AS step, round(threshold, 6) AS threshold, coalesce((v - b) * (a - v) < 0 AND abs(a - b) < 0.25 * step, false) AS spike FROM d JOIN l USING (k) WHERE step > threshold""")
def median_mad_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = audits.jumps(samples(spark, sf_dir).where(F.col("v").isNotNull()), K, BY, "v", 100.0, factor=3.0)
    return d.select("k", "id", F.round("step", 6).alias("step"), F.round("threshold", 6).alias("threshold"), "spike")


@query("""WITH {samples}, p AS (SELECT *, row_number() OVER w AS p, CASE WHEN lag(ch) OVER w IS DISTINCT FROM ch OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS f FROM s WINDOW w AS (PARTITION BY k ORDER BY t, id)),
g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY t, id) AS g FROM p) SELECT k, min(p) AS start, max(p) AS "end", count(*) AS length FROM g GROUP BY k, g HAVING count(*) > 1""")
def identical_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = audits.duplicate_runs(samples(spark, sf_dir), K, BY, "ch")
    return d.select("k", F.col("start").cast("long"), F.col("end").cast("long"), "length")


@query("""WITH f AS (SELECT doc_id, sha256(text) AS h FROM documents), m AS (SELECT h, min(doc_id) AS first FROM f GROUP BY h)
SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS seen_as FROM f JOIN m USING (h)""")
def first_seen_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return audits.first_seen(d, ["h"], ["doc_id"], "doc_id").select("doc_id", "seen_as")


@query("""WITH f AS (SELECT l_orderkey, [CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CASE WHEN l_returnflag <> 'A' THEN l_returnflag END] AS f FROM lineitem),
h AS (SELECT l_orderkey, sha256(array_to_string(list_transform(f, lambda x: coalesce(len(x) || ':' || x, '-')), '')) AS h FROM f)
SELECT l_orderkey, count(*) AS samples, sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT)::VARCHAR || ':' || sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT)::VARCHAR AS fingerprint FROM h GROUP BY l_orderkey""")
def stream_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col("l_partkey"), F.col("l_linenumber"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))]
    return audits.fingerprint(table(spark, sf_dir, "lineitem"), ["l_orderkey"], fields)


@query("""WITH x AS (SELECT l_orderkey AS k, l_suppkey % 3 AS a, CASE WHEN l_returnflag <> 'A' THEN l_linenumber END AS b FROM lineitem),
g AS (SELECT k, count(*) AS samples, list_sort(list(coalesce(a::VARCHAR, '-') || ',' || coalesce(b::VARCHAR, '-'))) AS rows FROM x GROUP BY k),
m AS (SELECT rows, min(k) AS twin FROM g GROUP BY rows) SELECT k, samples, twin FROM g JOIN m USING (rows) WHERE k <> twin""")
def stream_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines repeat an earlier order's, as far as two fields tell."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    return audits.twins(li, "k", [F.col("l_suppkey") % 3, F.when(F.col("l_returnflag") != "A", F.col("l_linenumber"))])


@query("""WITH f AS (SELECT sha256(text) AS h, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents)
SELECT h, count(*) AS members, list_sort(list(doc_id) FILTER (r <= 10)) AS examples FROM f GROUP BY h HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return audits.duplicate_groups(d, ["h"], "doc_id")


@query(f"""WITH {{samples}}, p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, id) - 1 AS i, min(t) OVER (PARTITION BY k) AS f FROM s),
o AS (SELECT *, abs(t - f - i * {6 * HOUR}) > {12 * HOUR} AS o FROM p), g AS (SELECT k, count(*) AS samples, coalesce(min(i) FILTER (o), count(*)) AS on_grid FROM o GROUP BY k)
SELECT k, samples, CAST(on_grid AS BIGINT) AS on_grid, on_grid >= samples - 1 AS terminal_only FROM g""")
def strict_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.strict_prefix(samples(spark, sf_dir), K, "t", "id", 6 * HOUR, 12 * HOUR)


@query("""WITH x AS (SELECT o_custkey AS k, o_orderkey AS id, epoch_us(o_orderdate) AS t, o_totalprice > 50000 AS f1, o_totalprice > 200000 AS f2 FROM orders),
y AS (SELECT *, coalesce(t < lag(t) OVER w, false) AS back, coalesce(lag(f1) OVER w AND NOT f1, false) OR coalesce(lag(f2) OVER w AND NOT f2, false) AS bad FROM x WINDOW w AS (PARTITION BY k ORDER BY id))
SELECT k, NOT bool_or(back) AS clock_ok, NOT bool_or(bad) AS flags_ok, arg_max(f1, id) AS f1, arg_max(f2, id) AS f2 FROM y GROUP BY k""")
def state_log_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t"),
        (F.col("o_totalprice") > 50000).alias("f1"), (F.col("o_totalprice") > 200000).alias("f2"),
    )
    return audits.monotone_log(d, K, "id", "t", ["f1", "f2"])


@query("""WITH a AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_linenumber = 7 THEN l_quantity + 1 ELSE l_quantity END) AS BIGINT) AS q FROM lineitem GROUP BY 1)
SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'unexpected' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def published_against_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = cohorts.dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"])
    total = lambda c: li.groupBy("l_orderkey").agg(F.sum(c).cast("long").alias("q"))
    changed = F.when(F.col("l_linenumber") == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return cohorts.differences(total(F.col("l_quantity")), total(changed))
