"""Releases against their source: windows by running digests, manifests by fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import audits, releases
from tidewater.plans.registry import query, samples

HORIZON = 8
FRAMES_SQL = """{samples}, f AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t, id) - 1 AS frame, coalesce(v::VARCHAR, '-') || ',' || id AS a FROM s)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.row_number().over(Window.partitionBy("k").orderBy("t", "id")) - 1).cast("long")
    return samples(spark, sf_dir).select("k", i.alias("frame"), F.array(F.col("v").cast("double"), F.col("id").cast("double")).alias("action"))


def released(source: DataFrame) -> DataFrame:
    """All windows, with planted faults: shifted (every 5th key), cut (7th), left out (11th), foreign (13th), reversed (3rd), repeated (17th)."""
    w, k, i = Window.partitionBy("k").orderBy("frame"), F.col("k"), F.col("frame")
    ahead = F.collect_list("action").over(w.rowsBetween(0, HORIZON - 1))
    end = F.last("action").over(w.rowsBetween(0, HORIZON - 1))
    d = source.withColumn("w", ahead).withColumn("w", F.concat("w", F.array_repeat(end, HORIZON - F.size("w")))).withColumn("before", F.lag("w").over(w))
    d = d.where(~((k % 11 == 0) & (i == 1)))
    changed = F.when((k % 5 == 0) & (i == 3), F.col("before")).when((k % 7 == 0) & (i == 2), F.slice("w", 1, HORIZON - 1)).when((k % 3 == 0) & (i == 4), F.reverse("w"))
    d = d.select("k", "frame", F.coalesce(changed, F.col("w")).alias("w"))
    extra = d.where((k % 13 == 0) & (i == 0)).withColumn("frame", F.lit(100_000).cast("long")).unionByName(d.where((k % 17 == 0) & (i == 0)))
    return d.unionByName(extra)


@query(f"""WITH {FRAMES_SQL}, x AS (SELECT k, frame, list(a) OVER w AS l, last_value(a) OVER w AS z FROM f WINDOW w AS (PARTITION BY k ORDER BY frame ROWS BETWEEN CURRENT ROW AND {HORIZON - 1} FOLLOWING)),
t AS (SELECT k, frame, list_concat(l, list_transform(range({HORIZON} - len(l)), lambda _: z)) AS w FROM x), b AS (SELECT *, lag(w) OVER (PARTITION BY k ORDER BY frame) AS p FROM t),
r0 AS (SELECT k, frame, CASE WHEN k % 5 = 0 AND frame = 3 THEN p WHEN k % 7 = 0 AND frame = 2 THEN w[1:{HORIZON - 1}] WHEN k % 3 = 0 AND frame = 4 THEN list_reverse(w) ELSE w END AS w FROM b WHERE NOT (k % 11 = 0 AND frame = 1)),
r AS (SELECT * FROM r0 UNION ALL SELECT k, 100000, w FROM r0 WHERE k % 13 = 0 AND frame = 0 UNION ALL SELECT * FROM r0 WHERE k % 17 = 0 AND frame = 0),
g AS (SELECT k, frame, count(*) AS rows, bool_and(len(w) = {HORIZON}) AS fits, list(w) AS ws FROM r GROUP BY k, frame),
j AS (SELECT k, frame, t.w IS NOT NULL AS here, rows, fits, t.w IS NOT NULL AND rows IS NULL AS missing, t.w IS NULL AS foreign_, coalesce(rows > 1, false) AS repeated, t.w IS NOT NULL AND rows IS NOT NULL AND NOT fits AS unfit,
  t.w IS NOT NULL AND rows IS NOT NULL AND fits AND len(list_filter(ws, lambda y: y <> t.w)) > 0 AS changed FROM t FULL JOIN g USING (k, frame))
SELECT k, count(*) FILTER (here) AS frames, CAST(coalesce(sum(rows), 0) AS BIGINT) AS windows, count(*) FILTER (missing) AS missing, count(*) FILTER (foreign_) AS "foreign", count(*) FILTER (repeated) AS repeated,
count(*) FILTER (unfit) AS unfit, count(*) FILTER (changed) AS changed, min(frame) FILTER (missing OR foreign_ OR repeated OR unfit OR changed) AS first_bad,
NOT bool_or(missing OR foreign_ OR repeated OR unfit OR changed) AS ok FROM j GROUP BY k""")
def release_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = frames(spark, sf_dir)
    return releases.checked_windows(released(source), source, ["k"], "frame", "w", "action", HORIZON)


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT k, count(*) AS n FROM f GROUP BY k)
SELECT k, CASE WHEN k % 4 = 0 THEN 'absent' WHEN k % 9 = 0 THEN 'unlisted' WHEN k % 6 = 1 THEN 'changed' ELSE 'bound' END AS binding FROM n WHERE NOT (k % 4 = 0 AND k % 9 = 0)""")
def release_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest against a later state of its source, some of whose episodes are gone, new, or changed in one number."""
    s, k = frames(spark, sf_dir), F.col("k")
    fields = [F.col("frame"), F.col("action")[0], F.col("action")[1]]
    manifest = audits.quick_fingerprint(s.where(k % 9 != 0), ["k"], fields)
    moved = F.when((k % 6 == 1) & (F.col("frame") == 0), F.array(F.col("action")[0], F.col("action")[1] + 0.5)).otherwise(F.col("action"))
    return releases.bound(s.where(k % 4 != 0).withColumn("action", moved), manifest, ["k"], fields)
