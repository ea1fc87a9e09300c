"""Clock and time-alignment queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import asof, clock, overlap
from tidewater.plans.registry import query, samples

MINUTE, HOUR = 60_000_000, 3_600_000_000
K = ["k"]
HELD_SQL = """{samples},
h AS (SELECT *, coalesce(lead(t) OVER w - t, 0) AS dur, t - lag(t) OVER w AS dt FROM s WINDOW w AS (PARTITION BY k ORDER BY t, id)),
c AS (SELECT k, quantile_cont(dt, 0.5) AS cadence FROM h GROUP BY k),
g AS (SELECT h.*, c.cadence, coalesce(dur > 1.5 * cadence, false) AS gap FROM h JOIN c USING (k))"""


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clicks as the query clock (left), views as the source (right)."""
    s = samples(spark, sf_dir)
    left = s.where(F.col("ch") == "click").select("k", "id", "t")
    right = s.where(F.col("ch") == "view").groupBy("k", "t").agg(F.max("id").alias("rid"))
    return left, right


SPLIT_SQL = """{samples},
l AS (SELECT k, id, t FROM s WHERE ch = 'click'),
r AS (SELECT k, t AS rt, max(id) AS rid FROM s WHERE ch = 'view' GROUP BY k, t)"""


@query(f"""WITH {HELD_SQL}
SELECT k, id, CASE WHEN gap THEN 0 ELSE dur END AS dur, gap, round(cadence, 1) AS cadence FROM g""")
def left_hold_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = clock.gap_aware(samples(spark, sf_dir), K, "t", "id")
    return g.select("k", "id", "dur", "gap", F.round("cadence", 1).alias("cadence"))


@query(f"""WITH {HELD_SQL}
SELECT k, id, CAST(CASE WHEN gap THEN trunc(1.5 * cadence) ELSE dur END AS BIGINT) AS dur FROM g""")
def capped_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.gap_aware(samples(spark, sf_dir), K, "t", "id", cap=True).select("k", "id", "dur")


@query(f"""WITH {SPLIT_SQL}
SELECT l.k, l.id, r.rt, l.t - r.rt AS age, r.rid FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.rt""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = split(spark, sf_dir)
    return asof.asof_backward(left, right, K, "t", ["rid"]).drop("t")


@query(f"""WITH {SPLIT_SQL}
SELECT l.k, l.id, r.rt, l.t - r.rt AS age, CASE WHEN l.t - r.rt <= {6 * HOUR} THEN r.rid END AS rid
FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.rt""")
def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = split(spark, sf_dir)
    return asof.asof_backward(left, right, K, "t", ["rid"], tolerance=6 * HOUR).drop("t")


NEAREST_SQL = f"""WITH {SPLIT_SQL},
p AS (SELECT l.*, r.rt AS prt, r.rid AS prid FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.rt),
n AS (SELECT p.*, r.rt AS nrt, r.rid AS nrid FROM p ASOF LEFT JOIN r ON p.k = r.k AND p.t <= r.rt)"""


@query(f"""{NEAREST_SQL}
SELECT k, id, CASE WHEN nrt IS NULL OR t - prt <= nrt - t THEN prt ELSE nrt END AS rt,
       CASE WHEN nrt IS NULL OR t - prt <= nrt - t THEN prid ELSE nrid END AS rid FROM n""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = split(spark, sf_dir)
    return asof.asof_nearest(left, right, K, "t", ["rid"]).drop("t")


@query(f"""{NEAREST_SQL}, m AS (
SELECT k, id, t, CASE WHEN nrt IS NULL OR t - prt < nrt - t THEN prt ELSE nrt END AS rt,
       CASE WHEN nrt IS NULL OR t - prt < nrt - t THEN prid ELSE nrid END AS rid FROM n)
SELECT k, id, CASE WHEN abs(t - rt) <= {HOUR} THEN rt END AS rt, CASE WHEN abs(t - rt) <= {HOUR} THEN rid END AS rid FROM m""")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = split(spark, sf_dir)
    return asof.asof_nearest(left, right, K, "t", ["rid"], tolerance=HOUR, later=True).drop("t")


@query(f"""{NEAREST_SQL} SELECT k, id, prt AS prev_t, prid AS prev_id, nrt AS next_t, nrid AS next_id FROM n""")
def event_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = split(spark, sf_dir)
    b = asof.bracket(left, right, K, "t", ["rid"])
    pick = {"prev_t": "prev.rt", "prev_id": "prev.rid", "next_t": "next.rt", "next_id": "next.rid"}
    return b.select("k", "id", *[F.col(c).alias(n) for n, c in pick.items()])


@query(f"""WITH {{samples}}, l AS (SELECT k, id, t FROM s WHERE ch = 'click'),
r AS (SELECT k, t AS rt, max(v) AS rv FROM s WHERE ch = 'view' AND v IS NOT NULL GROUP BY k, t),
p AS (SELECT l.*, r.rt AS a, r.rv AS va FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.rt),
n AS (SELECT p.*, r.rt AS b, r.rv AS vb FROM p ASOF LEFT JOIN r ON p.k = r.k AND p.t <= r.rt)
SELECT k, id, round(va + (vb - va) * CASE WHEN b > a THEN CAST(t - a AS DOUBLE) / (b - a) ELSE 0 END, 4) AS v FROM n""")
def interpolated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    right = s.where((F.col("ch") == "view") & F.col("v").isNotNull()).groupBy("k", "t").agg(F.max("v").alias("v"))
    left = s.where(F.col("ch") == "click").select("k", "id", "t")
    return asof.interpolated(left, right, K, "t", "v").select("k", "id", F.round("v", 4).alias("v"))


@query(f"""WITH {{samples}}, a AS (SELECT k, t // {HOUR} AS h, id FROM s WHERE ch = 'click'),
b AS (SELECT k, t // {HOUR} AS h, max(id) AS other FROM s WHERE ch = 'purchase' GROUP BY ALL)
SELECT a.k, a.h, a.id, b.other FROM a LEFT JOIN b USING (k, h)""")
def exact_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("h", F.floor(F.col("t") / HOUR).cast("long"))
    right = s.where(F.col("ch") == "purchase").groupBy("k", "h").agg(F.max("id").alias("other"))
    return asof.exact_join(s.where(F.col("ch") == "click").select("k", "h", "id"), right, K, "h").select("k", "h", "id", "other")


@query(f"""WITH {SPLIT_SQL}, x AS (SELECT k, rt, rt - lag(rt) OVER (PARTITION BY k ORDER BY rt) AS dt FROM r),
c AS (SELECT k, quantile_cont(dt, 0.5) AS cadence FROM x GROUP BY k)
SELECT l.k, l.id, r.rt, l.t - r.rt AS age, CASE WHEN l.t - r.rt <= 1.5 * c.cadence THEN r.rid END AS rid
FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.rt LEFT JOIN c ON c.k = l.k""")
def held_while_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = split(spark, sf_dir)
    typical = clock.cadence(right, K, "t", "rid")
    return asof.held_while_fresh(left, right, typical, K, "t", ["rid"]).drop("t")


@query(f"""WITH {{samples}}, d AS (SELECT DISTINCT k, t // {HOUR} AS h FROM s),
v AS (SELECT k, t // {HOUR} AS h, max(v) AS v FROM s GROUP BY ALL)
SELECT a.k, a.h, b.h AS then, a.v AS value, b.v AS value_then FROM v a JOIN v b ON a.k = b.k AND a.h = b.h + 24
WHERE NOT EXISTS (SELECT 1 FROM v m WHERE m.k = a.k AND m.h > b.h AND m.h <= a.h AND m.v IS NULL)""")
def lagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = samples(spark, sf_dir).groupBy("k", F.floor(F.col("t") / HOUR).cast("long").alias("h")).agg(F.max("v").alias("value"))
    return asof.lagged_pairs(hours, K, "h", "value", 24, F.col("value").isNull()).select("k", "h", "then", "value", "value_then")


@query(f"""WITH {HELD_SQL}, i AS (SELECT k, t, t + CASE WHEN gap THEN 0 ELSE dur END AS e, v FROM g WHERE v IS NOT NULL),
b AS (SELECT i.*, unnest(range(t // {HOUR * 6}, (e - 1) // {HOUR * 6} + 1)) AS bin FROM i WHERE e > t),
o AS (SELECT *, least(e, (bin + 1) * {HOUR * 6}) - greatest(t, bin * {HOUR * 6}) AS w FROM b)
SELECT k, bin, CAST(sum(w) AS BIGINT) AS covered, round(sum(v * w) / sum(w), 4) AS mean FROM o GROUP BY k, bin""")
def bin_overlap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = clock.gap_aware(samples(spark, sf_dir), K, "t", "id").where(F.col("v").isNotNull())
    b = overlap.overlap_bins(g.withColumn("e", F.col("t") + F.col("dur")), "t", "e", 6 * HOUR)
    mean = F.round(F.sum(F.col("v") * F.col("overlap")) / F.sum("overlap"), 4)
    return b.groupBy("k", "bin").agg(F.sum("overlap").cast("long").alias("covered"), mean.alias("mean"))


@query(f"""WITH {HELD_SQL}, i AS (SELECT k, t, t + dur AS e, v FROM g),
f AS (SELECT k, min(t) AS o, max(e) AS z FROM i GROUP BY k),
b AS (SELECT i.*, o, unnest(range((t - o) // {24 * HOUR}, (e - o - 1) // {24 * HOUR} + 1)) AS bin FROM i JOIN f USING (k) WHERE e > t AND v IS NOT NULL),
m AS (SELECT k, bin, sum(w) AS cover, sum(v * w) / sum(w) AS mean
      FROM (SELECT *, least(e, (bin + 1) * {24 * HOUR} + o) - greatest(t, bin * {24 * HOUR} + o) AS w FROM b) GROUP BY k, bin),
d AS (SELECT k, unnest(range(0, (z - o - 1) // {24 * HOUR} + 1)) AS bin FROM f WHERE z > o),
j AS (SELECT d.k, d.bin, mean, CASE WHEN cover >= {24 * HOUR} THEN 0 ELSE 1 END AS bad FROM d LEFT JOIN m USING (k, bin)),
q AS (SELECT *, sum(bad) OVER x AS bads, count(*) OVER x AS n, lead(mean, 2) OVER (PARTITION BY k ORDER BY bin) AS later
      FROM j WINDOW x AS (PARTITION BY k ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT k, bin, round(mean, 4) AS mean, round(abs(later - mean), 4) AS change FROM q WHERE bads = 0 AND n = 3""")
def bin_lag_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = clock.left_hold(samples(spark, sf_dir), K, "t", "id").withColumn("e", F.col("t") + F.col("dur"))
    c = overlap.complete_bin_changes(i, K, "t", "e", "v", 24 * HOUR, 2)
    return c.select("k", "bin", F.round("mean", 4).alias("mean"), F.round("change", 4).alias("change"))


@query(f"""WITH {HELD_SQL}, w AS (SELECT k, min(t) + {48 * HOUR} AS lo, min(t) + {240 * HOUR} AS hi FROM s GROUP BY k)
SELECT g.k, g.id, least(t + dur, hi) - greatest(t, lo) AS overlap FROM g JOIN w USING (k) WHERE least(t + dur, hi) > greatest(t, lo)""")
def window_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    windows = s.groupBy("k").agg((F.min("t") + 48 * HOUR).alias("lo"), (F.min("t") + 240 * HOUR).alias("hi"))
    held = clock.left_hold(s, K, "t", "id").withColumn("e", F.col("t") + F.col("dur"))
    return overlap.clipped(held, windows, K, "t", "e", "lo", "hi").select("k", "id", "overlap")


@query(f"""WITH {{samples}}, i AS (SELECT k, t AS a, t + {6 * HOUR} AS b FROM s),
p AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT k, CAST(sum(greatest(0, b - greatest(a, coalesce(reach, a)))) AS BIGINT) AS covered FROM p GROUP BY k""")
def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = samples(spark, sf_dir).select("k", F.col("t").alias("a"), (F.col("t") + 6 * HOUR).alias("b"))
    return overlap.union_length(i, K, "a", "b")


@query(f"""WITH {HELD_SQL}, x AS (SELECT k, t AS a, t + dur AS b FROM g WHERE gap AND ch = 'view'),
y AS (SELECT k, id, t AS a, t + {HOUR} AS b FROM g WHERE ch = 'click')
SELECT y.k, y.id, EXISTS (SELECT 1 FROM x WHERE x.k = y.k AND x.a < y.b AND x.b > y.a) AS touched FROM y""")
def gap_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = clock.left_hold(samples(spark, sf_dir), K, "t", "id").join(clock.cadence(samples(spark, sf_dir), K, "t", "id"), K)
    gap = held.where((F.col("dur") > 1.5 * F.col("cadence")) & (F.col("ch") == "view"))
    gaps = gap.select("k", F.col("t").alias("a"), (F.col("t") + F.col("dur")).alias("b"))
    target = held.where(F.col("ch") == "click").select("k", "id", F.col("t").alias("a"), (F.col("t") + HOUR).alias("b"))
    return overlap.gaps_touched(target, gaps, K, "a", "b", 24 * HOUR).select("k", "id", "touched")


@query("""WITH {samples}, x AS (SELECT *, t - lag(t) OVER (PARTITION BY k ORDER BY id) AS dt FROM s),
c AS (SELECT k, quantile_cont(dt, 0.5) AS cadence FROM x WHERE dt > 0 GROUP BY k)
SELECT k, count(*) AS samples, count(*) FILTER (dt = 0) AS duplicates, count(*) FILTER (dt < 0) AS reversals,
       count(*) FILTER (dt > 1.5 * cadence) AS gaps,
       CAST(coalesce(sum(CAST(round(dt / cadence) AS BIGINT) - 1) FILTER (dt > 1.5 * cadence), 0) AS BIGINT) AS missing
FROM x LEFT JOIN c USING (k) GROUP BY k""")
def clock_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.clock_audit(samples(spark, sf_dir), K, "t", "id")


@query(f"""WITH {{samples}}, c AS (SELECT DISTINCT k, t // {24 * HOUR} AS cell FROM s),
e AS (SELECT k, unnest(range(min(cell), max(cell) + 1)) AS cell FROM c GROUP BY k)
SELECT k, cell FROM e EXCEPT SELECT k, cell FROM c""")
def expected_grid_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.grid_difference(samples(spark, sf_dir), K, "t", 24 * HOUR)


@query(f"""WITH {{samples}}, x AS (SELECT *, min(t) OVER (PARTITION BY k) AS f, max(t) OVER (PARTITION BY k) AS l FROM s),
p AS (SELECT *, CAST(floor((t - f + {12 * HOUR}) / {24 * HOUR}) AS BIGINT) AS pt FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY k, pt ORDER BY abs(t - f - pt * {24 * HOUR}), t, id) AS n FROM p)
SELECT k, id, t FROM r WHERE n = 1 OR t = f OR t = l""")
def nearest_grid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.grid_samples(samples(spark, sf_dir), K, "t", "id", 24 * HOUR).select("k", "id", "t")


@query("""WITH {samples} SELECT id, CAST(round_even(t / 2000.0, 0) AS BIGINT) AS tick FROM s""")
def physics_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.quantised(samples(spark, sf_dir), "t", 2000).select("id", "tick")
