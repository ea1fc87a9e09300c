"""Run, hold and phase queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import clock, segments
from tidewater.plans.registry import query, samples
from tidewater.plans.time import HELD_SQL, HOUR

K, BY = ["k"], ["t", "id"]
DAY = 24 * HOUR
STATE_SQL = HELD_SQL + """,
o AS (SELECT *, CASE WHEN gap THEN 0 ELSE dur END AS d, coalesce(v IS NOT NULL AND NOT gap AND dur > 0, false) AS ok FROM g),
p AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t, id) AS seg FROM o),
st AS (SELECT *, CASE WHEN ok THEN coalesce(last_value(CASE WHEN ok THEN CASE WHEN v > 300 THEN 1 WHEN v <= 150 THEN 0 END END IGNORE NULLS)
         OVER (PARTITION BY k, seg ORDER BY t, id), -1) ELSE -1 END AS state FROM p)"""


def with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = clock.gap_aware(samples(spark, sf_dir), K, "t", "id")
    ok = F.col("v").isNotNull() & ~F.col("gap") & (F.col("dur") > 0)
    return segments.hysteresis(g, K, BY, "v", 300, 150, ok)


@query(f"WITH {STATE_SQL} SELECT k, id, state FROM st")
def hysteresis_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_state(spark, sf_dir).select("k", "id", "state")


RUN_SQL = f"""WITH {STATE_SQL},
b AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS brk FROM st WINDOW w AS (PARTITION BY k ORDER BY t, id)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY t, id) AS run FROM b)"""


@query(f"""{RUN_SQL} SELECT k, CAST(run AS BIGINT) AS run, any_value(state) AS state, min(t) AS start, count(*) AS samples FROM r GROUP BY k, run""")
def contact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = segments.runs(with_state(spark, sf_dir), K, BY, "state")
    return r.groupBy("k", "run").agg(F.first("state").alias("state"), F.min("t").alias("start"), F.count("*").alias("samples"))


@query(f"""{RUN_SQL}, e AS (SELECT k, run, any_value(state) AS state, min(t) AS start, max(t + d) AS "end", CAST(sum(d) AS BIGINT) AS length, count(*) AS samples FROM r GROUP BY k, run),
cen AS (SELECT *, coalesce(lag(state) OVER w = -1, true) AS left_censored, coalesce(lead(state) OVER w = -1, true) AS right_censored FROM e WINDOW w AS (PARTITION BY k ORDER BY run))
SELECT k, start, "end", length, samples, left_censored, right_censored, length >= {6 * HOUR} AS confirmed FROM cen WHERE state = 1""")
def run_episodes_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.episodes(with_state(spark, sf_dir), K, BY, "state", "t", "dur", 6 * HOUR)


PHASE_SQL = """WITH {samples}, q AS (SELECT *, v > 200 AS grasp, CASE WHEN v IS NULL THEN NULL ELSE v > 470 END AS board FROM s),
x AS (SELECT *, coalesce(bool_or(coalesce(board, false)) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM q),
f AS (SELECT *, CASE WHEN board THEN 'board' WHEN seen THEN 'post_board' WHEN grasp THEN 'grasp' WHEN grasp IS NULL OR board IS NULL THEN 'unknown' ELSE 'pre' END AS phase FROM x)"""


@query(PHASE_SQL + " SELECT k, id, phase FROM f")
def phase_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.phases(samples(spark, sf_dir), K, BY, F.col("v") > 200, F.col("v") > 470).select("k", "id", "phase")


@query(PHASE_SQL + """, i AS (SELECT k, t AS a, coalesce(lead(t) OVER (PARTITION BY k ORDER BY t, id), t) AS b, phase FROM f),
m AS (SELECT *, CASE WHEN lag(phase) OVER w = phase AND lag(b) OVER w = a THEN 0 ELSE 1 END AS brk FROM i WINDOW w AS (PARTITION BY k ORDER BY a, b)),
n AS (SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY a, b) AS g FROM m)
SELECT k, phase, min(a) AS start, max(b) AS "end", count(*) AS parts FROM n GROUP BY k, g, phase""")
def phase_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = segments.phases(samples(spark, sf_dir), K, BY, F.col("v") > 200, F.col("v") > 470)
    held = clock.left_hold(p, K, "t", "id").select("k", F.col("t").alias("a"), (F.col("t") + F.col("dur")).alias("b"), "phase")
    return segments.merged_intervals(held, K, "a", "b", "phase")


@query("""WITH {samples}, x AS (SELECT k, id, ch, lag(ch) OVER (PARTITION BY k ORDER BY t, id) AS before FROM s) SELECT * FROM x WHERE before <> ch""")
def stage_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.state_changes(samples(spark, sf_dir), K, BY, "ch").select("k", "id", "ch", "before")


HOLD_SQL = f"""{HELD_SQL}, z AS (SELECT *, coalesce(v > 100, false) AS c, coalesce(dt > 1.5 * cadence, false) AS late FROM g),
y AS (SELECT *, sum(CASE WHEN c THEN CASE WHEN late THEN 1 ELSE 0 END ELSE 1 END) OVER (PARTITION BY k ORDER BY t, id) AS i FROM z),
hold AS (SELECT *, CASE WHEN c THEN t - min(CASE WHEN c THEN t END) OVER (PARTITION BY k, i ORDER BY t, id) END AS held FROM y)"""


def with_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    d = s.withColumn("dt", F.col("t") - F.lag("t").over(clock.in_order(K, "t", "id"))).join(clock.cadence(s, K, "t", "id"), K)
    return segments.hold_timer(d, K, BY, "t", F.col("v") > 100, F.col("dt") > 1.5 * F.col("cadence"))


@query(f"WITH {HOLD_SQL} SELECT k, id, held FROM hold")
def hold_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hold(spark, sf_dir).select("k", "id", "held")


@query(f"""WITH {HOLD_SQL}, a AS (SELECT k, min(t) FILTER (held >= {6 * HOUR}) AS f1 FROM hold GROUP BY k),
b AS (SELECT hold.k, any_value(f1) AS f1, min(t) FILTER (held >= {12 * HOUR} AND t >= f1) AS f2 FROM hold JOIN a USING (k) GROUP BY hold.k)
SELECT k, f1, f2, min(t) FILTER (held > {18 * HOUR} AND t >= f2) AS f3 FROM hold JOIN (SELECT k AS kk, f1, f2 FROM b) ON k = kk GROUP BY k, f1, f2""")
def hold_latch_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_hold(spark, sf_dir)
    d = d.withColumn("f1", segments.first_hold(d, K, "t", "held", 6 * HOUR))
    d = d.withColumn("f2", segments.first_hold(d, K, "t", "held", 12 * HOUR, "f1"))
    return d.withColumn("f3", segments.first_hold(d, K, "t", "held", 18 * HOUR, "f2", strict=True)).select("k", "f1", "f2", "f3").distinct()


@query(f"""WITH {{samples}}, h AS (SELECT *, coalesce(v > 250 OR v >= 400, false) AS h, lag(t) OVER (PARTITION BY k ORDER BY t, id) AS pt FROM s),
x AS (SELECT *, last_value(CASE WHEN h THEN t END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM h),
i AS (SELECT *, sum(CASE WHEN h AND (ph IS NULL OR (pt <> ph AND pt >= ph + {DAY})) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, id) AS i FROM x),
r AS (SELECT *, h AND bool_or(coalesce(v >= 400, false)) OVER (PARTITION BY k, i ORDER BY t, id) AS ref FROM i)
SELECT k, id, ref OR coalesce(t < last_value(CASE WHEN ref THEN t END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, id) + {DAY}, false) AS contact FROM r""")
def debounce_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.debounced(samples(spark, sf_dir), K, "t", "id", "v", 400, 250, DAY).select("k", "id", "contact")


@query("""WITH {samples}, x AS (SELECT *, sum(CASE WHEN v < 300 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t DESC, id DESC) AS bad FROM s)
SELECT k, min(t) AS since, count(*) AS samples FROM x WHERE bad = 0 GROUP BY k""")
def terminal_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.trailing_run(samples(spark, sf_dir), K, BY, "t", F.col("v") < 300)


@query(f"""WITH {HELD_SQL}, x AS (SELECT * EXCLUDE (gap), coalesce(v - lag(v) OVER w > 20 AND NOT lag(gap) OVER w, false) AS g FROM g WINDOW w AS (PARTITION BY k ORDER BY t, id)),
i AS (SELECT *, sum(CASE WHEN g THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t, id) AS i FROM x)
SELECT k, min(t) AS start, max(t) AS "end", count(*) AS samples, round(max(v) - min(v), 4) AS rise FROM i GROUP BY k, i HAVING count(*) > 1""")
def growth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clock.gap_aware(samples(spark, sf_dir), K, "t", "id")
    return segments.growth_runs(s, K, BY, "t", "v", 20, "gap").withColumn("rise", F.round("rise", 4))


@query(f"""WITH RECURSIVE {HELD_SQL}, n AS (SELECT k, t, v, gap, row_number() OVER (PARTITION BY k ORDER BY t, id) AS i FROM g),
r AS (SELECT k, i, t, v, gap, v AS lo, v AS hi, t AS start, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS n FROM n WHERE i = 1
  UNION ALL SELECT n.k, n.i, n.t, n.v, n.gap,
    CASE WHEN j THEN least(lo, n.v) ELSE n.v END, CASE WHEN j THEN greatest(hi, n.v) ELSE n.v END, CASE WHEN j THEN start ELSE n.t END,
    CASE WHEN j THEN r.n + 1 WHEN n.v IS NULL THEN 0 ELSE 1 END
  FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1, LATERAL (SELECT r.n > 0 AND NOT r.gap AND n.v IS NOT NULL AND greatest(hi, n.v) - least(lo, n.v) <= 150 AS j)),
e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY k ORDER BY i) <> start OR lead(n) OVER (PARTITION BY k ORDER BY i) <> n + 1, true) AS last FROM r)
SELECT k, start, t AS "end", CAST(n AS BIGINT) AS samples FROM e WHERE last AND n > 1 AND t - start >= {12 * HOUR}""")
def plateau_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clock.gap_aware(samples(spark, sf_dir), K, "t", "id")
    return segments.plateaus(s, K, BY, "t", "v", 150.0, 12 * HOUR, "gap")


@query("""WITH {samples}, e AS (SELECT k, t, percent_rank() OVER (PARTITION BY k ORDER BY t, id) AS p FROM s), m AS (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0]) AS edge)
SELECT k, CAST(edge AS DOUBLE) AS edge, min(t) AS reached FROM e JOIN m ON p >= edge GROUP BY k, edge""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percent_rank().over(clock.in_order(K, "t", "id"))
    edges = F.explode(F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8, 1.0)))).alias("edge")
    d = samples(spark, sf_dir).select("k", "t", p.alias("p")).select("*", edges)
    return d.where(F.col("p") >= F.col("edge")).groupBy("k", "edge").agg(F.min("t").alias("reached"))
