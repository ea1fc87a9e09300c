"""Per-phase statistics, frames with states, and paired comparisons over events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import clock, evidence, paired, quantiles, segments
from tidewater.plans.registry import query, samples, table
from tidewater.plans.time import HELD_SQL, HOUR

K, BY = ["k"], ["t", "id"]
D_SQL = HELD_SQL + ", d AS (SELECT * EXCLUDE (dur), CASE WHEN gap THEN 0 ELSE dur END AS dur FROM g)"
PHASE_SQL = f"""WITH {D_SQL}, p AS (SELECT *, coalesce(max(CASE WHEN v > 400 THEN 1 END) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM d),
q AS (SELECT *, CASE WHEN v > 400 THEN 'board' WHEN seen = 1 THEN 'post' WHEN v IS NULL THEN 'unknown' ELSE 'pre' END AS phase FROM p),
st AS (SELECT k, phase, count(*) AS samples, count(v) AS known, CAST(sum(dur) AS BIGINT) AS time,
  CASE WHEN sum(dur) FILTER (v IS NOT NULL) <> 0 THEN sum(v * dur) / sum(dur) FILTER (v IS NOT NULL) END AS mean,
  CASE WHEN sum(dur) FILTER (v IS NOT NULL) <> 0 THEN sum(v * v * dur) / sum(dur) FILTER (v IS NOT NULL) END AS sq, max(v) AS most FROM q GROUP BY k, phase)"""


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.gap_aware(samples(spark, sf_dir), K, "t", "id")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a phase: above 400, after such a sample, unknown, or before."""
    s = held(spark, sf_dir)
    seen = F.max(F.when(F.col("v") > 400, 1)).over(clock.in_order(K, *BY).rowsBetween(Window.unboundedPreceding, -1))
    phase = F.when(F.col("v") > 400, "board").when(seen == 1, "post").when(F.col("v").isNull(), "unknown").otherwise("pre")
    return s.withColumn("phase", phase)


@query(PHASE_SQL + " SELECT k, phase, samples, known, time, round(mean, 3) AS mean, round(sqrt(greatest(sq - mean * mean, 0)), 3) AS std, round(sqrt(sq), 3) AS rms, most FROM st")
def phase_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired.phase_statistics(phased(spark, sf_dir), K, "phase", "v", "dur"), 3, "mean", "std", "rms")


@query(PHASE_SQL + """ SELECT phase, count(*) AS episodes, count(mean) AS known, round(avg(mean), 4) AS mean, round(stddev_pop(mean), 4) AS std,
round(CASE WHEN avg(mean) > 0 THEN stddev_pop(mean) / avg(mean) END, 5) AS cv FROM st GROUP BY phase""")
def phase_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = paired.phase_statistics(phased(spark, sf_dir), K, "phase", "v", "dur")
    return rounded(rounded(paired.phase_variability(stats, ["phase"], "mean"), 4, "mean", "std"), 5, "cv")


@query(f"""WITH {D_SQL}, a AS (SELECT k, sum(v * dur) / nullif(sum(dur) FILTER (v IS NOT NULL), 0) AS m, sum(v * v * dur) / nullif(sum(dur) FILTER (v IS NOT NULL), 0) AS s,
sum(v * dur) FILTER (v > 100) / nullif(sum(dur) FILTER (v > 100), 0) AS cm, sum(v * v * dur) FILTER (v > 100) / nullif(sum(dur) FILTER (v > 100), 0) AS cs FROM d GROUP BY k)
SELECT k, round(m, 3) AS all_mean, round(sqrt(greatest(s - m * m, 0)), 3) AS all_std, round(cm, 3) AS contact_mean, round(sqrt(greatest(cs - cm * cm, 0)), 3) AS contact_std,
round(CASE WHEN m > 0 THEN sqrt(greatest(s - m * m, 0)) / m END, 5) AS all_cv, round(CASE WHEN cm > 0 THEN sqrt(greatest(cs - cm * cm, 0)) / cm END, 5) AS contact_cv FROM a""")
def contact_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paired.contact_variation(held(spark, sf_dir), K, "v", "dur", 100.0)
    return rounded(rounded(d, 3, "all_mean", "all_std", "contact_mean", "contact_std"), 5, "all_cv", "contact_cv")


@query("""WITH x AS (SELECT vec_id, f, list_transform(range(4), lambda t: [CAST(embedding[(f * 4 + t) * 3 + 1] AS DOUBLE), embedding[(f * 4 + t) * 3 + 2], embedding[(f * 4 + t) * 3 + 3]]) AS q FROM embeddings, range(5) r(f))
SELECT vec_id, CAST(f AS INTEGER) AS finger, round(list_sum(list_transform(q, lambda p: p[1])), 5) AS normal,
round(sqrt(power(list_sum(list_transform(q, lambda p: p[2])), 2) + power(list_sum(list_transform(q, lambda p: p[3])), 2)), 5) AS tangent FROM x""")
def fingertip_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    tips = F.posexplode(paired.fingertip_forces(F.col("embedding"), 5, 4)).alias("finger", "f")
    d = table(spark, sf_dir, "embeddings").select("vec_id", tips)
    return d.select("vec_id", "finger", F.round("f.normal", 5).alias("normal"), F.round("f.tangent", 5).alias("tangent"))


@query("""WITH {samples}, q AS (SELECT ch, quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM s GROUP BY ch)
SELECT ch, round(q[1], 4) AS p05, round(q[2], 4) AS p25, round(q[3], 4) AS p50, round(q[4], 4) AS p75, round(q[5], 4) AS p95 FROM q""")
def quantile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return rounded(quantiles.quantiles(samples(spark, sf_dir), ["ch"], "v", points), 4, *points)


FRAME_SQL = """WITH {samples}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, id) - 1 AS i FROM s),
f AS (SELECT k, id, t, i + CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END AS state_index FROM n WHERE ch = 'click'), st AS (SELECT k, i AS state_index, t AS state_t, v FROM n)"""


@query(FRAME_SQL + " SELECT k, id, state_index, state_t, v, coalesce(state_t <= t, false) AS causal FROM f LEFT JOIN st USING (k, state_index)")
def frames_with_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as frames that name a state by its place; every fifth names one two later."""
    n = samples(spark, sf_dir).withColumn("i", F.row_number().over(clock.in_order(K, *BY)) - 1)
    late = F.when(F.col("id") % 5 == 0, 2).otherwise(0)
    frames = n.where(F.col("ch") == "click").select("k", "id", "t", (F.col("i") + late).alias("state_index"))
    states = n.select("k", F.col("i").alias("state_index"), "t", "v")
    return paired.frames_with_states(frames, states, K, "state_index", "t").select("k", "id", "state_index", "state_t", "v", "causal")


PAIR_SQL = """WITH {samples}, o AS (SELECT k // 2 AS pair, k % 2 AS side, t, max(v) AS v FROM s GROUP BY ALL),
b AS (SELECT *, t - min(t) OVER (PARTITION BY pair, side) AS x FROM o),
c AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY pair, side ORDER BY x) - x, 0) AS dur FROM b),
e AS (SELECT pair, side, quantile_cont(dur, 0.5) FILTER (dur > 0) AS c, max(x) AS last FROM c GROUP BY pair, side),
u AS (SELECT c.*, CASE WHEN dur > 1.5 * e.c THEN 0 ELSE dur END AS d, e.c AS cad, last FROM c JOIN e USING (pair, side)),
j AS (SELECT l.pair, l.x, l.d, l.v AS reference, r.v AS rv, l.x - r.x AS age, r.cad, least(l.last, r.last) AS stop
  FROM (SELECT * FROM u WHERE side = 0) l ASOF JOIN (SELECT * FROM u WHERE side = 1) r ON l.pair = r.pair AND l.x >= r.x),
p AS (SELECT pair, x AS t, CAST(least(d, stop - x) AS BIGINT) AS dur, reference, CASE WHEN age <= 1.5 * cad THEN rv END AS rollout FROM j WHERE x < stop)"""


@query(PAIR_SQL + """, z AS (SELECT *, CASE WHEN reference IS NOT NULL AND rollout IS NOT NULL THEN dur END AS d FROM p)
SELECT pair, CAST(sum(dur) AS BIGINT) AS time, CAST(coalesce(sum(d), 0) AS BIGINT) AS compared, round(coalesce(sum(d), 0) / nullif(sum(dur), 0), 6) AS coverage, round(sum(reference * d) / nullif(sum(d), 0), 3) AS reference,
round(sum(rollout * d) / nullif(sum(d), 0), 3) AS rollout, round(sum(abs(rollout - reference) * d) / nullif(sum(d), 0), 3) AS mae, round(sum((rollout - reference) * d) / nullif(sum(d), 0), 3) AS bias FROM z GROUP BY pair""")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in pairs, the even one as the reference."""
    s = samples(spark, sf_dir).groupBy(F.floor(F.col("k") / 2).cast("long").alias("pair"), (F.col("k") % 2).alias("side"), "t").agg(F.max("v").alias("v"))
    side = lambda i: s.where(F.col("side") == i).select("pair", "t", "v")
    d = paired.paired_report(paired.paired(side(0), side(1), ["pair"], "t", "v"), ["pair"])
    return rounded(rounded(d, 6, "coverage"), 3, "reference", "rollout", "mae", "bias")


@query(f"""WITH {D_SQL}, tc AS (SELECT *, v > 100 AS on_ FROM d), b AS (SELECT *, CASE WHEN lag(on_) OVER w IS NOT DISTINCT FROM on_ AND NOT lag(gap) OVER w THEN 0 ELSE 1 END AS br FROM tc WINDOW w AS (PARTITION BY k ORDER BY t, id)),
r AS (SELECT *, sum(br) OVER (PARTITION BY k ORDER BY t, id) AS run FROM b), p AS (SELECT k, run, min(t) AS a, max(t + dur) AS e FROM r WHERE on_ GROUP BY k, run),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM p),
x AS (SELECT k, count(*) AS runs, max(e - a) AS longest, sum(greatest(0, e - greatest(a, coalesce(pe, a)))) AS covered FROM m GROUP BY k),
y AS (SELECT k, coalesce(sum(dur) FILTER (on_), 0) AS time, coalesce(sum(dur) FILTER (on_ IS NULL), 0) AS unknown, max(t) - min(t) AS span FROM tc GROUP BY k)
SELECT k, coalesce(runs, 0) AS runs, CAST(time AS BIGINT) AS time, coalesce(longest, 0) AS longest, CAST(unknown AS BIGINT) AS unknown, span, round(coalesce(covered, 0) / nullif(span, 0), 6) AS share FROM y LEFT JOIN x USING (k)""")
def contact_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = held(spark, sf_dir).withColumn("touch", F.col("v") > 100)
    return rounded(paired.continuity(d, K, BY, "t", "dur", "touch", "gap"), 6, "share")


ONSET_SQL = """WITH {samples}, c AS (SELECT *, v > 100 AS on_, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS n FROM s WINDOW w AS (PARTITION BY k ORDER BY t, id)),
r AS (SELECT *, sum(CASE WHEN lag_on IS NOT DISTINCT FROM on_ AND i > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT *, lag(on_) OVER (PARTITION BY k ORDER BY i) AS lag_on FROM c))
SELECT k, min(t) AS start, max(t) AS "end", count(*) AS samples, min(i) = 1 AS cut_left, max(i) = any_value(n) AS cut_right FROM r WHERE on_ GROUP BY k, run"""


@query(ONSET_SQL)
def contact_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.onsets(samples(spark, sf_dir).withColumn("touch", F.col("v") > 100), K, BY, "t", "touch")


@query(f"""WITH {D_SQL}, x AS (SELECT *, sum(CASE WHEN v < 400 AND NOT gap THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t DESC, id DESC) AS bad FROM (SELECT * EXCLUDE (gap), CASE WHEN lead(t) OVER (PARTITION BY k ORDER BY t, id) IS NULL THEN false ELSE gap END AS gap FROM d)),
e AS (SELECT k, min(t) FILTER (bad = 0) AS since, max(t) AS last FROM x GROUP BY k)
SELECT k, since IS NOT NULL AND last - since >= {12 * HOUR} AS stable FROM e""")
def terminal_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each record ends with twelve hours below the limit and without a gap."""
    s = held(spark, sf_dir)
    run = segments.trailing_run(s, K, BY, "t", (F.col("v") < 400) & ~F.col("gap"))
    last = s.groupBy("k").agg(F.max("t").alias("last")).join(run, "k", "left")
    return last.select("k", F.coalesce(F.col("last") - F.col("since") >= 12 * HOUR, F.lit(False)).alias("stable"))


@query(f"""WITH {{samples}}, h AS (SELECT k, t // {24 * HOUR} AS h, bool_or(ch = 'click' AND v > 100) AS a, bool_or(ch = 'view' AND v > 100) AS b FROM s GROUP BY ALL),
c AS (SELECT k, count(*) FILTER (a AND b) AS tp, count(*) FILTER (b) AS p, count(*) FILTER (a) AS n FROM h GROUP BY k)
SELECT k, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 6) AS precision, round(CASE WHEN n > 0 THEN tp / n ELSE 0 END, 6) AS recall, round(CASE WHEN p + n > 0 THEN 2 * tp / (p + n) ELSE 0 END, 6) AS f1 FROM c""")
def contact_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well one stream's contact (views) finds the other's (clicks), by day."""
    on = lambda ch: F.bool_or((F.col("ch") == ch) & F.coalesce(F.col("v") > 100, F.lit(False)))
    h = samples(spark, sf_dir).groupBy("k", F.floor(F.col("t") / (24 * HOUR)).alias("h")).agg(on("click").alias("a"), on("view").alias("b"))
    return rounded(evidence.detection_scores(h, K, "a", "b").drop("hits", "false_alarms", "misses"), 6, "precision", "recall", "f1")


@query("WITH o AS (" + ONSET_SQL + """), f AS (SELECT user_id AS k, event_id AS frame, epoch_us(ts) AS t FROM events WHERE event_id % 2 = 0)
SELECT o.k, start, "end", max(frame) FILTER (t < start AND t = b AND NOT cut_left) AS before, max(frame) FILTER (t = n AND NOT cut_left) AS "on", max(frame) FILTER (t = l AND NOT cut_right) AS last, max(frame) FILTER (t = a AND NOT cut_right) AS after
FROM (SELECT o.*, max(t) FILTER (t < start) AS b, min(t) FILTER (t >= start) AS n, max(t) FILTER (t <= "end") AS l, min(t) FILTER (t > "end") AS a FROM o LEFT JOIN f USING (k) GROUP BY ALL) o LEFT JOIN f USING (k) GROUP BY ALL""")
def onset_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames (every second event) around each contact's onset and release."""
    s = samples(spark, sf_dir)
    contacts = paired.onsets(s.withColumn("touch", F.col("v") > 100), K, BY, "t", "touch")
    frames = s.where(F.col("id") % 2 == 0).select("k", "t", F.col("id").alias("frame"))
    return paired.onset_frames(contacts, frames, K, "t", "frame")
