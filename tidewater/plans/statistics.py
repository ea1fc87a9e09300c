"""Statistics over events and embeddings (as 8 by 8 grids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import logic, numbers
from tidewater.operators import aggregates, clock, evidence, grids, quantiles
from tidewater.plans.registry import query, samples, table
from tidewater.plans.time import HELD_SQL, HOUR

K, BY = ["k"], ["t", "id"]


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.gap_aware(samples(spark, sf_dir), K, "t", "id")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


WEIGHTS_SQL = f"""WITH {HELD_SQL}, w AS (SELECT k, ch, id, t, v, CASE WHEN gap THEN 0 ELSE dur END AS d FROM g WHERE v IS NOT NULL),
x AS (SELECT *, sum(d) OVER (PARTITION BY k, ch ORDER BY v, t, id) AS cum, sum(d) OVER (PARTITION BY k, ch) AS tot FROM w WHERE d > 0),
q AS (SELECT k, ch, min(v) FILTER (cum >= 0.5 * tot) AS p50, min(v) FILTER (cum >= 0.95 * tot) AS p95 FROM x GROUP BY k, ch)"""


@query(f"""{WEIGHTS_SQL}, b AS (SELECT k, ch, count(*) AS samples, CAST(sum(d) AS BIGINT) AS weight,
  CASE WHEN sum(d) <> 0 THEN sum(v * d) / sum(d) END AS mean, CASE WHEN sum(d) <> 0 THEN sum(v * v * d) / sum(d) END AS sq, max(v) AS peak FROM w GROUP BY k, ch)
SELECT k, ch, samples, weight, round(mean, 3) AS mean, round(sqrt(greatest(sq - mean * mean, 0)), 3) AS std, peak, p50, p95 FROM b LEFT JOIN q USING (k, ch)""")
def left_hold_weighted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.weighted_stats(held(spark, sf_dir), ["k", "ch"], "v", "dur", BY), "mean", "std", digits=3)


@query(f"""{WEIGHTS_SQL} SELECT k, ch, p95 FROM q""")
def weighted_p95_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.weighted_quantiles(held(spark, sf_dir), ["k", "ch"], "v", "dur", {"p95": 0.95}, BY)


@query(f"""WITH {HELD_SQL}, d AS (SELECT *, CASE WHEN gap THEN 0 ELSE dur END AS d FROM g),
a AS (SELECT k, ch, count(*) AS total, count(v) AS valid, coalesce(sum(d) FILTER (v IS NOT NULL), 0) AS heldsum, sum(d) AS all_d,
  coalesce(sum(d) FILTER (v > 100), 0) AS contact, sum(v * d) AS impulse, max(v) AS peak, stddev_pop(v) / CASE WHEN avg(v) > 0 THEN avg(v) END AS cv FROM d GROUP BY k, ch)
SELECT k, ch, total, valid, round(CASE WHEN all_d <> 0 THEN heldsum / all_d END, 6) AS coverage, CAST(contact AS BIGINT) AS contact,
  round(CASE WHEN heldsum <> 0 THEN contact / heldsum END, 6) AS contact_share, round(impulse / 1e6, 2) AS impulse, peak, round(cv, 6) AS cv,
  (SELECT min(t) FROM d x WHERE x.k = a.k AND x.ch = a.ch AND x.v = a.peak) AS peak_time,
  CASE WHEN total = 0 OR valid = 0 THEN 'missing' WHEN valid < 1 THEN 'insufficient' WHEN valid < total THEN 'partial' ELSE 'available' END AS status FROM a""")
def channel_load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.channel_stats(held(spark, sf_dir), ["k", "ch"], "t", "v", "dur", 100.0).withColumn("impulse", F.round(F.col("impulse") / 1e6, 2))
    return rounded(out, "coverage", "contact_share", "cv", digits=6)


@query("""WITH {samples} SELECT k, ch, count(*) AS total, count(v) AS known, round(avg(v), 8) AS mean, min(v) AS min, max(v) AS max,
round(quantile_cont(v, 0.25), 8) AS p25, round(quantile_cont(v, 0.5), 8) AS median, round(quantile_cont(v, 0.75), 8) AS p75 FROM s GROUP BY k, ch""")
def episode_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.distribution(samples(spark, sf_dir), ["k", "ch"], "v"), "mean", "p25", "median", "p75", digits=8)


@query("""WITH {samples}, e AS (SELECT k, avg(v) AS m FROM s GROUP BY k)
SELECT count(*) AS total, count(m) AS known, round(avg(m), 8) AS mean, round(min(m), 8) AS min, round(max(m), 8) AS max,
round(quantile_cont(m, 0.25), 8) AS p25, round(quantile_cont(m, 0.5), 8) AS median, round(quantile_cont(m, 0.75), 8) AS p75 FROM e""")
def episode_first_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = samples(spark, sf_dir).groupBy("k").agg(F.avg("v").alias("m"))
    return rounded(quantiles.distribution(each, [], "m"), "mean", "min", "max", "p25", "median", "p75", digits=8)


@query("""WITH {samples}, m AS (SELECT ch, quantile_cont(v, 0.5) AS median FROM s GROUP BY ch)
SELECT ch, round(any_value(median), 4) AS median, round(quantile_cont(abs(v - median), 0.5), 4) AS mad FROM s JOIN m USING (ch) GROUP BY ch""")
def median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quantiles.median_mad(samples(spark, sf_dir), ["ch"], "v"), "median", "mad")


@query("""WITH {samples} SELECT k, round(greatest(1.0, quantile_cont(abs(v), 0.99)), 4) AS scale FROM s GROUP BY k""")
def percentile_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.percentile_scale(samples(spark, sf_dir), K, "v"), "scale")


@query("""WITH {samples}, r AS (SELECT ch, v FROM s WHERE k % 2 = 0 AND v IS NOT NULL), q AS (SELECT ch, id, v FROM s WHERE k % 2 = 1 AND v IS NOT NULL)
SELECT q.id, any_value(q.ch) AS ch, any_value(q.v) AS v, round(count(*) FILTER (r.v < q.v) / count(*), 6) AS below, round(count(*) FILTER (r.v <= q.v) / count(*), 6) AS upto
FROM q JOIN r USING (ch) GROUP BY q.id""")
def rank_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where(F.col("v").isNotNull())
    out = quantiles.rank_interval(s.where(F.col("k") % 2 == 1).select("ch", "id", "v"), s.where(F.col("k") % 2 == 0), ["ch"], "v")
    return rounded(out, "below", "upto", digits=6)


@query(f"""WITH {{samples}}, h AS (SELECT k, t // {24 * HOUR} AS h, avg(v) FILTER (ch = 'click') AS a, avg(v) FILTER (ch = 'view') AS b FROM s GROUP BY ALL)
SELECT k, count(*) AS pairs, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 4) AS corr, round(sqrt(avg((a - b) * (a - b))), 4) AS rms, round(avg(abs(a - b)), 8) AS mae, round(avg(a - b), 8) AS bias
FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY k""")
def stream_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("t") / (24 * HOUR)).cast("long")
    mean = lambda c: F.avg(F.when(F.col("ch") == c, F.col("v")))
    h = samples(spark, sf_dir).groupBy("k", day.alias("h")).agg(mean("click").alias("a"), mean("view").alias("b"))
    out = aggregates.agreement(h, K, "a", "b").withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))
    return rounded(rounded(out, "corr", "rms"), "mae", "bias", digits=8)


@query("""WITH x AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS f FROM embeddings, range(5) r(i)),
y AS (SELECT vec_id, i, CASE WHEN f > -0.15 THEN greatest(f, 0) END AS f, 1 + vec_id % 3 AS w FROM x),
z AS (SELECT *, count(f) OVER (PARTITION BY vec_id) AS n, sum(f) OVER (PARTITION BY vec_id) AS t FROM y)
SELECT CAST(i AS INTEGER) AS finger, CAST(sum(w) AS BIGINT) AS weight, round(sum(f / t * w) / sum(w), 6) AS share FROM z WHERE n = 5 AND t > 0.05 GROUP BY i""")
def load_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", (1 + F.col("vec_id") % 3).alias("w"), F.posexplode(F.slice("embedding", 1, 5)).alias("finger", "f"))
    e = e.withColumn("f", F.when(F.col("f") > -0.15, F.greatest(F.col("f").cast("double"), F.lit(0.0))))
    return rounded(aggregates.load_shares(e, ["vec_id"], "finger", "f", "w", 5, 0.05), "share", digits=6)


@query("""WITH {samples}, r AS (SELECT *, row_number() OVER (PARTITION BY k, ch ORDER BY v, id) AS lo, row_number() OVER (PARTITION BY k, ch ORDER BY v DESC, id) AS hi FROM s WHERE v IS NOT NULL)
SELECT k, ch, count(*) AS n, min(id) FILTER (lo = 1) AS argmin, min(v) AS min, min(id) FILTER (hi = 1) AS argmax, max(v) AS max FROM r GROUP BY k, ch""")
def argmin_argmax_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.extremes(samples(spark, sf_dir).where(F.col("v").isNotNull()), ["k", "ch"], "v", "id")


@query("""WITH {samples}, m AS (SELECT *, ch = 'view' AS inside FROM s),
x AS (SELECT *, CASE WHEN inside AND lag(inside) OVER w THEN v - lag(v) OVER w END AS d FROM m WINDOW w AS (PARTITION BY k ORDER BY t, id))
SELECT k, round(stddev_pop(v) FILTER (inside), 4) AS std, round(sqrt(avg(d * d)), 4) AS rms FROM x GROUP BY k""")
def adjacent_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("inside", F.col("ch") == "view")
    return rounded(aggregates.adjacent_rms(s, K, BY, "v", "inside"), "std", "rms")


@query("""WITH {samples}, x AS (SELECT k, 0.5 * (v + lag(v) OVER w) * (t - lag(t) OVER w) / 1e6 AS a FROM s WINDOW w AS (PARTITION BY k ORDER BY t, id))
SELECT k, round(sum(a), 2) AS integral, count(a) AS steps FROM x GROUP BY k""")
def slip_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("sec", F.col("t") / 1e6)
    return rounded(aggregates.trapezoid(s, K, BY, "sec", "v"), "integral", digits=2)


@query("""WITH {samples}, h AS (SELECT ch, t, v, 400.0::DOUBLE AS threshold FROM s WHERE v > 400)
SELECT ch, threshold, min(t) AS first, max(t) AS last, count(*) AS n, min(v) AS least, max(v) AS most,
(SELECT max(v) FROM h y WHERE y.ch = h.ch AND y.t = max(h.t)) AS latest FROM h GROUP BY ch, threshold""")
def guard_event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.guard_events(samples(spark, sf_dir).withColumn("threshold", F.lit(400.0)), ["ch"], "t", "v", "threshold")


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, count(*) AS n, count(*) FILTER (x > 0.1 OR x < -0.1) AS clipped,
round(max(greatest(x - 0.1, -0.1 - x, 0)), 6) AS excess FROM x GROUP BY ALL""")
def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.clip_counts(table(spark, sf_dir, "embeddings"), ["label"], "embedding", -0.1, 0.1), "excess", digits=6)


GRID_SQL = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0.0)) AS g FROM embeddings),
c AS (SELECT vec_id, label, g, list_sum(g) AS tot FROM e)"""


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", grids.loads(F.col("embedding")).alias("g"))


@query(GRID_SQL + """ SELECT vec_id, round(tot, 4) AS load,
round(CASE WHEN tot > 0 THEN list_sum(list_transform(g, lambda x, i: x * ((i - 1) // 8))) / tot END, 4) AS row,
round(CASE WHEN tot > 0 THEN list_sum(list_transform(g, lambda x, i: x * ((i - 1) % 8))) / tot END, 4) AS col,
round(CASE WHEN tot > 0 THEN list_sum(list_transform(g, lambda x: x * x)) / (tot * tot) END, 6) AS concentration FROM c""")
def center_of_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("g")
    row, col = grids.centre(g, 8)
    return loaded(spark, sf_dir).select(
        "vec_id", F.round(grids.total(g), 4).alias("load"), F.round(row, 4).alias("row"), F.round(col, 4).alias("col"),
        F.round(grids.concentration(g), 6).alias("concentration"),
    )


@query(GRID_SQL + """, r AS (SELECT label, g AS rg, tot AS rtot FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
SELECT vec_id, c.label, round(CASE WHEN tot > 0 AND rtot > 0 THEN list_sum(list_transform(list_zip(g, rg), lambda p: abs(p[1] / tot - p[2] / rtot))) / 2 END, 6) AS tv
FROM c JOIN r USING (label)""")
def tv_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = loaded(spark, sf_dir)
    first = e.groupBy("label").agg(F.min(F.struct("vec_id", "g")).getField("g").alias("rg"))
    return e.join(first, "label").select("vec_id", "label", F.round(grids.variation(F.col("g"), F.col("rg")), 6).alias("tv"))


@query("""WITH w AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(embedding[1] AS DOUBLE) AS f FROM embeddings),
x AS (SELECT *, exp(-(power(i // 8 - (vec_id % 64) // 8, 2) + power(i % 8 - vec_id % 64 % 8, 2)) / 2.0) AS k FROM w),
y AS (SELECT *, k / sum(k) OVER (PARTITION BY vec_id) * f AS s FROM x)
SELECT vec_id, round(max(abs(s)), 6) AS peak, round(sum(s), 6) AS total FROM y GROUP BY vec_id""")
def gaussian_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    spread = grids.kernel(F.col("embedding"), F.col("vec_id") % 64, 8, 1.0, F.col("embedding")[0].cast("double"))
    d = e.select("vec_id", spread.alias("s"))
    return d.select("vec_id", F.round(F.array_max(F.transform("s", F.abs)), 6).alias("peak"), F.round(grids.total(F.col("s")), 6).alias("total"))


@query("""SELECT vec_id, [embedding[4], embedding[1], embedding[3]] AS picked FROM embeddings""")
def columns_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"j{i}" for i in range(64)]
    return grids.by_names(table(spark, sf_dir, "embeddings"), "embedding", names, ["j3", "j0", "j2"], "picked").select("vec_id", "picked")


@query("""WITH x AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[5:8], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)
SELECT vec_id, round(atan2(2 * (a[1] * a[4] + a[2] * a[3]), 1 - 2 * (a[3] * a[3] + a[4] * a[4])), 5) AS yaw,
round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 5) AS cosine,
round(abs(list_sum(list_transform([1, 2, 3, 4], lambda i: a[i] * b[i % 4 + 1] - a[i % 4 + 1] * b[i]))) / 2, 6) AS area FROM x""")
def pose_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.transform(F.slice("embedding", i, 4), lambda x: x.cast("double"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", part(1).alias("a"), part(5).alias("b"))
    a, b = F.col("a"), F.col("b")
    return d.select(
        "vec_id", F.round(numbers.yaw(a), 5).alias("yaw"), F.round(numbers.cosine(a, b), 5).alias("cosine"), F.round(numbers.shoelace(a, b), 6).alias("area")
    )


@query("""WITH {samples}, x AS (SELECT *, v > 100 AS a, CASE WHEN id % 5 = 0 THEN NULL ELSE v < 300 END AS b FROM s)
SELECT ch, count(*) AS n, count(a AND b) AS known, count(*) FILTER (a AND b) AS yes, count(*) FILTER (a OR b) AS either,
round(count(*) FILTER (a AND b) / count(a AND b), 6) AS rate FROM x GROUP BY ch""")
def kleene_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = logic.predicate({"field": "v", "op": "gt", "value": 100})
    b = F.when(F.col("id") % 5 != 0, logic.predicate({"field": "v", "op": "lt", "value": 300}))
    d = samples(spark, sf_dir).select("ch", logic.all_of(a, b).alias("both"), logic.any_of(a, b).alias("any"))
    yes = F.count_if(logic.is_true(F.col("both")))
    return d.groupBy("ch").agg(
        F.count("*").alias("n"), F.count("both").alias("known"), yes.alias("yes"), F.count_if(logic.is_true(F.col("any"))).alias("either"),
        F.round(numbers.ratio(yes.cast("double"), F.count("both")), 6).alias("rate"),
    )


@query("""SELECT vec_id, list_max(embedding) >= 0.2 AS peak_ok, abs(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 64 - 0.01) < 0.02 AS mean_ok,
sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) <= 1.0001 AS norm_ok FROM embeddings""")
def declared_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {
        "peak_ok": {"field": "embedding", "op": "ge", "value": 0.2, "reduce": "max", "length": 64},
        "mean_ok": {"field": "embedding", "op": "abs_lt", "value": 0.02, "reduce": "mean", "length": 64, "center": 0.01},
        "norm_ok": {"field": "embedding", "op": "le", "value": 1.0001, "reduce": "norm", "length": 64},
    }
    return table(spark, sf_dir, "embeddings").select("vec_id", *[logic.predicate(s).alias(n) for n, s in spec.items()])


@query("""SELECT vec_id, CASE WHEN len(list_filter(embedding[1:5], lambda x: x < -0.15)) = 0 THEN round(list_sum(list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE))), 5) END AS strict_total,
CASE WHEN embedding[1] >= -0.15 AND embedding[2] >= -0.15 THEN round(CAST(embedding[1] AS DOUBLE) + embedding[2], 5) END AS two FROM embeddings""")
def strict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, 5), lambda v: F.when(v >= -0.15, v.cast("double")))
    d = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    two = logic.strict_total(F.col("x")[0], F.col("x")[1])
    return d.select("vec_id", F.round(logic.strict_array_sum(F.col("x")), 5).alias("strict_total"), F.round(two, 5).alias("two"))


@query(f"""WITH {HELD_SQL}, m0 AS (SELECT k, id, t, coalesce(lag(gap) OVER w, false) AS late, round(sum(coalesce(v, 0)) OVER w, 4) AS base FROM g WINDOW w AS (PARTITION BY k ORDER BY t, id)),
m AS (SELECT *, CASE WHEN id % 23 = 0 THEN NULL WHEN id % 31 = 0 THEN base - 100 ELSE base END AS total FROM m0),
b AS (SELECT *, last_value(total IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
j AS (SELECT *, sum(CASE WHEN late OR total IS NULL OR coalesce(total < before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, id) AS bad FROM b),
f AS (SELECT *, first_value({{'total': total, 'bad': bad}}) OVER (PARTITION BY k ORDER BY t, id) AS f FROM j),
r AS (SELECT k, t, arg_max({{'total': total, 'bad': bad}}, id) AS then_ FROM j GROUP BY k, t),
o AS (SELECT f.*, r.t AS rt, coalesce(r.then_, f.f) AS then_ FROM f ASOF LEFT JOIN r ON f.k = r.k AND f.t - {24 * HOUR} >= r.t)
SELECT k, id, round(CASE WHEN rt IS NOT NULL AND bad = then_.bad AND then_.total IS NOT NULL THEN (total - then_.total) / ((t - rt) / 3.6e9) END, 4) AS mean, rt IS NULL AND bad = then_.bad AND then_.total IS NOT NULL AS brief FROM o""")
def lookback_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter of what was measured, unknown in every 23rd row and fallen in every 31st."""
    s = held(spark, sf_dir)
    base = F.round(F.sum(F.coalesce("v", F.lit(0.0))).over(clock.in_order(K, "t", "id")), 4)
    s = s.withColumn("total", F.when(F.col("id") % 23 != 0, F.when(F.col("id") % 31 == 0, base - 100).otherwise(base)))
    return rounded(evidence.lookback_mean(s, K, "t", "id", "total", "gap", 24 * HOUR, HOUR).select("k", "id", "mean", "brief"), "mean")


@query(f"""WITH {{samples}}, x AS (SELECT k, id, t, v, greatest(lag(t) OVER (PARTITION BY k ORDER BY t, id), max(t) OVER (PARTITION BY k) - {36 * HOUR}) AS f FROM s),
y AS (SELECT *, greatest(t - f, 0) AS d FROM x WHERE f IS NOT NULL)
SELECT k, CAST(sum(d) AS BIGINT) AS time, round(sum(v * d) / nullif(sum(d) FILTER (v IS NOT NULL), 0), 4) AS mean, max(abs(v)) FILTER (d > 0) AS most FROM y GROUP BY k""")
def tail_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = aggregates.tail_summary(samples(spark, sf_dir).withColumn("time_", F.col("t")), K, BY, "t", "v", 36 * HOUR)
    return rounded(d, "mean")


@query("""WITH x AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)
SELECT vec_id, round(f[1], 6) AS thumb, round(f[2] + f[3] + f[4] + f[5], 6) AS others, len(list_filter(f, lambda x: x > 0.05)) - len(list_filter(f[1:1], lambda x: x > 0.05)) AS other_contacts FROM x""")
def finger_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thumb against the sum of the other fingers, and contacts other than its own."""
    f = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", f.alias("f"))
    touching = lambda a: F.size(F.filter(a, lambda x: x > 0.05))
    others = logic.strict_array_sum(F.slice("f", 2, 4))
    count = (touching(F.col("f")) - touching(F.slice("f", 1, 1))).cast("long").alias("other_contacts")
    return d.select("vec_id", F.round(F.col("f")[0], 6).alias("thumb"), F.round(others, 6).alias("others"), count)
