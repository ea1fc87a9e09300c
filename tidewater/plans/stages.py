"""Stage programs and progress over events.

An event's value stands for every measurement, and hours for seconds: thresholds
are chosen so that all stages occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import clock, progress, stages
from tidewater.operators.stages import Hold, Stage
from tidewater.plans.registry import query, samples
from tidewater.plans.time import HELD_SQL, HOUR

K = ["k"]
V = F.col
LATE_SQL = HELD_SQL + """,
b0 AS (SELECT *, coalesce(dt > 1.5 * cadence, false) AS late, row_number() OVER (PARTITION BY k ORDER BY t, id) AS p FROM g)"""


def hold_sql(source: str, name: str, condition: str) -> str:
    """CTEs that add <name>_h, how long the condition has held."""
    return f"""{name}_a AS (SELECT *, coalesce({condition}, false) AS c FROM {source}),
{name}_b AS (SELECT *, sum(CASE WHEN c THEN CASE WHEN late THEN 1 ELSE 0 END ELSE 1 END) OVER (PARTITION BY k ORDER BY t, id) AS i FROM {name}_a),
{name} AS (SELECT * EXCLUDE (c, i), CASE WHEN c THEN t - min(CASE WHEN c THEN t END) OVER (PARTITION BY k, i ORDER BY t, id) END AS {name}_h FROM {name}_b)"""


def latch_sql(source: str, name: str, condition: str) -> str:
    """A CTE that adds <name>_f, the place of the first row at which the condition is true."""
    return f"{name} AS (SELECT *, min(CASE WHEN {condition} THEN p END) OVER (PARTITION BY k) AS {name}_f FROM {source})"


def report_sql(source: str, named: dict[str, str]) -> str:
    """The report over latches: stage name -> latch column."""
    times = ", ".join(f"min(t) FILTER (p = {f}) AS {n}" for n, f in named.items())
    count = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END" for n in named)
    failure = " ".join(f"WHEN {n} IS NULL THEN '{n}'" for n in named)
    last = list(named)[-1]
    return f""", rep AS (SELECT k, {times}, count(*) AS samples, count(*) FILTER (late) AS gaps FROM {source} GROUP BY k)
SELECT *, {count} AS highest_stage, {last} IS NOT NULL AS success, CASE {failure} END AS failure_stage FROM rep"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return stages.gaps(s.join(clock.cadence(s, K, "t", "id"), K), K, "t", "id", F.col("cadence") * 1.5)


def report(spark: SparkSession, sf_dir: str, program: list[Stage]) -> DataFrame:
    return stages.stage_report(measured(spark, sf_dir), K, "t", "id", "late", program)


@query(f"""WITH {LATE_SQL}, {hold_sql('b0', 'd', 'v > 60')}, {latch_sql('d', 'l1', f'd_h >= {2 * HOUR}')},
{hold_sql('l1', 'q', 'v > 40')}, {latch_sql('q', 'l2', f'q_h >= {4 * HOUR} AND p >= l1_f')},
{hold_sql('l2', 'r', "(coalesce(p >= l2_f, false)) AND v > 20")}, {latch_sql('r', 'l3', f'r_h > {6 * HOUR} AND p >= l2_f')}
{report_sql('l3', {'drag': 'l1_f', 'grasp': 'l2_f', 'terminal': 'l3_f'})}""")
def stage_strict_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw: drag, grasp, then strictly longer than the terminal hold, which starts only behind the grasp."""
    return report(spark, sf_dir, [
        Stage("drag", (Hold(lambda _: V("v") > 60, 2 * HOUR),)),
        Stage("grasp", (Hold(lambda _: V("v") > 40, 4 * HOUR),)),
        Stage("terminal", (Hold(lambda before: before & (V("v") > 20), 6 * HOUR, strict=True),)),
    ])


@query(f"""WITH {LATE_SQL}, {hold_sql('b0', 'a', 'v > 40')}, {hold_sql('a', 'b', "v > 40 AND ch <> 'error'")}, {hold_sql('b', 'n', 'v > 40 AND v < 400')}, {hold_sql('n', 'd', 'v < 300')},
{latch_sql('d', 'l1', f'b_h >= {2 * HOUR}')}, {latch_sql('l1', 'l2', f'a_h >= {2 * HOUR} AND n_h >= {2 * HOUR} AND p >= l1_f')}, {latch_sql('l2', 'l3', f'd_h >= {4 * HOUR} AND p >= l2_f')}
{report_sql('l3', {'picked_up': 'l1_f', 'held_near': 'l2_f', 'seated': 'l3_f'})}""")
def stage_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert: picked up, held near the socket in a stable grasp, seated."""
    grasp = Hold(lambda _: V("v") > 40, 2 * HOUR)
    return report(spark, sf_dir, [
        Stage("picked_up", (Hold(lambda _: (V("v") > 40) & (V("ch") != "error"), 2 * HOUR),)),
        Stage("held_near", (grasp, Hold(lambda _: (V("v") > 40) & (V("v") < 400), 2 * HOUR))),
        Stage("seated", (Hold(lambda _: V("v") < 300, 4 * HOUR),)),
    ])


@query(f"""WITH {LATE_SQL}, {latch_sql('b0', 'l1', 'v > 50')}, {hold_sql('l1', 'd', 'v < 300')}, {latch_sql('d', 'l2', f'd_h >= {4 * HOUR} AND v < 300 AND p >= l1_f')},
{latch_sql('l2', 'l3', 'v > 100 AND p >= l2_f')}, {latch_sql('l3', 'l4', "ch = 'view' AND p >= l3_f")}
{report_sql('l4', {'grasped': 'l1_f', 'seated': 'l2_f', 'tightened': 'l3_f', 'released': 'l4_f'})}""")
def stage_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In place: grasped, seated, tightened, released."""
    now = lambda c: (Hold(lambda _: c, 0),)
    return report(spark, sf_dir, [
        Stage("grasped", now(V("v") > 50)), Stage("seated", (Hold(lambda _: V("v") < 300, 4 * HOUR),)),
        Stage("tightened", now(V("v") > 100)), Stage("released", now(V("ch") == "view")),
    ])


@query(f"""WITH {LATE_SQL}, {hold_sql('b0', 'u', 'v > 60')}, u2 AS (SELECT *, bool_or(coalesce(u_h >= {4 * HOUR}, false)) OVER (PARTITION BY k ORDER BY t, id) AS ever FROM u),
{hold_sql('u2', 'a', 'v > 40')}, {hold_sql('a', 'b', 'v > 40 AND v < 400')}, {latch_sql('b', 'l1', f'ever AND a_h >= {2 * HOUR} AND b_h >= {2 * HOUR}')},
{hold_sql('l1', 'd', 'v < 300')}, {latch_sql('d', 'l2', f'd_h >= {4 * HOUR} AND p >= l1_f')}
{report_sql('l2', {'held_near': 'l1_f', 'seated': 'l2_f'})}""")
def stage_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Install: the pickup counts from any time before, gaps or not; then near and seated."""
    lifted = Hold(lambda _: V("v") > 60, 4 * HOUR, ever=True)
    near = Hold(lambda _: (V("v") > 40) & (V("v") < 400), 2 * HOUR)
    return report(spark, sf_dir, [
        Stage("held_near", (lifted, Hold(lambda _: V("v") > 40, 2 * HOUR), near)),
        Stage("seated", (Hold(lambda _: V("v") < 300, 4 * HOUR),)),
    ])


@query(f"""WITH {LATE_SQL}, {hold_sql('b0', 'n', 'v > 30')}, {latch_sql('n', 'l1', f'n_h >= {2 * HOUR}')}, {hold_sql('l1', 'd', "v > 30 AND ch <> 'error'")}, {latch_sql('d', 'l2', f'd_h >= {8 * HOUR} AND p >= l1_f')}
{report_sql('l2', {'clear': 'l1_f', 'held': 'l2_f'})}""")
def stage_unplug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unplug: clear, then clear and held for long."""
    return report(spark, sf_dir, [
        Stage("clear", (Hold(lambda _: V("v") > 30, 2 * HOUR),)),
        Stage("held", (Hold(lambda _: (V("v") > 30) & (V("ch") != "error"), 8 * HOUR),)),
    ])


@query(f"""WITH {LATE_SQL}, {hold_sql('b0', 'n', 'v > 20')}, st AS (SELECT *, sum(CASE WHEN n_h IS NULL OR n_h = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, id) AS stretch FROM n),
o AS (SELECT *, first_value(CASE WHEN v IS NOT NULL AND n_h >= {2 * HOUR} THEN v END IGNORE NULLS) OVER (PARTITION BY k, stretch ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS origin FROM st),
m AS (SELECT *, bool_or(coalesce(v IS NOT NULL AND n_h >= {2 * HOUR} AND abs(v - origin) >= 50, false)) OVER (PARTITION BY k ORDER BY t, id) AS moved FROM o)
SELECT k, id, moved FROM m""")
def carried_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stages.transported(measured(spark, sf_dir), K, "t", "id", "late", F.col("v") > 20, ["v"], 2 * HOUR, 50.0)
    return d.select("k", "id", "moved")


@query(f"""WITH {LATE_SQL}, {hold_sql('b0', 'n', 'v > 20')}, st AS (SELECT *, sum(CASE WHEN n_h IS NULL OR n_h = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, id) AS stretch FROM n),
o AS (SELECT *, first_value(CASE WHEN v IS NOT NULL AND n_h >= {2 * HOUR} THEN v END IGNORE NULLS) OVER (PARTITION BY k, stretch ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS origin FROM st),
m AS (SELECT *, bool_or(coalesce(v IS NOT NULL AND n_h >= {2 * HOUR} AND abs(v - origin) >= 50, false)) OVER (PARTITION BY k ORDER BY t, id) AS moved FROM o),
{latch_sql('m', 'l1', f'n_h >= {2 * HOUR}')}, {hold_sql('l1', 'pl', "moved AND v > 20 AND ch <> 'error'")},
pe AS (SELECT *, bool_or(coalesce(pl_h >= {2 * HOUR}, false)) OVER (PARTITION BY k ORDER BY t, id) AS placed FROM pl),
{hold_sql('pe', 'rl', 'coalesce(p >= l1_f, false) AND moved AND v < 250')}, {latch_sql('rl', 'l2', f'placed AND rl_h >= {2 * HOUR} AND p >= l1_f')}
{report_sql('l2', {'extracted': 'l1_f', 'released': 'l2_f'})}""")
def stage_unscrew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unscrew: extracted, then released on the table behind a verified transport and placement."""
    d = stages.transported(measured(spark, sf_dir), K, "t", "id", "late", F.col("v") > 20, ["v"], 2 * HOUR, 50.0)
    placed = Hold(lambda _: F.col("moved") & (V("v") > 20) & (V("ch") != "error"), 2 * HOUR, ever=True)
    program = [
        Stage("extracted", (Hold(lambda _: V("v") > 20, 2 * HOUR),)),
        Stage("released", (placed, Hold(lambda before: before & F.col("moved") & (V("v") < 250), 2 * HOUR))),
    ]
    return stages.stage_report(d, K, "t", "id", "late", program)


@query(f"""WITH {LATE_SQL}, {hold_sql('b0', 'x1', 'v > 20')}, {latch_sql('x1', 'l1', f'x1_h >= {HOUR}')}, {hold_sql('l1', 'x2', 'v > 60 AND coalesce(p > l1_f, false)')}, {latch_sql('x2', 'l2', 'x2_h >= 0')},
{hold_sql('l2', 'x3', "v > 30 AND ch <> 'error' AND coalesce(p > l2_f, false)")}, {latch_sql('x3', 'l3', f'x3_h >= {2 * HOUR}')},
f AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM l3),
r AS (SELECT k, min(t) FILTER (p = l1_f) AS p_contact, min(t) FILTER (p = l2_f) AS p_edge, min(t) FILTER (p = l3_f) AS p_lift, bool_or(p = n AND coalesce(v < 300, false)) AS fin, bool_or(coalesce(v > 480, false) AND (l3_f IS NULL OR p <= l3_f)) AS observed_failure FROM f GROUP BY k)
SELECT k, p_contact, p_edge, p_lift, CAST((p_contact IS NOT NULL)::INT + (p_edge IS NOT NULL)::INT + (p_lift IS NOT NULL)::INT AS INTEGER) AS completed, observed_failure, p_lift IS NOT NULL AND fin AND NOT observed_failure AS verdict FROM r""")
def phase_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declarative review: contact, edge, lift, in sequence, with a failure rule."""
    d = measured(spark, sf_dir).withColumn("contact", F.col("v") > 20).withColumn("edge", F.col("v") > 60)
    d = d.withColumn("lift", (F.col("v") > 30) & (F.col("ch") != "error")).withColumn("end", F.col("v") < 300).withColumn("lost", F.col("v") > 480)
    return stages.phase_program(d, K, "t", "id", "late", [("p_contact", "contact", HOUR), ("p_edge", "edge", 0), ("p_lift", "lift", 2 * HOUR)], "end", "lost")


EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
PROGRESS_SQL = f"""WITH {HELD_SQL}, e AS (SELECT g.*, round(percent_rank() OVER (PARTITION BY k ORDER BY t, id), 9) AS pr FROM g),
z AS (SELECT *, CASE WHEN id % 13 <> 0 THEN least(4, CAST(floor(pr * 5 + 1e-9) AS INTEGER)) END AS bin FROM e),
y AS (SELECT *, CASE WHEN lag(bin) OVER w IS NULL OR lag(bin) OVER w <> bin OR lag(gap) OVER w THEN 1 ELSE 0 END AS fresh,
  CASE WHEN NOT gap THEN lead(t) OVER w - t END AS ddt FROM z WINDOW w AS (PARTITION BY k ORDER BY t, id)),
bins AS (SELECT k, bin, count(*) AS samples, CAST(sum(fresh) AS BIGINT) AS visits, min(t) AS first, CAST(coalesce(sum(ddt), 0) AS BIGINT) AS observed,
  CASE WHEN sum(ddt) FILTER (v IS NOT NULL) <> 0 THEN sum(v * ddt) / sum(ddt) FILTER (v IS NOT NULL) END AS mean, max(v) AS peak FROM y WHERE bin IS NOT NULL GROUP BY k, bin)"""


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = clock.gap_aware(samples(spark, sf_dir), K, "t", "id")
    pr = F.round(F.percent_rank().over(clock.in_order(K, "t", "id")), 9)
    g = g.withColumn("_pr", pr).withColumn("progress", F.when(F.col("id") % 13 != 0, F.col("_pr")))
    return progress.progress_bins(g, K, "t", "id", "progress", "gap", "v", EDGES)


@query(PROGRESS_SQL + " SELECT k, bin, samples, visits, first, observed, round(mean, 4) AS mean, peak FROM bins")
def progress_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(spark, sf_dir).drop("delta").withColumn("mean", F.round("mean", 4))


@query(PROGRESS_SQL + " SELECT bin, count(*) AS episodes, count(mean) AS known, round(avg(mean), 4) AS mean, round(quantile_cont(mean, 0.5), 4) AS median FROM bins GROUP BY bin")
def progress_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.population(binned(spark, sf_dir), [], "mean").withColumns({c: F.round(c, 4) for c in ("mean", "median")})


@query("""WITH {samples}, i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, id) AS i, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k, ch ORDER BY v DESC NULLS LAST, t, id) AS pk FROM s),
r AS (SELECT *, CASE WHEN i = 1 OR i = n THEN 0 WHEN pk = 1 AND v IS NOT NULL THEN 1 WHEN i % greatest(1, n // 12) = 0 THEN 2 END AS r FROM i),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, i) AS o FROM r WHERE r IS NOT NULL)
SELECT k, id, CASE r WHEN 0 THEN 'end' WHEN 1 THEN 'peak' ELSE 'spread' END AS why FROM o WHERE o <= 12""")
def key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.key_frames(samples(spark, sf_dir), K, "t", "id", "ch", "v", 12).select("k", "id", "why")


@query(f"""WITH {{samples}}, c AS (SELECT k, t // {24 * HOUR} AS cell, v, t FROM s)
SELECT k, cell, min(v) AS low, min(t) FILTER (v = lo) AS low_t, max(v) AS high, min(t) FILTER (v = hi) AS high_t, count(*) FILTER (v IS NULL) AS unknown
FROM (SELECT *, min(v) OVER (PARTITION BY k, cell) AS lo, max(v) OVER (PARTITION BY k, cell) AS hi FROM c) GROUP BY k, cell""")
def plot_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.decimated(samples(spark, sf_dir), K, "t", "v", 24 * HOUR)


@query("""WITH {samples}, p AS (SELECT k, t, id, CASE WHEN k % 2 = 0 THEN coalesce(v, 0) ELSE v END AS x, id % 100 / 10.0::DOUBLE AS y FROM s),
q AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS st FROM p WINDOW w AS (PARTITION BY k ORDER BY t, id)),
e AS (SELECT k, sum(st) AS path, count(*) = count(x) AS whole, first(x ORDER BY t, id) AS x0, first(y ORDER BY t, id) AS y0, last(x ORDER BY t, id) AS x1, last(y ORDER BY t, id) AS y1 FROM q GROUP BY k)
SELECT k, round(coalesce(path, 0), 4) AS path, round(CASE WHEN whole THEN sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) END, 4) AS net FROM e""")
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    x = F.when(F.col("k") % 2 == 0, F.coalesce("v", F.lit(0.0))).otherwise(F.col("v"))
    d = s.select("k", "t", "id", x.alias("x"), (F.col("id") % 100 / 10.0).alias("y"))
    return progress.path_length(d, K, ["t", "id"], ["x", "y"]).withColumns({c: F.round(c, 4) for c in ("path", "net")})
