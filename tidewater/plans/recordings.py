"""Audits of recordings: a user's events are the states of one recording, with faults planted by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.numbers import micros
from tidewater.operators import recordings
from tidewater.operators.clock import in_order
from tidewater.operators.recordings import Rule
from tidewater.plans.registry import query, table

K, PERIOD, RATES = ["k"], 2000, {"head": 30, "wrist": 50}


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States each 2 ms: x adds up whole velocities; clocks, places, quaternions and numbers are off where the id says so."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), micros(F.col("ts")).alias("at"), "value")
    i = F.col("id")
    d = e.withColumn("i", (F.row_number().over(in_order(K, "at", "id")) - 1).cast("long"))
    d = d.withColumn("v", F.floor("value").cast("double") * 500)
    d = d.withColumn("x", F.coalesce(F.sum(F.when(F.col("i") > 0, F.col("v"))).over(in_order(K, "i")), F.lit(0.0)) / 500)
    return d.select(
        "k", "id", "i", (F.col("i") * PERIOD + F.when(i % 97 == 0, 500).otherwise(0)).cast("long").alias("t"),
        F.array(F.col("x") + F.when(i % 101 == 0, 1.0).otherwise(0.0)).alias("p"),
        F.array(F.when(i % 89 != 0, F.col("v"))).alias("v"),
        F.array(F.lit(0.6), F.lit(0.0), F.lit(0.0), F.when(i % 103 == 0, 0.9).otherwise(0.8)).alias("q"),
    )


def frames(d: DataFrame) -> DataFrame:
    """Frames of two cameras at their states, without every 31st, every 43rd twice, every 37th naming the state before."""
    ends = d.groupBy("k").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    both = d.join(ends, "k").withColumn("c", F.explode(F.array(*map(F.lit, RATES))))
    due: Column = F.lit(False)
    for c, rate in RATES.items():
        due = due | ((F.col("c") == c) & F.array_contains(recordings.deadlines(F.col("lo"), F.col("hi"), rate, PERIOD), F.col("t")))
    i = F.col("id")
    times = F.when(i % 31 == 0, F.array().cast("array<int>")).when(i % 43 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shown = both.where(due).withColumn("n", F.explode(times))
    return shown.select("k", "c", "t", F.when(i % 37 == 0, F.col("i") - 1).otherwise(F.col("i")).alias("state"))


def rules() -> list[Rule]:
    """The table of rules over states, counts and frames."""
    return [
        Rule("known", "state", recordings.finite(F.col("p"), 1) & recordings.finite(F.col("v"), 1)),
        Rule("quaternion", "state", recordings.unit_length(F.col("q"))),
        Rule("period", "state", F.coalesce(F.col("step") == PERIOD, F.col("i") == 0)),
        Rule("integration", "state", (F.col("i") == 0) | (F.col("residual") <= 1e-6)),
        Rule("standing", "state", ~F.coalesce("repeated", F.lit(False)), warning=True),
        Rule("lengths", "length", F.col("rows") == F.col("expected")),
        Rule("frames", "frame", F.col("due") & (F.col("seen") == 1)),
        Rule("frame_state", "frame", F.coalesce("matched", F.lit(True))),
        Rule("frame_count", "frame", F.col("seen") <= 1, warning=True),
    ]


def audit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States with their steps, the schedule of frames, and the findings."""
    d = states(spark, sf_dir)
    own = recordings.stepped(d, K, "i", "t", "p", "v")
    counted = recordings.lengths(d, {"touch": d.where(F.col("id") % 113 != 0), "command": d}, K)
    seen = recordings.scheduled(frames(d), d, K, "c", "t", "state", "i", RATES, PERIOD)
    found = recordings.findings({"state": (own, F.col("i")), "length": (counted, F.col("rows")), "frame": (seen, F.col("t"))}, K, rules())
    return own, seen, found


RECORDING_SQL = """WITH e AS (SELECT user_id AS k, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, floor(value) * 500 AS v0 FROM events),
s AS (SELECT k, id, i, i * 2000 + CASE WHEN id % 97 = 0 THEN 500 ELSE 0 END AS t, CASE WHEN id % 89 <> 0 THEN v0 END AS v, id % 103 <> 0 AS unit,
  coalesce(sum(v0) FILTER (i > 0) OVER (PARTITION BY k ORDER BY i), 0) / 500 + CASE WHEN id % 101 = 0 THEN 1 ELSE 0 END AS p FROM e),
b AS (SELECT *, t - lag(t) OVER w AS step, p - lag(p) OVER w AS dp, lag(p) OVER w AS bp, lag(v) OVER w AS bv FROM s WINDOW w AS (PARTITION BY k ORDER BY i)),
o AS (SELECT *, abs(dp - v * step / 1000000) AS residual, coalesce(i > 0 AND dp = 0 AND v = bv AND v <> 0, false) AS again FROM b),
x AS (SELECT k, min(t) AS lo, max(t) AS hi FROM s GROUP BY k), r AS (SELECT * FROM (VALUES ('head', 30), ('wrist', 50)) r(c, hz)),
g AS (SELECT k, c, lo + CAST(floor((2 * n * 1000000 + hz * 2000)::DOUBLE / (2 * hz * 2000)) AS BIGINT) * 2000 AS t, hi FROM (SELECT *, unnest(generate_series(0, CAST(floor(((hi - lo) / 2000 + 0.5) * hz * 2000 / 1000000) AS BIGINT))) AS n FROM x, r)),
due AS (SELECT DISTINCT k, c, t FROM (SELECT k, c, t FROM g WHERE t <= hi UNION ALL SELECT k, c, hi FROM x, r)),
f AS (SELECT s.k, c, s.t, CASE WHEN id % 37 = 0 THEN i - 1 ELSE i END AS state, unnest(CASE WHEN id % 31 = 0 THEN [] WHEN id % 43 = 0 THEN [0, 1] ELSE [0] END) AS n FROM s JOIN due USING (k, t)),
h AS (SELECT f.k, c, f.t, count(*) AS seen, bool_and(coalesce(s.t = f.t, false)) AS matched FROM f LEFT JOIN s ON s.k = f.k AND s.i = f.state GROUP BY ALL),
z AS (SELECT k, c, t, d.k IS NOT NULL AS due, coalesce(seen, 0) AS seen, matched FROM (SELECT * FROM due) d FULL JOIN h USING (k, c, t)),
n AS (SELECT k, unnest([count(*) FILTER (id % 113 <> 0), count(*)]) AS rows, count(*) AS expected FROM s GROUP BY k),
bad AS (SELECT k, i AS place, 'known' AS rule, false AS warning FROM o WHERE v IS NULL UNION ALL SELECT k, i, 'quaternion', false FROM o WHERE NOT unit
 UNION ALL SELECT k, i, 'period', false FROM o WHERE i > 0 AND step <> 2000 UNION ALL SELECT k, i, 'integration', false FROM o WHERE i > 0 AND NOT coalesce(residual <= 1e-6, false)
 UNION ALL SELECT k, i, 'standing', true FROM o WHERE again UNION ALL SELECT k, rows, 'lengths', false FROM n WHERE rows <> expected
 UNION ALL SELECT k, t, 'frames', false FROM z WHERE NOT (due AND seen = 1) UNION ALL SELECT k, t, 'frame_state', false FROM z WHERE NOT coalesce(matched, true)
 UNION ALL SELECT k, t, 'frame_count', true FROM z WHERE seen > 1)"""


@query(RECORDING_SQL + """, q AS (SELECT *, row_number() OVER (PARTITION BY k, rule ORDER BY place) AS r FROM bad)
SELECT k, rule, warning, count(*) AS broken, list_sort(list(CAST(place AS BIGINT)) FILTER (r <= 24)) AS "first" FROM q GROUP BY k, rule, warning""")
def recording_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule finds in each recording, with its first places."""
    return audit(spark, sf_dir)[2]


@query(RECORDING_SQL + """, g2 AS (SELECT k, list(DISTINCT rule) AS hit, count(*) AS broken FROM bad GROUP BY k), y AS (SELECT k, coalesce(hit, []) AS hit, coalesce(broken, 0) AS broken FROM x LEFT JOIN g2 USING (k)),
l AS (SELECT k, list_filter(['known', 'quaternion', 'period', 'integration', 'lengths', 'frames', 'frame_state'], lambda n: list_contains(hit, n)) AS errors, list_filter(['standing', 'frame_count'], lambda n: list_contains(hit, n)) AS warnings, broken FROM y)
SELECT k, errors, warnings, broken, len(errors) = 0 AS valid, len(warnings) > 0 AS review FROM l""")
def recording_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each recording: its errors and warnings in the order of the rules."""
    return recordings.verdicts(states(spark, sf_dir), audit(spark, sf_dir)[2], K, rules())


@query(RECORDING_SQL + """ SELECT k, c, CAST(count(*) FILTER (due) AS BIGINT) AS expected, CAST(sum(seen) AS BIGINT) AS frames, count(*) FILTER (due AND seen = 0) AS missing, count(*) FILTER (NOT due) AS extra, count(*) FILTER (seen > 1) AS repeated FROM z GROUP BY k, c""")
def frame_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected, present, missing and extra frames of each camera."""
    seen = audit(spark, sf_dir)[1]
    return seen.groupBy("k", "c").agg(
        F.count_if("due").alias("expected"), F.sum("seen").alias("frames"), F.count_if(F.col("due") & (F.col("seen") == 0)).alias("missing"),
        F.count_if(~F.col("due")).alias("extra"), F.count_if(F.col("seen") > 1).alias("repeated"),
    )


@query(RECORDING_SQL + """ SELECT k, 'residual' AS metric, round(max(residual), 6) AS most, arg_max(i, (round(residual, 6), -i)) AS "row", arg_max(t, (round(residual, 6), -i)) AS t FROM o WHERE residual IS NOT NULL GROUP BY k""")
def integration_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest residual of integrated velocities in each recording, and where."""
    own = audit(spark, sf_dir)[0].withColumn("residual", F.round("residual", 6))
    return recordings.peaks(own, K, "i", "t", ["residual"])
