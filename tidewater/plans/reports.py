"""The composed analyses over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import reports
from tidewater.operators import clock
from tidewater.plans.cohorts import TRIALS_SQL, trials
from tidewater.plans.registry import ORACLE, query, samples
from tidewater.plans.stages import EDGES, PROGRESS_SQL
from tidewater.plans.time import HOUR

EVENTS_SQL = f"""WITH pl AS (SELECT * FROM ({ORACLE["plateau_events"]})), gr AS (SELECT k, start, "end", samples FROM ({ORACLE["growth_runs"]})),
ev AS (SELECT *, 'plateau' AS kind FROM pl UNION ALL SELECT *, 'growth' FROM gr)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.build_review(samples(spark, sf_dir), ["k"], "t", "id", "v", 150.0, 12 * HOUR, 20.0)


@query(EVENTS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY "end" - start DESC, start, kind) AS rank FROM ev)
SELECT k, start, "end", samples, kind, CAST(rank AS INTEGER) AS rank, rank <= 3 AS preview FROM r""")
def event_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir)


@query(EVENTS_SQL + """, {samples}, m AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ev),
u AS (SELECT k, sum(greatest(0, "end" - greatest(start, coalesce(pe, start)))) AS covered, count(*) AS events FROM m GROUP BY k), sp AS (SELECT k, max(t) - min(t) AS span FROM s GROUP BY k)
SELECT k, span, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CAST(span - coalesce(covered, 0) AS BIGINT) AS rest, coalesce(events, 0) AS events FROM sp LEFT JOIN u USING (k)""")
def event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.review_coverage(samples(spark, sf_dir), events(spark, sf_dir), ["k"], "t")


@query("""WITH {samples}, r AS (SELECT ch, v FROM s WHERE k % 2 = 0 AND v IS NOT NULL), md AS (SELECT ch, quantile_cont(v, 0.5) AS reference FROM r GROUP BY ch), q AS (SELECT id, ch, v FROM s WHERE k % 2 = 1 AND v IS NOT NULL),
c AS (SELECT q.id, count(*) FILTER (r.v < q.v) / count(*) AS below FROM q JOIN r USING (ch) GROUP BY q.id)
SELECT id, round(below, 6) AS below, round(v - reference, 4) AS delta, round(CASE WHEN reference > 0 THEN v / reference END, 5) AS ratio FROM q JOIN c USING (id) JOIN md USING (ch)""")
def reference_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where(F.col("v").isNotNull())
    d = reports.compare_to_reference(s.where("k % 2 = 1").select("ch", "id", "v"), s.where("k % 2 = 0").select("ch", "v"), ["ch"], "v")
    return d.select("id", F.round("below", 6).alias("below"), F.round("delta", 4).alias("delta"), F.round("ratio", 5).alias("ratio"))


@query(TRIALS_SQL + """, f AS (SELECT *, CASE WHEN price < 60000 OR (coalesce(success, false) AND NOT formal) THEN 'invalid' WHEN success IS NULL OR price > 440000 THEN 'missing' ELSE 'valid' END AS evidence FROM tr),
e AS (SELECT *, unnest(['overall', CASE WHEN formal THEN 'formal' ELSE 'diagnostic' END]) AS split FROM f)
SELECT task, split, count(*) AS members, count(*) FILTER (evidence = 'valid') AS valid, count(*) FILTER (evidence = 'invalid') AS invalid, count(*) FILTER (evidence = 'missing') AS missing,
count(*) FILTER (evidence = 'valid' AND success) AS successes, round(CASE WHEN count(*) FILTER (evidence = 'valid') > 0 THEN count(*) FILTER (evidence = 'valid' AND success) / count(*) FILTER (evidence = 'valid') END, 6) AS rate
FROM e GROUP BY task, split""")
def trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, success = F.col("price"), F.col("success")
    missing = {"missing_outcome": success.isNull(), "missing_price": price > 440000}
    invalid = {"price_too_low": price < 60000, "success_without_protocol": success & ~F.col("formal")}
    d = reports.summarize_trials(trials(spark, sf_dir).drop("status"), ["task"], missing, invalid, "success", "formal")
    return d.withColumn("rate", F.round("rate", 6))


def tactile(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return reports.analyze_tactile(samples(spark, sf_dir), ["k"], "ch", "t", "id", "v", 100.0, 60.0, 6 * HOUR)


@query(f"""SELECT c.*, weight, mean, std, p50, p95 FROM ({ORACLE["channel_load_stats"]}) c JOIN ({ORACLE["left_hold_weighted_stats"]}) w USING (k, ch)""")
def tactile_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of tactile records with their weighted intensity."""
    both = tactile(spark, sf_dir)
    d = both["channels"].withColumn("impulse", F.round(F.col("impulse") / 1e6, 2)).withColumns({c: F.round(c, 6) for c in ("coverage", "contact_share", "cv")})
    w = both["intensity"].select("k", "ch", "weight", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), "p50", "p95")
    return d.join(w, ["k", "ch"])


def progressed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Samples with their share of the record as progress, unknown in every 13th."""
    place = F.round(F.percent_rank().over(clock.in_order(["k"], "t", "id")), 9)
    s = samples(spark, sf_dir).withColumn("_pr", place).withColumn("done", F.when(F.col("id") % 13 != 0, F.col("_pr"))).drop("_pr")
    return reports.analyze_episode(s, ["k"], "t", "id", "done", "v", EDGES)


@query(PROGRESS_SQL + " SELECT k, bin, samples, visits, first, observed, round(mean, 4) AS mean, peak FROM bins")
def episode_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressed(spark, sf_dir)["bins"].drop("delta").withColumn("mean", F.round("mean", 4))


@query(PROGRESS_SQL + """ SELECT k, edge, min(t) AS reached FROM e, (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS edge) WHERE id % 13 <> 0 AND pr >= edge GROUP BY k, edge""")
def episode_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each edge of progress was reached first."""
    return progressed(spark, sf_dir)["milestones"]


@query(PROGRESS_SQL + " SELECT bin, count(*) AS episodes, count(mean) AS known, round(avg(mean), 4) AS mean, round(quantile_cont(mean, 0.5), 4) AS median FROM bins GROUP BY bin")
def episode_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summarize_population(progressed(spark, sf_dir)["bins"], [], "mean").withColumns({c: F.round(c, 4) for c in ("mean", "median")})


@query(f"""SELECT c.*, over, excess, known, status FROM ({ORACLE["contact_continuity"]}) c JOIN ({ORACLE["load_report"]}) l USING (k)""")
def contact_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reports.assess_contact_quality(samples(spark, sf_dir), ["k"], "t", "id", "v", 100.0, 300.0)
    return d.withColumn("share", F.round("share", 6)).withColumn("excess", F.round(F.col("excess") / 1e6, 2))


@query(ORACLE["macro_success"])
def aggregated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.aggregate_reports(trials(spark, sf_dir), "task", "outcome").withColumn("macro", F.round("macro", 8))
