"""The physical plans that the operators promise."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidewater.functions.contracts import CONTRACTS
from tidewater.operators import asof, reviews, segments, stages
from tidewater.operators.stages import Hold, Stage
from tidewater.plans import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_as_of_is_one_shuffle_without_a_join(spark, sf_dir):
    plan = plan_of(QUERIES["asof_backward"](spark, sf_dir))
    assert "Join" not in plan and "CartesianProduct" not in plan
    left = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    right = left.withColumn("v", F.col("t"))
    plan = plan_of(asof.asof_backward(left, right, ["k"], "t", ["v"]))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


def test_a_stage_program_shuffles_its_key_once(spark):
    d = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), F.col("id"), (F.col("id") > 3).alias("c"), F.lit(False).alias("late"))
    program = [Stage(f"s{i}", (Hold(lambda _: F.col("c"), i), Hold(lambda before: before & F.col("c"), 1))) for i in range(3)]
    plan = plan_of(stages.run_stages(d, ["k"], "t", "id", "late", program))
    assert len(re.findall(r"Exchange hashpartitioning\(k", plan)) == 1


def test_hysteresis_shuffles_its_key_once(spark):
    d = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), F.col("id"), F.col("id").cast("double").alias("v"))
    plan = plan_of(segments.hysteresis(d, ["k"], ["t", "id"], "v", 5, 2, F.col("v").isNotNull()))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_scans_are_pruned(spark, sf_dir):
    plan = plan_of(QUERIES["pricing_summary"](spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<([^>\n]*)", plan).group(1)
    assert "l_orderkey" not in schema and "l_shipdate" in plan and re.search(r"PushedFilters: \[[^\]]*l_shipdate", plan)
    plan = plan_of(QUERIES["stream_fingerprints"](spark, sf_dir))
    assert "l_extendedprice" not in plan and "partial_sum" in plan


def test_no_query_of_this_side_needs_a_cross_join(spark, sf_dir):
    for name in ("bin_overlap_mean", "gap_propagation", "interval_union_coverage", "rank_interval", "cohort_outcomes_wilson", "scoped_samples"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_weighted_statistics_read_and_shuffle_once(spark, sf_dir):
    plan = plan_of(QUERIES["left_hold_weighted_stats"](spark, sf_dir))
    assert plan.count("FileScan") == 1 and len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


def test_no_window_holds_a_whole_hot_group(spark, sf_dir):
    keys = {"duplicate_groups": "h", "content_dedupe_exclusions": "h", "rank_interval": "ch", "median_mad": "ch", "hash_split": "task"}
    for name, key in keys.items():
        plan = plan_of(QUERIES[name](spark, sf_dir))
        # A window by the group alone may only order its cells, which are few.
        for order in re.findall(rf"windowspecdefinition\({key}#\d+L?, ([^)]*)\)?", plan):
            assert "_cell" in order or "specifiedwindowframe" in order, (name, order)
        assert "Window" not in plan or "_cell" in plan or "_p#" in plan, name


def test_reviews_shuffle_a_trial_once(spark):
    fields = "insertion_depth_m double, socket_contact_count double, right_hand_contact_count double, table_contact_count double"
    d = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 0.0, 0.0)], f"k int, i int, t long, {fields}")
    c = CONTRACTS["usb-unplug"]
    plan = plan_of(reviews.review(d, ["k"], "t", "i", "usb-unplug", c.digest, c.fields, F.lit(True), F.lit(True)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert all("k#" in keys for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)", plan))
