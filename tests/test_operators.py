"""Small hand-made cases for the episode operators."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import logic
from tidewater.operators import aggregates, asof, audits, clock, cohorts, features, overlap, progress, quantiles, reviews, segments, stages
from tidewater.operators.stages import Hold, Stage
from tidewater.sources import tables
from tidewater.streaming import records
from tidewater.streaming import stages as stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_left_hold_gap_and_cap(spark):
    d = frame(spark, [(1, t, i) for i, t in enumerate((0, 100, 200, 500, 600, 700))], "k int, t long, id int")
    g = {r.t: (r.dur, r.gap) for r in clock.gap_aware(d, ["k"], "t", "id").collect()}
    assert g[200] == (0, True) and g[0] == (100, False) and g[700] == (0, False)
    assert {r.t: r.dur for r in clock.gap_aware(d, ["k"], "t", "id", cap=True).collect()}[200] == 150


def test_asof_ties_and_tolerance(spark):
    left = frame(spark, [(1, 5), (1, 10), (1, 21)], "k int, t long")
    right = frame(spark, [(1, 10, 1), (1, 10, 2), (1, 20, 3)], "k int, t long, v int")
    got = {r.t: (r.rt, r.v) for r in asof.asof_backward(left, right, ["k"], "t", ["v"], tolerance=0).collect()}
    assert got == {5: (None, None), 10: (10, 2), 21: (20, None)}
    near = {r.t: r.rt for r in asof.asof_nearest(left.union(frame(spark, [(1, 15)], "k int, t long")), right, ["k"], "t", ["v"]).collect()}
    assert near == {5: 10, 10: 10, 15: 10, 21: 20}
    tied = {r.t: r.rt for r in asof.asof_nearest(left.union(frame(spark, [(1, 15)], "k int, t long")), right, ["k"], "t", ["v"], later=True).collect()}
    assert tied[15] == 20


def test_empty_tables(spark):
    d = frame(spark, [], "k int, t long, id int, v double")
    assert clock.gap_aware(d, ["k"], "t", "id").count() == 0
    assert asof.asof_backward(d.select("k", "t", "id"), d.select("k", "t", "v"), ["k"], "t", ["v"]).count() == 0
    assert segments.plateaus(d.withColumn("gap", F.lit(False)), ["k"], ["t"], "t", "v", 1.0, 1, "gap").count() == 0
    assert aggregates.distribution(d, ["k"], "v").count() == 0


def test_weighted_quantile_ignores_zero_weights(spark):
    d = frame(spark, [(1, 1, 1.0, 3), (1, 2, 2.0, 1), (1, 3, 900.0, 0)], "k int, t int, v double, w long")
    r = aggregates.weighted_stats(d, ["k"], "v", "w", ["t"]).first()
    assert (r.p50, r.p95, r.peak, r["mean"]) == (1.0, 2.0, 900.0, 1.25)


def test_predicates_are_three_valued(spark):
    d = frame(spark, [(1.0, [1.0, 2.0]), (float("nan"), [1.0, None]), (None, [])], "x double, a array<double>")
    gt = logic.predicate({"field": "x", "op": "gt", "value": 0})
    total = logic.predicate({"field": "a", "op": "ge", "value": 3, "reduce": "sum", "length": 2})
    assert [tuple(r) for r in d.select(gt, total).collect()] == [(True, True), (None, None), (None, None)]
    with pytest.raises(ValueError):
        stages.checked_thresholds(terminal_cosine=1.5)
    assert stages.checked_thresholds(lift_m=0.03)["lift_m"] == 0.03


def reference_stages(rows, limit, rules):
    """A plain loop over one key's rows (t, conditions)."""
    last, since, first = None, [None] * len(rules), [None] * len(rules)
    for t, *conditions in rows:
        if last is not None and t - last > limit:
            since = [None] * len(rules)
        last = t
        for i, (least, strict, behind) in enumerate(rules):
            ready = i == 0 or first[i - 1] is not None
            if conditions[i] is not True or (behind and not ready):
                since[i] = None
            else:
                since[i] = t if since[i] is None else since[i]
                if ready and first[i] is None and (t - since[i] > least if strict else t - since[i] >= least):
                    first[i] = t
    return first


@pytest.fixture(scope="module")
def episodes():
    rng, rows = random.Random(5), []
    for k in range(40):
        t = 0
        for i in range(60):
            t += rng.choice([1, 1, 1, 1, 5])
            rows.append((k, i, t, *(rng.choice([True, True, True, False, None]) for _ in range(3))))
    return rows


RULES = [(1, False, False), (2, False, False), (2, True, True)]


def test_stages_match_a_loop(spark, episodes):
    d = frame(spark, episodes, "k int, id int, t long, a boolean, b boolean, c boolean")
    program = [
        Stage("s1", (Hold(lambda _: F.col("a"), 1),)), Stage("s2", (Hold(lambda _: F.col("b"), 2),)),
        Stage("s3", (Hold(lambda before: before & F.col("c"), 2, strict=True),)),
    ]
    out = stages.stage_report(stages.gaps(d, ["k"], "t", "id", F.lit(3)), ["k"], "t", "id", "late", program)
    for r in out.collect():
        mine = [x[2:] for x in episodes if x[0] == r.k]
        assert [r.s1, r.s2, r.s3] == reference_stages(mine, 3, RULES)
        assert r.highest_stage == sum(x is not None for x in (r.s1, r.s2, r.s3))
    assert out.where("success").count() > 0


def test_stream_matches_batch(spark, episodes, tmp_path):
    schema = "k int, id int, t long, a boolean, b boolean, c boolean"
    for part in range(3):  # each file is a micro-batch: a later part of every episode
        rows = [r for r in episodes if r[1] // 20 == part]
        frame(spark, rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{part}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    program = [stream.StreamStage(n, F.col(c), *r) for n, c, r in zip(("s1", "s2", "s3"), "abc", RULES, strict=True)]
    got = stream.stage_stream(source, "k", "t", "id", 3, program)
    q = got.writeStream.format("memory").queryName("running").outputMode("update").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    final = {}
    for r in spark.sql("select * from running").collect():
        if r.k not in final or r.samples > final[r.k].samples:
            final[r.k] = r
    for k, r in final.items():
        assert r.rewinds == 0 and r.samples == 60
        assert [r.s1, r.s2, r.s3] == reference_stages([x[2:] for x in episodes if x[0] == k], 3, RULES)


def test_stream_counts_rewinds():
    state = (None, [None], [None], 0, 0, 0)
    state = stream.observe(state, [(10, True), (5, True), (11, True)], 100, [(1, False, False)])
    assert state == (11, [10], [11], 2, 0, 1)


def test_transport_and_ever(spark):
    rows = [(1, i, t, v) for i, (t, v) in enumerate([(0, 1.0), (1, 1.0), (2, 1.5), (3, None), (4, 9.0), (5, 9.0), (6, 12.0)])]
    d = frame(spark, rows, "k int, id int, t long, v double").withColumn("late", F.lit(False))
    moved = stages.transported(d, ["k"], "t", "id", "late", F.col("v") > 0, ["v"], 1, 2.0).orderBy("t")
    assert [r.moved for r in moved.collect()] == [False] * 6 + [True]


def test_phase_program(spark):
    rows = [(1, i, i, c) for i, c in enumerate("aabbcz")] + [(2, i, i, c) for i, c in enumerate("aaxbcz")] + [(3, i, i, c) for i, c in enumerate("aabbcy")]
    d = frame(spark, rows, "k int, id int, t long, c string").withColumn("late", F.lit(False))
    for n in "abczx":
        d = d.withColumn(f"is_{n}", F.col("c") == n)
    out = stages.phase_program(d, ["k"], "t", "id", "late", [("p1", "is_a", 1), ("p2", "is_b", 0), ("p3", "is_c", 0)], "is_z", "is_x")
    got = {r.k: (r.p1, r.p2, r.p3, r.observed_failure, r.verdict) for r in out.collect()}
    assert got == {1: (1, 2, 4, False, True), 2: (1, 3, 4, True, False), 3: (1, 2, 4, False, False)}


def test_plateaus_are_greedy(spark):
    d = frame(spark, [(1, t, v, False) for t, v in enumerate((0.0, 0.05, 0.1, 0.5, 0.5, None, 0.5, 0.5, 0.5))], "k int, t long, v double, gap boolean")
    got = sorted((r.start, r.end, r.samples) for r in segments.plateaus(d, ["k"], ["t"], "t", "v", 0.1, 2, "gap").collect())
    assert got == [(0, 2, 3), (6, 8, 3)]


def test_plateaus_and_growth_break_at_gaps_and_keep_large_keys(spark):
    big = 2**60
    rows = [(k, t, 1.0, t == 2) for k in (None, big + 1, big + 3) for t in range(6)]
    d = frame(spark, rows, "k long, t long, v double, gap boolean")
    got = {(r.k, r.start, r.end, r.samples) for r in segments.plateaus(d, ["k"], ["t"], "t", "v", 0.1, 0, "gap").collect()}
    assert got == {(k, a, b, 3) for k in (None, big + 1, big + 3) for a, b in ((0, 2), (3, 5))}
    assert segments.plateaus(d.where("t = 0"), ["k"], ["t"], "t", "v", 0.1, 0, "gap").count() == 0  # one sample is none
    grows = d.withColumn("v", F.col("t").cast("double"))
    assert {(r.start, r.end) for r in segments.growth_runs(grows, ["k"], ["t"], "t", "v", 0.5, "gap").collect()} == {(0, 2), (3, 5)}


def test_quantiles_and_ranks_equal_the_definition(spark):
    values = [1.0, 1.0, 1.0, 2.0, 5.0, 9.0, 9.5]
    d = frame(spark, [("a", v) for v in values] + [("b", 3.0), ("b", None), ("c", None)], "k string, v double")
    got = {r.k: (r.q1, r.m) for r in quantiles.quantiles(d, ["k"], "v", {"q1": 0.25, "m": 0.5}).collect()}
    assert got == {"a": (1.0, 2.0), "b": (3.0, 3.0)}
    r = quantiles.rank_interval(frame(spark, [("a", 1.0), ("a", 4.0), ("b", 9.0), ("z", 1.0)], "k string, v double"), d, ["k"], "v")
    assert {(x.k, x.v, x.below, x.upto) for x in r.collect()} == {("a", 1.0, 0.0, 3 / 7), ("a", 4.0, 4 / 7, 4 / 7), ("b", 9.0, 1.0, 1.0), ("z", 1.0, None, None)}


def test_progress_bins(spark):
    rows = [(1, i, t, p, g, s) for i, (t, p, g, s) in enumerate([(0, 0.0, False, 3.0), (1, 0.8, False, 4.0), (2, 1.0, False, 900.0)])]
    d = frame(spark, rows, "k int, id int, t long, p double, g boolean, s double")
    out = {r.bin: r for r in progress.progress_bins(d, ["k"], "t", "id", "p", "g", "s", [0, 0.2, 0.4, 0.6, 0.8, 1.0]).collect()}
    assert set(out) == {0, 4} and out[0].delta == 0.8 and out[4].visits == 1 and out[4].peak == 900.0 and out[4]["mean"] == 4.0


def test_classification_outweighs(spark):
    d = frame(spark, [(1, None, True), (2, 1, True), (3, 1, False)], "id int, seed int, ok boolean")
    out = cohorts.classified(d, {"missing_seed": F.col("seed").isNull()}, {"not_ok": ~F.col("ok")}, F.lit(True))
    assert [(r.evidence, r.reasons) for r in out.orderBy("id").collect()] == [("missing", ["missing_seed"]), ("valid", []), ("invalid", ["not_ok"])]


def test_outcomes_without_interval(spark):
    d = frame(spark, [("a", "pass", 1), ("a", "unknown", 1), ("b", "pass", 1), ("b", "fail", 1)], "task string, o string, c int")
    out = {r.task: r for r in cohorts.outcome_bounds(d, ["task"], "o", "c").collect()}
    assert out["a"].low is None and (out["a"].confirmed, out["a"].possible, out["a"].resolved) == (0.5, 1.0, 1.0)
    assert 0 < out["b"].low < 0.5 < out["b"].high < 1


def test_one_bad_clock_value_is_an_error(spark):
    d = frame(spark, [(1, 0, 10), (1, 10, 2**60)], "k int, a long, b long")
    with pytest.raises(Exception, match="more than 1000000 cells"):
        overlap.overlap_bins(d, "a", "b", 10).count()


def test_values_are_cleaned_by_their_domain(spark):
    d = frame(spark, [(1, -1.0, [1.0, float("inf")]), (2, 3.0, [1.0, 2.0])], "i int, v double, a array<double>")
    load, sum_ = logic.predicate({"field": "v", "op": "lt", "value": 5, "physical": True}), logic.predicate({"field": "a", "op": "gt", "value": 2, "reduce": "sum"})
    assert [tuple(r) for r in d.orderBy("i").select(load, sum_).collect()] == [(None, None), (True, True)]


def test_merge_keeps_the_base(spark):
    base, more = frame(spark, [(1, "a"), (2, "b")], "id int, x string"), frame(spark, [(2, "c"), (3, "d")], "id int, x string")
    union, changed = cohorts.merged_catalog(base, more, ["id"])
    assert sorted(tuple(r) for r in union.collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert [tuple(r) for r in changed.collect()] == [(2, "c")]
    same = frame(spark, [(2, "b"), (3, "d")], "id int, x string")
    assert cohorts.merged_catalog(base, same, ["id"])[1].count() == 0


def test_jump_and_spike(spark):
    d = frame(spark, [(1, i, v) for i, v in enumerate((0.0, 0.1, 9.0, 0.2, 0.3, 5.0, 5.1, *(5.1 + 0.1 * i for i in range(20))))], "k int, i int, v double")
    got = {r.i: r.spike for r in audits.jumps(d, ["k"], ["i"], "v", 1.0).collect()}
    assert got == {2: True, 3: False, 5: False}


def test_windows_and_history_keep_nulls(spark):
    d = frame(spark, [(1, i, v) for i, v in enumerate((1.0, None, 3.0, 4.0))], "k int, i int, v double")
    w = features.action_windows(d, ["k"], ["i"], "v", 2).orderBy("i").collect()
    assert [r.actions for r in w] == [[None, 3.0], [3.0, 4.0]]
    h = features.history(d, ["k"], ["i"], "v", 1, 2).orderBy("i").collect()
    assert [r.history for r in h] == [[1.0, 1.0], [1.0, None], [None, 3.0], [3.0, 4.0]]


def test_window_stats_equal_materialised(spark):
    d = frame(spark, [(1, i, float(i * i)) for i in range(9)], "k int, i int, v double")
    flat = features.action_windows(d, ["k"], ["i"], "v", 3).select(F.explode("actions").alias("x")).agg(F.count("x"), F.avg("x"), F.stddev_pop("x")).first()
    got = features.window_stats(d, ["k"], ["i"], "v", 3).first()
    assert got.n == flat[0] and got["mean"] == pytest.approx(flat[1]) and got["std"] == pytest.approx(flat[2])


def test_union_length_and_bins(spark):
    d = frame(spark, [(1, 0, 10), (1, 5, 12), (1, 20, 21)], "k int, a long, b long")
    assert overlap.union_length(d, ["k"], "a", "b").first().covered == 13
    assert sorted((r.bin, r.overlap) for r in overlap.overlap_bins(d.limit(1), "a", "b", 4).collect()) == [(0, 4), (1, 4), (2, 2)]


def test_sources(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n{"a": 2}\n')
    assert tables.read_jsonl(spark, str(p), "a int").agg(F.sum("a")).first()[0] == 3
    p.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(p), "a int").collect()
    d = frame(spark, [(1, "x"), (2, None)], "id int, v string")
    n, h = tables.publish(d, str(tmp_path / "out"))
    assert n == 2 and tables.table_digest(tables.read_columns(spark, str(tmp_path / "out"), ["id", "v"])) == (n, h)
    with pytest.raises(FileExistsError):
        tables.publish(d, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        tables.read_columns(spark, str(tmp_path / "out"), ["id", "w"])
    with pytest.raises(ValueError):
        tables.conform(d, T.StructType([T.StructField("id", T.LongType())]))
    best = tables.preferred([d.where("id = 1"), d.withColumn("v", F.lit("late"))], ["id"])
    assert sorted((r.id, r.v) for r in best.collect()) == [(1, "x"), (2, "late")]
    (tmp_path / "eps").mkdir()
    for name in ("episode_2.h5", "episode_10.h5", "episode_3.h5.partial", "notes.txt"):
        (tmp_path / "eps" / name).write_text(json.dumps(name))
    found = tables.discover(spark, str(tmp_path / "eps"), r"^episode_\d+", r"episode_(\d+)").orderBy("number").collect()
    assert [r.number for r in found] == [2, 10]
    with pytest.raises(ValueError):
        tables.published_only(d, d.where("id = 1"), ["id"], 2)
    cams = frame(spark, [(1, ["head"]), (2, ["head", "left"])], "id int, cams array<string>")
    assert [(r.id, r.lacking) for r in tables.cameras_missing(cams, "cams", ["head", "left"]).collect()] == [(1, ["left"])]


def test_records_of_a_stream(spark, tmp_path):
    rows = [(1, 0, 0, "a", 1.0), (1, 5, 1, "a", 2.0), (1, 6, 2, "b", 3.0), (1, 30, 3, "b", 4.0), (2, 1, 4, None, None)]
    schema = "k long, t long, id long, s string, v double"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        log = records.closed(records.state_log(source, "k", "t", "id", "s", 20), f"log-{name}").collect()
        past = records.closed(records.history_stream(source, "k", "t", "id", "v", 2), f"past-{name}").collect()
        if not data:
            assert log == past == []
            continue
        assert sorted((r.k, r.id, r.why) for r in log) == [(1, 0, "transition"), (1, 2, "transition"), (1, 3, "interval"), (2, 4, "transition")]
        assert {r.id: r.history for r in past} == {0: [1.0, 1.0], 1: [1.0, 2.0], 2: [2.0, 3.0], 3: [3.0, 4.0], 4: [None, None]}


def test_steady_holds_restart_where_the_range_grows(spark):
    rows = [(1, i, i * 10, True, False, v) for i, v in enumerate((0.0, 0.1, 0.9, 0.95, 1.0))] + [(None, 9, 0, True, False, 0.0), (None, 10, 10, None, False, 0.0)]
    d = frame(spark, rows, "k long, id long, t long, c boolean, late boolean, v double")
    got = {(r.k, r.id): r._held for r in reviews.steady_hold(d, ["k"], "t", "id", F.col("c"), "late", ["v"], 0.5).collect()}
    assert got == {(1, 0): 0, (1, 1): 10, (1, 2): 0, (1, 3): 10, (1, 4): 20, (None, 9): 0, (None, 10): None}
    bad = frame(spark, [(1, "a", ["head", "head"]), (2, "a", ["left"]), (3, "a", ["left", "head"])], "i int, scene string, c array<string>")
    assert [r[0] for r in bad.orderBy("i").select(tables.canonical_cameras(F.col("c"), ["head", "left"], "head")).collect()] == [None, None, ["head", "left"]]
    with pytest.raises(ValueError, match="2 episodes"):
        tables.inspected(bad.withColumn("ok", F.lit(True)), "scene", "c", ["head", "left"], "ok", 1)
