"""Raw recordings under a table of rules: planted faults, missing streams, empty tables, plans."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidewater.operators import recordings
from tidewater.operators.recordings import Rule

STATE = "k int, i long, t long, p array<double>, v array<double>, q array<double>"


def states(spark, rows):
    return spark.createDataFrame(rows, STATE)


def test_steps_and_residuals(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [
        (1, 0, 0, [0.0, 0.0], [5.0, 5.0], one), (1, 1, 2000, [0.5, 0.0], [250.0, 0.0], one), (1, 2, 4000, [1.0, 0.25], [250.0, 0.0], one),
        (1, 3, 6000, [1.0, 0.25], [250.0, 0.0], one), (1, 4, 8000, [1.0, None], [0.0, 0.0], one), (1, 5, 10000, [float("nan"), 1.0], [0.0, 0.0], None),
        (2, 0, 0, None, None, [0.5, 0.5, 0.5, 0.5]), (2, 1, 1, [1.0], [0.0], [1.0, 0.0, 0.0, None]),
    ]
    got = {(r.k, r.i): r for r in recordings.stepped(states(spark, rows), ["k"], "i", "t", "p", "v").collect()}
    assert [got[1, i].residual for i in range(6)] == [None, 0.0, 0.25, 0.5, None, None]
    assert [got[1, i].repeated for i in range(6)] == [None, False, False, True, False, False] and got[2, 1].residual is None
    d = states(spark, rows).select("k", "i", recordings.finite(F.col("p"), 2).alias("f"), recordings.unit_length(F.col("q")).alias("u"))
    flags = {(r.k, r.i): (r.f, r.u) for r in d.collect()}
    assert [flags[1, i][0] for i in range(6)] == [True] * 4 + [False] * 2 and flags[2, 0] == (False, True) and flags[2, 1] == (False, None)
    top = recordings.peaks(recordings.stepped(states(spark, rows), ["k"], "i", "t", "p", "v"), ["k"], "i", "t", ["residual", "step"]).collect()
    assert {(r.k, r.metric): (r.most, r.row, r.t) for r in top} == {(1, "residual"): (0.5, 3, 6000), (1, "step"): (2000.0, 1, 2000), (2, "step"): (1.0, 1, 1)}


def test_deadlines_equal_exact_fractions(spark):
    rng = random.Random(3)
    cases = [(rng.randrange(10**6), rng.randrange(1, 3000)) for _ in range(60)] + [(0, 0)]
    for rate, period in ((30, 2000), (50, 2000), (60, 4000), (7, 1000)):
        d = spark.createDataFrame([(i, lo, lo + n * period) for i, (lo, n) in enumerate(cases)], "i int, lo long, hi long")
        got = {r.i: sorted(r.at) for r in d.select("i", recordings.deadlines(F.col("lo"), F.col("hi"), rate, period).alias("at")).collect()}
        for i, (lo, n) in enumerate(cases):
            want, k = {lo + n * period}, 0
            while (tick := (Fraction(k * 10**6, rate * period) + Fraction(1, 2)).__floor__()) <= n:
                want.add(lo + tick * period)
                k += 1
            assert got[i] == sorted(want)


def test_frames_missing_extra_twice_and_of_another_state(spark):
    rows = [(k, i, i * 2000, None, None, None) for k in (1, 2) for i in range(51)]
    d = states(spark, rows)
    right = [0, 17, 33, 50]
    shown = [(1, "head", i * 2000, i) for i in right] + [(2, "head", 0, 0), (2, "head", 34000, 16), (2, "head", 34000, 17), (2, "head", 50000, 25), (2, "roof", 0, 0), (2, "head", 66000, 99)]
    f = spark.createDataFrame(shown, "k int, c string, t long, s long")
    got = {(r.k, r.c, r.t): (r.due, r.seen, r.matched) for r in recordings.scheduled(f, d, ["k"], "c", "t", "s", "i", {"head": 30, "wrist": 30}, 2000).collect()}
    assert {t for k, c, t in got if (k, c) == (1, "head")} == {i * 2000 for i in right} and all(got[1, "head", i * 2000] == (True, 1, True) for i in right)
    assert all(got[k, "wrist", i * 2000] == (True, 0, None) for k in (1, 2) for i in right)
    assert got[2, "head", 34000] == (True, 2, False) and got[2, "head", 50000] == (False, 1, True) and got[2, "roof", 0] == (False, 1, True)
    assert got[2, "head", 66000] == (True, 1, False) and got[2, "head", 100000] == (True, 0, None)
    none = recordings.scheduled(f.where("k = 9"), d.where("k = 9"), ["k"], "c", "t", "s", "i", {"head": 30}, 2000)
    assert none.count() == 0


def test_lengths_of_missing_streams(spark):
    d = states(spark, [(k, i, i, None, None, None) for k in (1, 2) for i in range(3)])
    touch, force = d.where("k = 1"), spark.createDataFrame([(3, 1)], "k int, clash int")
    got = {(r.k, r.stream): (r.rows, r.expected) for r in recordings.lengths(d, {"touch": touch, "force": force}, ["k"]).collect()}
    assert got == {(1, "touch"): (3, 3), (1, "force"): (0, 3), (2, "touch"): (0, 3), (2, "force"): (0, 3), (3, "touch"): (0, 0), (3, "force"): (1, 0)}


def test_findings_keep_few_places_and_all_counts(spark):
    rng = random.Random(4)
    rows = [(k, i, i * 2000, None, [rng.choice([0.0, 1.0, None])], None) for k in range(4) for i in range(100)]
    d = states(spark, rows)
    rules = [Rule("b", "s", F.col("v")[0] == 0), Rule("a", "s", F.col("i") >= 0), Rule("w", "s", F.col("i") < 98, warning=True), Rule("x", "e", F.lit(False))]
    streams = {"s": (d, F.col("i")), "e": (d.where("k = 3 and i < 2"), -F.col("i"))}
    found = recordings.findings(streams, ["k"], rules, most=5)
    got = {(r.k, r.rule): (r.broken, r.first, r.warning) for r in found.collect()}
    for k in range(4):
        bad = [i for kk, i, _, _, v, _ in rows if kk == k and v[0] != 0.0]
        assert got[k, "b"] == (len(bad), bad[:5], False) and got[k, "w"] == (2, [98, 99], True) and (k, "a") not in got
    assert got[3, "x"] == (2, [-1, 0], False) and len(got) == 9
    known = spark.createDataFrame([(k,) for k in (0, 0, 3, 7)], "k int")
    told = {r.k: (r.errors, r.warnings, r.valid, r.review) for r in recordings.verdicts(known, found, ["k"], rules).collect()}
    assert told == {0: (["b"], ["w"], False, True), 3: (["b", "x"], ["w"], False, True), 7: ([], [], True, False)}
    assert recordings.findings({"s": (d.where("k = 9"), F.col("i"))}, ["k"], rules[:3]).count() == 0
    for wrong in ([Rule("z", "nowhere", F.lit(True))], [rules[0], rules[0]]):
        with pytest.raises(ValueError, match="names of their own"):
            recordings.findings(streams, ["k"], wrong)


def test_ranks_are_cut_before_the_shuffle(spark):
    d = states(spark, [(1, i, i, None, None, None) for i in range(10)])
    plan = recordings.findings({"s": (d, F.col("i"))}, ["k"], [Rule("n", "s", F.col("p").isNotNull())])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
