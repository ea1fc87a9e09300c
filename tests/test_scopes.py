"""Interval sets against sets of points, and scopes on hand-made clocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import intervals


def points(rows):
    return {(k, p) for k, x, y in rows if x is not None and y is not None for p in range(x, y)}


@pytest.mark.parametrize("name", ["united", "intersected", "subtracted"])
def test_algebra_equals_that_of_points(spark, name):
    rng = random.Random(name)
    make = lambda n: [(rng.choice([1, 2, 3, None]), x, x + rng.randint(-2, 9)) for x in (rng.randint(0, 60) for _ in range(n))] + [(1, None, 5), (2, 4, None)]
    a, b = make(40), make(40)
    rule = {"united": set.union, "intersected": set.intersection, "subtracted": set.difference}[name]
    frame = lambda rows: spark.createDataFrame(rows, "k int, x int, y int")
    got = [tuple(r) for r in getattr(intervals, name)(frame(a), frame(b), ["k"], "x", "y").collect()]
    assert points(got) == rule(points(a), points(b))
    for k in {r[0] for r in got}:
        mine = sorted((x, y) for kk, x, y in got if kk == k)
        assert all(x < y for x, y in mine) and all(p[1] < q[0] for p, q in zip(mine, mine[1:], strict=False)), "normal form"


def test_empty_sets(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 5, 9)], "k int, x int, y int")
    assert [tuple(r) for r in intervals.merged(a, ["k"], "x", "y").collect()] == [(1, 0, 9)]
    assert intervals.merged(a.limit(0), ["k"], "x", "y").count() == 0
    assert intervals.intersected(a, a.limit(0), ["k"], "x", "y").count() == 0


def test_algebra_is_one_shuffle_without_a_join(spark):
    a = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"), (F.col("id") + 2).alias("y"))
    plan = intervals.subtracted(a, a, ["k"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_scopes_end_at_gaps_unknowns_and_the_last_sample(spark):
    rows = [(1, i, t, c) for i, (t, c) in enumerate([(0, True), (10, True), (20, None), (30, True), (40, True), (90, True), (100, False), (110, True)])]
    rows += [(2, 0, 0, True), (2, 1, 0, True), (3, 0, 0, None), (3, 1, 5, None), (4, 0, 7, True)]
    d = spark.createDataFrame(rows, "k int, i int, t long, c boolean")
    got = {(r.k, r.start, r.end, r.samples, r.place) for r in intervals.predicate_scopes(d, ["k"], "t", ["i"], {"c": F.col("c")}).collect()}
    assert got == {(1, 0, 20, 2, 1), (1, 30, 40, 1, 2), (1, 90, 100, 1, 3)}
    told = {r.k: r for r in intervals.predicate_availability(d, ["k"], "t", ["i"], {"c": F.col("c")}).collect()}
    assert (told[1].status, told[1].known, told[1].positive, told[1].known_time, told[1].observed_time, told[1].span) == ("observed", 7, 6, 50, 40, 110)
    assert (told[2].status, told[2].reason, told[2].span, told[2].coverage) == ("missing", "clock", None, None)
    assert (told[3].status, told[3].reason, told[3].full) == ("missing", "unknown", False)
    assert (told[4].status, told[4].span, told[4].full) == ("observed", None, False)
