"""Regions, coverage, rotations, trajectories and event time against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import regions, rotations
from tidewater.operators import coverage, reviews, trajectories
from tidewater.streaming import late

SECOND = 1_000_000


def test_points_in_convex_polygons(spark):
    rng = random.Random(1)
    turns = sorted(rng.random() * 2 * math.pi for _ in range(7))
    corners = [(math.cos(a), math.sin(a)) for a in turns]
    rows = [(rng.uniform(-1.2, 1.2), rng.uniform(-1.2, 1.2), [c[0] for c in corners], [c[1] for c in corners]) for _ in range(300)]
    rows += [(*corners[0], rows[0][2], rows[0][3]), (0.0, 0.0, [0.0, 1.0], [0.0, 1.0])]
    d = spark.createDataFrame(rows, "x double, y double, px array<double>, py array<double>")
    got = [r[0] for r in d.select(regions.inside_convex(F.col("x"), F.col("y"), regions.corners(F.col("px"), F.col("py")))).collect()]

    def within(x, y):
        p = [(u - x, v - y) for u, v in corners]
        around = sum(math.atan2(a[0] * b[1] - a[1] * b[0], a[0] * b[0] + a[1] * b[1]) for a, b in zip(p, p[1:] + p[:1], strict=True))
        return abs(around) > math.pi

    assert got[:300] == [within(x, y) for x, y, *_ in rows[:300]] and got[300:] == [True, None]


def test_covered_cells_equal_trying_all(spark):
    rng = random.Random(2)
    box = coverage.Box(-1.0, 0.0, 2.0, 1.5, 0.11, ((-1.0, 0.0), (2.0, 0.0), (0.5, 1.5)))
    rows = [(k, i, i * 10, rng.uniform(-1.5, 2.5), rng.uniform(-0.5, 2.0), rng.choice([True, True, None, False]), rng.random() < 0.1) for k in (1, 2) for i in range(25)]
    rows += [(1, 30, 300, None, 0.5, True, False), (1, 31, 310, float("nan"), 0.5, True, False), (3, 0, 0, 0.5, 0.5, True, None), (4, 0, 0, 9.0, 9.0, True, False)]
    d = spark.createDataFrame(rows, "k int, i int, t long, x double, y double, on boolean, late boolean")
    paths = coverage.strokes(d, ["k"], "t", "i", "x", "y", F.col("on"), "late")
    got = {(r.k, r.i, r.j): r.first for r in coverage.covered_cells(paths, ["k"], "t", box, 0.17).select("k", "i", "j", "first").collect()}
    nx, ny = box.counts
    want = {}
    for p in paths.collect():
        for i in range(nx):
            for j in range(ny):
                x, y = -1 + (i + 0.5) * 3 / nx, (j + 0.5) * 1.5 / ny
                s = [(1 - u / 400) * p.ax + u / 400 * p.bx for u in range(401)], [(1 - u / 400) * p.ay + u / 400 * p.by for u in range(401)]
                near = min(math.hypot(x - a, y - b) for a, b in zip(*s, strict=True))
                assert abs(near - 0.17) > 1e-9
                if near < 0.17 - 2e-4 or (near < 0.17 + 2e-4 and (p.k, i, j) in got):
                    if y <= 1.5 - abs(x - 0.5) + 1e-12:
                        want[p.k, i, j] = min(p.t, want.get((p.k, i, j), p.t))
    assert got == want and {3} < {k for k, *_ in got} and 4 not in {k for k, *_ in got}
    grown = coverage.area_over_time(coverage.covered_cells(paths, ["k"], "t", box, 0.17), ["k"], box).groupBy("k").agg(F.sum("cells").alias("n"), F.max("area").alias("a"), F.max("share").alias("s")).collect()
    assert all(abs(r.a - r.n * box.cell_area) < 1e-12 and 0 < r.s <= 1 for r in grown) and sum(r.n for r in grown) == len(got)


def test_covered_cells_join_nothing(spark, sf_dir):
    from tidewater.plans import QUERIES

    plan = QUERIES["covered_cells"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_small_turns_keep_their_digits(spark):
    axis = np.array([0.36, -0.48, 0.8])
    rows = [(a, [math.cos(a / 2), *(axis * math.sin(a / 2)).tolist()]) for a in (0.0, 1e-9, 1e-5, 0.3, 2.0, 3.0, math.pi - 1e-7)]
    d = spark.createDataFrame(rows, "a double, q array<double>").withColumn("m", rotations.matrix(F.col("q")))
    still, one = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))
    got = d.select("a", rotations.angle(still, F.col("m")).alias("n"), rotations.rotation_vector(F.col("m")).alias("r"), rotations.turn_between(one, F.col("q")).alias("t"), rotations.turn_between(F.col("q"), one).alias("b"))
    for r in got.collect():
        assert abs(r.n - r.a) < (1e-12 if r.a < 3.1 else 1e-8)
        assert np.allclose(r.r, axis * r.a, rtol=0, atol=1e-12 if r.a < 2.5 else 1e-7)
        assert np.allclose(r.t, axis * r.a, rtol=0, atol=1e-12) and np.allclose(r.b, -axis * r.a, rtol=0, atol=1e-12)
    half = spark.createDataFrame([(a,) for a in ([0.0, 1.0, 0.0, 0.0], [0.0, 0.6, 0.0, 0.8])], "q array<double>")
    turned = half.select("q", rotations.rotation_vector(rotations.matrix(F.col("q"))).alias("r")).collect()
    assert all(np.allclose(np.abs(r.r), np.abs(np.array(r.q[1:]) * math.pi), atol=1e-6) for r in turned)


def test_rigid_matrices_and_poses(spark):
    whole = [1.0, 0, 0, 0, 1, 0, 0, 0, 1]
    rows = [(whole, True), ([-x for x in whole], False), ([2 * x for x in whole], False), ([1.0, 1e-3, 0, 0, 1, 0, 0, 0, 1], False), (whole[:8], None), ([None, *whole[1:]], None), (None, None)]
    d = spark.createDataFrame([(list(map(lambda x: None if x is None else float(x), m)) if m else None, w) for m, w in rows], "m array<double>, want boolean")
    assert all(r[0] == r[1] for r in d.select(rotations.is_rigid(F.col("m")), "want").collect())
    nine = d.limit(1).select(rotations.pose9(F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("m"))).first()[0]
    assert nine == [1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def test_planted_breaks_of_a_trajectory_are_found(spark):
    rows = []
    for i in range(200):
        a, jump = 0.01 * i, 0.5 if i >= 120 else 0.0
        flip = -1 if i % 3 == 0 else 1  # q and -q are one rotation
        q = [flip * math.cos(a / 2), 0.0, 0.0, flip * math.sin(a / 2)]
        rows.append((1, i, i * SECOND // 10, [0.02 * i + jump, 0.0, 0.0], q, [0.2, 0.0, 0.0], [0.0, 0.0, 0.1 if i < 50 else 0.4], "reach" if i < 120 else "hold"))
    rows += [(1, 200, rows[-1][2], *rows[-1][3:]), (2, 0, 0, None, [0.0] * 4, None, None, None), (2, 1, SECOND, [1.0, None, 0.0], [1.0, 0, 0, 0], None, None, "x")]
    rows = [(*r[:4], None if r[4] is None else [float(x) for x in r[4]], *r[5:]) for r in rows]
    d = spark.createDataFrame(rows, "k int, i int, t long, p array<double>, q array<double>, v array<double>, w array<double>, phase string")
    m = trajectories.motion(d, ["k"], "t", "i", "p", "q", SECOND, "v", "w")
    told, found = trajectories.screened(m, ["k"], "t", "i", "phase", {"speed": 1.0, "spin": 1.0, "acceleration": 5.0, "velocity_residual": 1.0, "spin_residual": 0.2})
    told, found = {(r.k, r.metric): r for r in told.collect()}, {(r.k, r.metric, r.rank): r for r in found.collect()}
    assert {k for k, _ in told} == {1} and told[1, "speed"].samples == 199 and abs(told[1, "speed"].p50 - 0.2) < 1e-9 and abs(told[1, "spin"].most - 0.1) < 1e-9
    assert {k: r.candidates for (_, k), r in told.items()} == {"speed": 1, "spin": 0, "acceleration": 2, "velocity_residual": 1, "spin_residual": 149}
    jump = found[1, "speed", 1]
    assert (jump.t, jump.phase, jump.changed) == (120 * SECOND // 10, "hold", True) and max(r for _, n, r in found if n == "spin_residual") == 20
    faults = {r.k: (r.rows, r.standing, r.backward) for r in trajectories.clock_faults(d, ["k"], "t", "i").collect()}
    assert faults == {1: (201, 1, 0), 2: (2, 0, 0)}


def test_range_cuts_equal_trying_all():
    rng = np.random.default_rng(3)
    for trim in (None, 40, 7):
        for _ in range(30):
            t = np.cumsum(rng.integers(1, 12, 150))
            x = np.cumsum(rng.normal(size=(2, 150)) * 0.2, 1)
            first = reviews._first_wide(t, x, 0.9, trim)
            wide = []
            for i in range(150):
                old = [j for j in range(i + 1) if trim is not None and t[j] <= t[i] - trim]
                a = old[-1] if old else 0
                wide.append(bool((np.ptp(x[:, a : i + 1], axis=1) > 0.9).any()))
            assert first == (wide.index(True) if True in wide else 150)


def written(spark, path, rows):
    spark.createDataFrame(rows, "k long, id long, ms long").select("k", "id", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_add_up_and_a_restart_changes_nothing(spark, tmp_path):
    rng, parts, n = random.Random(5), [], 0
    for b in range(4):
        parts.append([(rng.randrange(3), n + i, b * 60_000 + rng.randrange(-90_000, 60_000) + 1_000_000) for i in range(40)])
        n += 40
    want, top = {}, None
    for rows in parts:
        for _, i, ms in rows:
            want[i] = top is not None and ms < top - 30_000
        top = max([ms for *_, ms in rows] + ([top] if top else []))
    known = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")  # counts must not rest on what is remembered of a run
    try:
        for name, stops in (("once", [4]), ("twice", [2, 4])):
            source, sink, at = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out"), 0
            for stop in stops:
                for rows in parts[at:stop]:
                    written(spark, source, rows)
                at = stop
                stream = spark.readStream.schema("k long, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
                sinks = late.run_into(late.marked_late(stream, "k", "ts", "30 seconds"), sink, lambda b: {"on_time": b.where(~F.col("late")), "late": b.where("late")})
            got = {r.id: r.late for s in sinks.values() for r in s.collect()}
            assert got == want and sinks["late"].count() == sum(want.values()) > 0 and sinks["on_time"].count() + sinks["late"].count() == 160
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", known)


def test_sessions_end_with_the_watermark(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    written(spark, source, [(1, 0, 10_000), (1, 1, 11_900), (2, 2, 11_000)])
    written(spark, source, [(1, 3, 13_500), (2, 4, 40_000)])
    written(spark, source, [(3, 5, 41_000)])
    written(spark, source, [(1, 6, 9_000)])  # late: its session has gone
    stream = spark.readStream.schema("k long, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    got = {tuple(r) for r in late.run_into(late.sessions(stream, "k", "ts", "5 seconds", 2_000), sink)["rows"].collect()}
    assert got == {(1, 10_000, 13_500, 3), (2, 11_000, 11_000, 1)}
    assert late.merged([(5, 6, 1), (1, 2, 2), (7, 9, 1), (20, 20, 1)], 3) == [(1, 2, 2), (5, 9, 2), (20, 20, 1)]


def test_streams_without_data_are_empty(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("k long, id long, ts timestamp").parquet(str(tmp_path / "none"))
    assert late.run_into(stream, str(tmp_path / "out"))["rows"].count() == 0


@pytest.mark.parametrize("resolution", [0.5, 0.05])
def test_grid_areas_come_near_the_polygon(spark, resolution):
    d = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)],), ([(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)],), ([(0.0, 0.0), (1.0, 1.0)],), (None,)], "p array<struct<x: double, y: double>>")
    got = [r.area for r in coverage.polygon_areas(d, "p", resolution).collect()]
    assert abs(got[0] - 8) < 1e-9 and abs(got[1] - 2) < 3 * resolution and got[2:] == [None, None]
