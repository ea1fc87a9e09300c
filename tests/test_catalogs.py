"""Captured steps, unions of catalogs, stage rows, totals, rebuilt actions and frames around contacts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewater.operators import catalogs, features, paired
from tidewater.streaming import late, records

ROWS = "k long, id long, t long, s long, kind string, v double"


def captured(spark, rows, folder):
    path = f"{folder}/in"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(ROWS).parquet(path)
        out = late.run_into(records.captured_steps(stream, "k", "id", "t", "s", "kind", "v", 10), f"{folder}/out")["rows"]
    return {(r.k, r.id): (r.why, r.value, r.total) for r in out.collect()}


def test_captures_cover_one_step_and_survive_a_restart(spark, tmp_path):
    first = [(1, 1, 10, 0, "capture", 2.0), (1, 2, 10, None, "observe", None), (1, 3, 10, None, "observe", None), (1, 4, 20, 9, "capture", 5.0), (1, 5, 20, None, "observe", None), (1, 6, 30, 20, "capture", 3.0), (2, 1, 5, None, "capture", 1.0)]
    then = [(1, 7, 30, None, "observe", None), (1, 8, 40, 30, "capture", None), (1, 9, 40, None, "observe", None), (1, 10, 50, 40, "capture", 4.0), (1, 11, 51, None, "observe", None), (1, 12, 49, None, "observe", None), (1, 13, 60, 50, "capture", 1.0), (3, 1, None, None, "observe", None), (3, 2, 7, None, "observe", None)]
    got = captured(spark, [first, then], tmp_path)
    assert [got[1, i][0] for i in range(1, 14)] == ["captured", "used", "none", "inexact", "none", "captured", "used", "unknown", "none", "captured", "none", "rewind", "ended"]
    assert got[1, 2][1:] == (2.0, 20.0) and got[1, 7][1:] == (3.0, 50.0) and got[1, 13][1:] == (None, 50.0)
    assert got[2, 1][0] == "inexact" and [got[3, i][0] for i in (1, 2)] == ["rewind", "ended"] and len(got) == 16


def test_unified_keeps_the_first_source_whole(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.0)], "id int, name string, v double")
    b = spark.createDataFrame([(1, "z", [1]), (1, "x", [2]), (3, None, None), (None, "n", None)], "id int, name string, extra array<int>")
    got = {r.id: r for r in catalogs.unified({"a": a, "b": b}, ["id"]).collect()}
    assert (got[1].name, got[1].v, got[1].extra, got[1].source, got[1].sources, got[1].conflicts) == ("x", None, None, "a", ["a", "b"], ["name", "extra"])
    assert (got[2].sources, got[2].conflicts) == (["a"], []) and (got[3].name, got[3].source) == (None, "b") and got[None].name == "n"
    assert catalogs.unified({"a": a.where("id = 9"), "b": b.where("id = 9")}, ["id"]).count() == 0


def test_stage_rows_and_totals(spark):
    d = spark.createDataFrame([("g", {"s": (1, 2)}), ("h", {}), ("i", None)], "g string, m map<string, struct<known: int, reached: int>>")
    assert {tuple(r) for r in catalogs.stage_rows(d, ["g"], "m").collect()} == {("g", "s", 1, 2), ("h", None, None, None), ("i", None, None, None)}
    n = spark.createDataFrame([("g", 2, 1), ("h", 3, 0), ("i", None, 1)], "g string, known long, won long")
    out = catalogs.selection_totals(n, {"all": F.lit(True), "g": F.col("g") == "g", "no": F.lit(None).cast("boolean")}, ["known", "won"], {"rate": ("won", "known")})
    assert {r.selection: (r.groups, r.known, r.won, r.rate) for r in out.collect()} == {"all": (3, 5, 2, 0.4), "g": (1, 2, 1, 0.5), "no": (0, 0, 0, None)}


def test_rebuilt_actions_and_their_errors(spark):
    states = spark.createDataFrame([(1, t, [float(t), 2.0 * t]) for t in (0, 10, 20, 30)] + [(2, 0, [1.0, 1.0])], "k int, t long, m array<double>")
    frames = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 5, 1), (1, 2, 12, 7), (1, 3, 40, 2), (2, 0, 0, 0)], "k int, f int, t long, row int")
    commands = spark.createDataFrame([(1, 0, [9.0]), (1, 1, [8.0]), (1, 2, [7.0])], "k int, row int, c array<double>")
    d = features.rebuilt_actions(frames, states, commands, ["k"], "f", "t", "m", "row", "c")
    got = {(r.k, r.f): (r.observed, r.action) for r in d.collect()}
    assert got == {(1, 0): ([0.0, 0.0], [5.0, 10.0, 8.0]), (1, 1): ([5.0, 10.0], None), (1, 2): ([12.0, 24.0], None)}
    given = spark.createDataFrame([(1, 0, [5.0, 10.0, 8.5]), (1, 1, None), (1, 9, [1.0]), (1, 2, [1.0])], "k int, f int, action array<double>")
    r = features.action_errors(d, given, ["k"], "f", "action", 0.1).first()
    assert (r.frames, r.missing, r.extra, r.off, r.most, r.first_off) == (4, 0, 1, 2, 0.5, 0)
    short = given.where("f = 0").withColumn("action", F.slice("action", 1, 2))
    assert features.action_errors(d.where("f = 0"), short, ["k"], "f", "action", 0.1).first().most == float("inf")


@pytest.mark.parametrize(("cut", "want"), [((False, False), (1, 2, 3, 4)), ((True, False), (None, None, 3, 4)), ((False, True), (1, 2, None, None))])
def test_frames_around_a_contact(spark, cut, want):
    contacts = spark.createDataFrame([(1, 10, 20, *cut), (2, 10, 20, *cut)], "k int, start long, end long, cut_left boolean, cut_right boolean")
    frames = spark.createDataFrame([(1, 9, 1), (1, 10, 2), (1, 20, 3), (1, 21, 4), (1, 99, 5)], "k int, t long, n int")
    got = {r.k: (r.before, r.on, r.last, r.after) for r in paired.onset_frames(contacts, frames, ["k"], "t", "n").collect()}
    assert got == {1: want, 2: (None,) * 4}
