"""Endings, batches and cells on small hand-made reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewater.operators import batches

REPORT = "b string, i int, record_error string, events array<struct<kind:string>>, physics_valid boolean, status string, success boolean, stop_reason string, error string, formal boolean, started boolean"


def report(b, i, **given):
    base = {"record_error": None, "events": None, "physics_valid": True, "status": "error", "success": None, "stop_reason": None, "error": None, "formal": True, "started": None}
    return (b, i, *{**base, **given}.values())


@pytest.mark.parametrize(
    ("given", "reason", "counts"),
    [
        ({"record_error": "x", "status": "success", "success": True}, "record_error", False),
        ({"physics_valid": False, "events": [("a",), ("b",), (None,)], "status": "success", "success": True}, "b", False),
        ({"physics_valid": False}, "physics_invalid", False),
        ({"physics_valid": None, "status": "success", "success": True}, "success", True),
        ({"status": "success", "success": False, "stop_reason": "time_limit"}, "time_limit", True),
        ({"stop_reason": "guard", "events": [(None,)]}, "guard", True),
        ({"stop_reason": "guard", "events": [("slip",)]}, "slip", True),
        ({"stop_reason": "fatal_error", "error": "hand ik"}, "fatal_error", False),
        ({"error": "WRIST TARGET JUMP"}, "wrist_target_guard", True),
        ({"error": "Sponge penetration 3 mm"}, "penetration_guard", True),
        ({"error": ""}, "infrastructure_or_contract_error", False),
        ({}, "infrastructure_or_contract_error", False),
    ],
)
def test_endings(spark, given, reason, counts):
    d = spark.createDataFrame([report("b", 1, **given)], REPORT)
    r = batches.ended(d, batches.endings()).first()
    assert (r.termination, r.counts) == (reason, counts)


def test_batches_need_all_trials_to_be_formal(spark):
    ok = {"status": "success", "success": True}
    rows = [report("whole", 1, **ok), report("whole", 2, stop_reason="time_limit"), report("part", 1, **ok), report("odd", 1, **ok, formal=False), report("odd", 2, record_error="x", success=True, started=False)]
    planned = spark.createDataFrame([("whole",), ("whole",), ("part",), ("part",), ("odd",), ("odd",), ("none",)], "b string")
    d = batches.ended(spark.createDataFrame(rows, REPORT), batches.endings())
    got = {r.b: r for r in batches.batch_summary(planned, d, ["b"], "success", "formal", "started").collect()}
    assert (got["whole"].formal, got["whole"].rate, got["whole"].formal_rate, got["whole"].terminations) == (True, 0.5, 0.5, {"success": 1, "time_limit": 1})
    assert (got["part"].formal, got["part"].rate, got["part"].formal_rate) == (False, 1.0, None)
    assert (got["odd"].attempted, got["odd"].valid, got["odd"].successes, got["odd"].task_successes) == (1, 1, 1, 2)
    assert (got["none"].planned, got["none"].attempted, got["none"].rate, got["none"].formal, got["none"].terminations) == (1, 0, None, False, {})
    none = batches.batch_summary(planned.where("b = 'x'"), d, ["b"], "success", "formal", "started")
    assert none.count() == 0


def test_cells_keep_interrupted_and_missing_apart(spark):
    planned = spark.createDataFrame([(i, "u") for i in range(6)] + [(9, "v")], "i int, cell string")
    rows = [(0, "completed", True, True, 1.0, None, []), (1, "completed", True, None, 3.0, None, ["a", "b"]), (2, "exception", None, None, None, "s", None), (3, "interrupted", True, True, 9.0, "s", ["a"]), (8, "completed", True, True, 1.0, None, [])]
    found = spark.createDataFrame(rows, "i int, status string, success boolean, quality boolean, x double, stage string, broken array<string>")
    got = {r.cell: r for r in batches.cells(planned, found, ["i"], ["cell"], ["x"]).collect()}
    u = got["u"]
    assert (u.planned, u.reported, u.unstarted, u.interrupted, u.exceptions, u.evaluated, u.successes, u.quality, u.qualified) == (6, 4, 2, 1, 1, 3, 2, 1, 1)
    assert (u.x_least, u.x_mean, u.x_most) == (1.0, 2.0, 3.0) and abs(u.successes_rate - 2 / 3) < 1e-12 and got["v"].successes_rate is None
    told = {tuple(r) for r in batches.failures(planned, found, ["i"], ["cell"], ["stage"], ["broken"]).collect()}
    assert told == {("u", "stage", "s", 1), ("u", "broken", "a", 1), ("u", "broken", "b", 1)}
    assert batches.failures(planned, found.where(F.lit(False)), ["i"], ["cell"], ["stage"], ["broken"]).count() == 0
