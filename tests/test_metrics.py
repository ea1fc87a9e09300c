"""Declared metrics, strict JSON, settings and published sets."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidewater.operators import metrics
from tidewater.sources import sets


def test_specs_are_checked():
    good = {"name": "a", "path": ["x", "y"], "unit": "N"}
    assert metrics.declared([good])[0].path == ("x", "y")
    for bad in ([], [good, good], [{**good, "path": []}], [{**good, "path": "xy"}], [{**good, "unit": " "}], [{**good, "more": 1}], [{"name": "a", "unit": "N"}], [{**good, "path": ["x", 1]}]):
        with pytest.raises(ValueError):
            metrics.declared(bad)


CASES = {
    '{"a": {"x": 1}}': (1.0, None), '{"a": {"x": -2.5e3}}': (-2500.0, None), '{"a": {"x": 12345678901234567890123}}': (1.2345678901234568e22, None),
    '{"a": {"x": "1"}}': (None, "missing"), '{"a": {"x": true}}': (None, "missing"), '{"a": {"x": null}}': (None, "missing"), '{"a": {"x": [1]}}': (None, "missing"),
    '{"a": [1]}': (None, "missing"), "{}": (None, "missing"), "[]": (None, "missing"), "3": (None, "missing"),
    '{"a": {"x": 1, "x": 2}}': (None, "document"), '{"a": {"x": 1}, "b": {"c": 1, "c": 2}}': (None, "document"), '{"a": {"x": NaN}}': (None, "document"), '{"a": {"x": Infinity}}': (None, "document"),
    '{"a": {"x": 1}} {}': (None, "document"), '{"a": {"x": 1}': (None, "document"), "": (None, "document"), "null": (None, "missing"), None: (None, "document"),
    '{"a": {"x": 1, "status": "available"}}': (1.0, None), '{"a": {"x": 1, "status": "partial"}}': (None, "status_partial"), '{"status": 3, "a": {"x": 1}}': (None, "status_unknown"),
}


def test_strict_documents(spark):
    d = spark.createDataFrame(list(enumerate(CASES)), "i int, doc string")
    got = {r.i: (r.value, r.reason) for r in metrics.measured(d, ["i"], "doc", metrics.declared([{"name": "m", "path": ["a", "x"], "unit": "N"}])).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_settings():
    defaults, tunable = {"on": 2.0, "off": 1.0, "clock": "sim"}, {"on": lambda x: x > 0, "off": lambda x: x >= 0}
    assert metrics.settings(defaults, tunable, {"on": 3, "clock": "sim"}) == {"on": 3, "off": 1.0, "clock": "sim"}
    for bad in ({"other": 1}, {"clock": "wall"}, {"on": 0}, {"on": True}, {"on": "3"}, {"off": float("nan")}):
        with pytest.raises(ValueError):
            metrics.settings(defaults, tunable, bad)


def test_a_set_appears_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "set")
    good = spark.range(20).withColumn("x y", F.col("id") * 2)
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        sets.publish_set({"good": good, "broken": broken}, path)
    assert sets.manifest(spark, path) is None and not [f for f in os.listdir(path) if not f.startswith(".")]
    with pytest.raises(FileNotFoundError):
        sets.read_set(spark, path)
    first = sets.publish_set({"good": good, "few": good.limit(0)}, path)
    assert sets.publish_set({"few": good.limit(0), "good": good}, path) == first
    for other in ({"good": good}, {"good": good, "few": good}, {"good": good, "few": good.limit(0), "more": good}):
        with pytest.raises(FileExistsError):
            sets.publish_set(other, path)
    read = sets.read_set(spark, path)
    assert sorted(map(tuple, read["good"].collect())) == [(i, 2 * i) for i in range(20)] and read["few"].count() == 0
    assert sets.verify_set(spark, path) == []


def test_of_two_runs_one_wins(spark, tmp_path):
    path = str(tmp_path)
    sets._show(spark, path, "one", {"a": {"rows": 1}})
    with pytest.raises(FileExistsError):
        sets._show(spark, path, "two", {"a": {"rows": 2}})
    assert sets.manifest(spark, path) == {"a": {"rows": 1}}
