"""Metrics declared as data: a name, a path into a report and a unit, compiled to columns over strictly parsed JSON."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.numbers import ratio


class Metric(NamedTuple):
    name: str
    path: tuple[str, ...]
    unit: str


def declared(specs: list[Mapping[str, Any]]) -> list[Metric]:
    """Checked specs: exactly name, path and unit, texts that are not empty, names once each."""
    out: list[Metric] = []
    for s in specs:
        path = s.get("path")
        parts = path if isinstance(path, (list, tuple)) else ()
        texts = [s.get("name"), s.get("unit"), *parts]
        if set(s) != {"name", "path", "unit"} or not parts or not all(isinstance(x, str) and x.strip() for x in texts):
            raise ValueError(f"a metric is a name, a path of keys and a unit, not {dict(s)}")
        out.append(Metric(s["name"], tuple(parts), s["unit"]))
    if not out or len({m.name for m in out}) != len(out):
        raise ValueError("metrics need distinct names, and at least one")
    return out


def strict(text: Column) -> Column:
    """JSON as a variant; null for null and for whatever is no JSON in the strict sense (a key twice in one object, NaN, trailing text)."""
    # Spark's parser stops behind the first value. Trailing text that closes one of the two wrappers breaks the other.
    listed, named = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(named.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def _step(path: tuple[str, ...]) -> str:
    """A variant path of plain keys."""
    if any("'" in p for p in path):
        raise ValueError(f"a key may not hold a quote: {path}")
    return "$" + "".join(f"['{p}']" for p in path)


def number(doc: Column, path: tuple[str, ...]) -> Column:
    """The finite number at a path: no text and no flag passes for one."""
    leaf = F.try_variant_get(doc, _step(path), "variant")
    value = F.try_variant_get(doc, _step(path), "double")
    numeric = F.schema_of_variant(leaf).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(numeric & (F.abs(value) < float("inf")), value)


def text(doc: Column, path: tuple[str, ...]) -> Column:
    """The text at a path, null for anything else."""
    leaf = F.try_variant_get(doc, _step(path), "variant")
    return F.when(F.schema_of_variant(leaf) == "STRING", F.try_variant_get(doc, _step(path), "string"))


def has(doc: Column, path: tuple[str, ...]) -> Column:
    """Whether something, be it null, stands at a path."""
    return F.try_variant_get(doc, _step(path), "variant").isNotNull()


def measured(df: DataFrame, key: list[str], doc: str, metrics: list[Metric]) -> DataFrame:
    """Each metric of each report: key, metric, unit, value, reason (null with a value).

    A block on the way whose ``status`` is there but is not "available" makes the metric
    unavailable, whatever number an older run left beneath it; the reason then names
    that status. ``document`` means that the report itself is no strict JSON.
    """
    d = df.select(*key, strict(F.col(doc)).alias("_v"))
    v = F.col("_v")

    def told(m: Metric) -> Column:
        blocks = [m.path[:i] for i in range(len(m.path))]
        reason = F.when(v.isNull(), "document")
        for b in blocks:
            status = text(v, (*b, "status"))
            there = has(v, (*b, "status"))
            reason = reason.when(there & (F.coalesce(status, F.lit("")) != "available"), F.concat(F.lit("status_"), F.coalesce(status, F.lit("unknown"))))
        value = number(v, m.path)
        reason = reason.when(value.isNull(), "missing")
        return F.struct(F.lit(m.name).alias("metric"), F.lit(m.unit).alias("unit"), F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))

    return d.select(*key, F.explode(F.array(*[told(m) for m in metrics])).alias("_m")).select(*key, "_m.*")


def summary(values: DataFrame, group: list[str]) -> DataFrame:
    """Of measured metrics by group, metric and unit: reports, known, unreadable, mean over the known."""
    out = values.groupBy(*group, "metric", "unit").agg(
        F.count("*").alias("reports"), F.count("value").alias("known"), F.count_if(F.col("reason") == "document").alias("unreadable"), F.sum("value").alias("_s")
    )
    return out.withColumn("mean", ratio(F.col("_s"), F.col("known"))).drop("_s")


def settings(defaults: Mapping[str, Any], tunable: Mapping[str, Callable[[float], bool]], overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with what a run may change: unknown fields, fields that carry meaning, and values out of their range are errors.

    ``tunable`` gives the range of each number that may change; another field may only be repeated as it is.
    """
    out = dict(defaults)
    for name, value in (overrides or {}).items():
        if name not in defaults:
            raise ValueError(f"no such setting: {name}")
        if name not in tunable and value != defaults[name]:
            raise ValueError(f"{name} is fixed")
        out[name] = value
    for name, fits in tunable.items():
        x = out[name]
        if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or not fits(x):
            raise ValueError(f"{name} may not be {x!r}")
    return out
