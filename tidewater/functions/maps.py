"""Nested settings in JSON columns, and display units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_get(text: Column, path: str, kind: str) -> Column:
    """The value at a dotted path of a JSON object, cast to ``kind``; null where a step is missing."""
    return F.get_json_object(text, "$." + path).cast(kind)


def deep_merge(base: Column, over: Column, depth: int = 4) -> Column:
    """Two variants of JSON objects as one, ``over`` winning; objects under one key are merged in turn, ``depth`` levels deep."""

    def fields(v: Column) -> Column:
        return F.coalesce(F.from_json(v, "map<string, string>"), F.from_json(F.lit("{}"), "map<string, string>"))

    def is_object(v: Column) -> Column:
        return F.coalesce(F.startswith(F.ltrim(v), F.lit("{")), F.lit(False))

    def merged(a: Column, b: Column, left: int) -> Column:
        rule = lambda k, x, y: F.when(y.isNull(), x).when(x.isNull(), y).otherwise(
            F.when(is_object(x) & is_object(y), merged(x, y, left - 1)).otherwise(y) if left > 1 else y
        )
        pairs = F.array_sort(F.map_entries(F.map_zip_with(fields(a), fields(b), rule)))
        spell = lambda v: F.when(is_object(v) | v.rlike(r"^(-?[0-9.eE+-]+|true|false|\\[.*\\])$"), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
        text = F.transform(pairs, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), spell(e["value"])))
        return F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}"))

    return merged(base, over, depth)


def whitelisted(m: Column, names: list[str]) -> Column:
    """A map with the given keys only."""
    return F.map_filter(m, lambda k, _: k.isin(names))


def display(value: Column, scale: Column | float, unit: float = 1.0) -> Column:
    """A value in display units as a share of a scale, clamped to 0 to 1; null without a value or a positive scale."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.when((s > 0) & value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double") * unit / s)))
