"""Regions of the plane as column expressions: convex polygons by half planes, midpoint grids, capsules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.numbers import steps

#: What a rounding error may add at an edge.
EDGE = 1e-12


def corners(x: Column, y: Column) -> Column:
    """A polygon as an array of corners (x, y) from two arrays."""
    return F.arrays_zip(x.alias("x"), y.alias("y"))


def edges(polygon: Column) -> Column:
    """Each corner with the next one, the last with the first: (ax, ay, bx, by)."""
    after = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    pair = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return F.zip_with(polygon, after, pair)


def inside_convex(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point is in a convex polygon with its corners counterclockwise, its edge included; null for fewer than three corners."""
    left = lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]) >= -EDGE
    return F.when(F.size(polygon) >= 3, F.forall(edges(polygon), left))


def cells_along(lo: Column, hi: Column, resolution: float | Column) -> Column:
    """How many cells of at most ``resolution`` cut the range, one at least; null for an empty range."""
    return F.when(hi > lo, F.greatest(F.lit(1).cast("long"), F.ceil((hi - lo) / resolution)))


def midpoint(lo: Column, hi: Column, count: Column, i: Column) -> Column:
    """The middle of cell ``i`` (from 0) of ``count`` equal ones."""
    return lo + (i + 0.5) * (hi - lo) / count


def cells_between(a: Column, b: Column, lo: Column, hi: Column, count: Column) -> Column:
    """The numbers of cells whose middles lie between a and b, as an array; bounded by ``count``."""
    width = (hi - lo) / count
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.least(a, b) - lo) / width - 0.5 - EDGE))
    last = F.least(count - 1, F.floor((F.greatest(a, b) - lo) / width - 0.5 + EDGE))
    return F.when(first <= last, steps(first, last)).otherwise(F.array().cast("array<bigint>"))


def in_capsule(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column, radius: float | Column) -> Column:
    """Whether a point is within ``radius`` of the stretch from a to b; a stretch without length is a disc."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    along = F.when(square > 1e-20, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / square))).otherwise(0.0)
    ox, oy = x - (ax + along * dx), y - (ay + along * dy)
    return ox * ox + oy * oy <= radius * radius + 1e-15
