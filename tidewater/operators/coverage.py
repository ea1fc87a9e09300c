"""What a moving tool covers of a region: strokes, cells with the time they were first covered, area over time.

A region is a box cut into equal cells, each standing for its middle. A stroke meets
only the cells of its own bounding box, computed from the cells' numbers, so nothing is
joined: work grows with the strokes' areas, and cells are combined before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import logic, regions
from tidewater.operators.clock import in_order


@dataclass(frozen=True)
class Box:
    """A region from (x0, y0) to (x1, y1) in cells of at most ``resolution``; ``polygon`` (x and y of a convex one's corners, counterclockwise) leaves out the rest."""

    x0: float
    y0: float
    x1: float
    y1: float
    resolution: float
    polygon: tuple[tuple[float, float], ...] = ()

    @property
    def counts(self) -> tuple[int, int]:
        return tuple(max(1, -int(-(b - a) // self.resolution)) for a, b in ((self.x0, self.x1), (self.y0, self.y1)))

    @property
    def cell_area(self) -> float:
        nx, ny = self.counts
        return (self.x1 - self.x0) / nx * (self.y1 - self.y0) / ny

    def middle(self, i: Column, j: Column) -> tuple[Column, Column]:
        nx, ny = self.counts
        return regions.midpoint(F.lit(self.x0), F.lit(self.x1), F.lit(nx), i), regions.midpoint(F.lit(self.y0), F.lit(self.y1), F.lit(ny), j)

    def holds(self, x: Column, y: Column) -> Column:
        if not self.polygon:
            return F.lit(True)
        return regions.inside_convex(x, y, F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in self.polygon]))


def strokes(df: DataFrame, key: list[str], t: str, tie: str, x: str, y: str, touching: Column, late: str) -> DataFrame:
    """Stretches between neighbouring rows that both touch at known places, none across a gap: key, t (its end), ax, ay, bx, by.

    A touching row without such a neighbour before it is a stretch without length.
    """
    w, on = in_order(key, t, tie), F.coalesce(touching, F.lit(False))
    d = df.withColumn("_p", F.when(on, F.struct(logic.known(F.col(x)).alias("x"), logic.known(F.col(y)).alias("y"))))
    d = d.withColumn("_p", F.when(F.col("_p.x").isNotNull() & F.col("_p.y").isNotNull(), F.col("_p")))
    d = d.withColumn("_q", F.when(~F.coalesce(F.col(late), F.lit(False)), F.lag("_p").over(w))).where(F.col("_p").isNotNull())
    start = F.coalesce("_q", "_p")
    return d.select(*key, t, start["x"].alias("ax"), start["y"].alias("ay"), F.col("_p.x").alias("bx"), F.col("_p.y").alias("by"))


def covered_cells(paths: DataFrame, key: list[str], t: str, box: Box, radius: float) -> DataFrame:
    """The cells of a region within ``radius`` of a stroke, with the time each was first covered: key, i, j, first."""
    nx, ny = box.counts
    span = lambda a, b, lo, hi, n: regions.cells_between(F.least(a, b) - radius, F.greatest(a, b) + radius, F.lit(lo), F.lit(hi), F.lit(n).cast("long"))
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    d = paths.withColumn("i", F.explode(span(ax, bx, box.x0, box.x1, nx))).withColumn("j", F.explode(span(ay, by, box.y0, box.y1, ny)))
    x, y = box.middle(F.col("i"), F.col("j"))
    d = d.where(regions.in_capsule(x, y, ax, ay, bx, by, radius) & box.holds(x, y))
    return d.groupBy(*key, "i", "j").agg(F.min(t).alias("first"))


def area_over_time(cells: DataFrame, key: list[str], box: Box) -> DataFrame:
    """How the covered area grew: key, t, cells (new ones), area (so far), share (of the region's cells)."""
    nx, ny = box.counts
    spark = cells.sparkSession
    grid = spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    total = grid.where(box.holds(*box.middle(F.col("i"), F.col("j")))).count() if box.polygon else nx * ny
    new = cells.groupBy(*key, F.col("first").alias("t")).agg(F.count("*").alias("cells"))
    so_far = F.sum("cells").over(in_order(key, "t"))
    return new.select(*key, "t", "cells", (so_far * box.cell_area).alias("area"), (so_far / total).alias("share"))


def polygon_areas(df: DataFrame, polygon: str, resolution: float, most: int = 10_000) -> DataFrame:
    """Adds cells and area of a convex polygon (corners counterclockwise) by the midpoint grid of its own box; ``most`` cells a side at most.

    Both are null for fewer than three corners and where the box has no extent.
    """
    p = F.col(polygon)
    side = {a: p.getField(a).cast("array<double>") for a in "xy"}
    lo, hi = ({a: f(side[a]) for a in "xy"} for f in (F.array_min, F.array_max))
    count = {a: regions.cells_along(lo[a], hi[a], resolution) for a in "xy"}
    d = df.withColumn("_n", F.when(F.size(p) >= 3, F.struct(*[F.least(count[a], F.lit(most)).alias(a) for a in "xy"], *[f[a].alias(n + a) for n, f in (("lo", lo), ("hi", hi)) for a in "xy"])))
    at = lambda a, i: regions.midpoint(F.col(f"_n.lo{a}"), F.col(f"_n.hi{a}"), F.col(f"_n.{a}"), i)
    rows = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n.x") - 1), lambda i: F.size(F.filter(F.sequence(F.lit(0).cast("long"), F.col("_n.y") - 1), lambda j: regions.inside_convex(at("x", i), at("y", j), p))))
    d = d.withColumn("cells", F.aggregate(rows, F.lit(0).cast("long"), lambda s, n: s + n))
    cell = (F.col("_n.hix") - F.col("_n.lox")) / F.col("_n.x") * (F.col("_n.hiy") - F.col("_n.loy")) / F.col("_n.y")
    return d.withColumn("area", F.col("cells") * cell).drop("_n")
