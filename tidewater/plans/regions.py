"""Regions and their coverage: an event's value moves a tool over a board, embeddings are triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import regions
from tidewater.operators import coverage
from tidewater.plans.registry import query, samples, table

#: A board with a gable, in 40 by 40 cells.
BOARD = coverage.Box(0.0, 0.0, 10.0, 10.0, 0.25, ((0.0, 0.0), (10.0, 0.0), (10.0, 6.0), (5.0, 10.0), (0.0, 6.0)))
RADIUS = 0.3
CELLS_SQL = f"""{{samples}}, a AS (SELECT k, id, t, CASE WHEN ch <> 'error' AND v IS NOT NULL THEN {{'x': (row_number() OVER w % 100) * 0.1::DOUBLE, 'y': v / 50}} END AS p, id % 19 = 0 AS late FROM s WINDOW w AS (PARTITION BY k ORDER BY t, id)),
b AS (SELECT k, t, p, CASE WHEN NOT late THEN lag(p) OVER (PARTITION BY k ORDER BY t, id) END AS q FROM a),
st AS (SELECT k, t, coalesce(q.x, p.x) AS ax, coalesce(q.y, p.y) AS ay, p.x AS bx, p.y AS b_y FROM b WHERE p IS NOT NULL),
gr AS (SELECT i, j, (i + 0.5::DOUBLE) * 0.25 AS x, (j + 0.5::DOUBLE) * 0.25 AS y FROM range(40) r(i), range(40) c(j)), inside AS (SELECT * FROM gr WHERE y <= 6 + 0.8 * x AND y <= 14 - 0.8 * x),
u AS (SELECT st.*, i, j, x, y, (bx - ax) ** 2 + (b_y - ay) ** 2 AS sq FROM st JOIN inside ON x BETWEEN least(ax, bx) - {RADIUS} AND greatest(ax, bx) + {RADIUS} AND y BETWEEN least(ay, b_y) - {RADIUS} AND greatest(ay, b_y) + {RADIUS}),
f AS (SELECT *, CASE WHEN sq > 1e-20 THEN greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / sq)) ELSE 0 END AS s FROM u),
c AS (SELECT k, i, j, min(t) AS first FROM f WHERE (x - ax - s * (bx - ax)) ** 2 + (y - ay - s * (b_y - ay)) ** 2 <= {RADIUS * RADIUS} + 1e-15 GROUP BY k, i, j)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("k").orderBy("t", "id"))
    d = samples(spark, sf_dir).withColumn("x", place % 100 * F.lit(0.1)).withColumn("y", F.col("v") / 50).withColumn("late", F.col("id") % 19 == 0)
    return coverage.covered_cells(coverage.strokes(d, ["k"], "t", "id", "x", "y", F.col("ch") != "error", "late"), ["k"], "t", BOARD, RADIUS)


@query(f"WITH {CELLS_SQL} SELECT k, i, j, first FROM c")
def covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's strokes over the board: the cells they cover, and when first."""
    return cells(spark, sf_dir)


@query(f"""WITH {CELLS_SQL}, n AS (SELECT k, first AS t, count(*) AS cells FROM c GROUP BY k, first)
SELECT k, t, cells, CAST(sum(cells) OVER (PARTITION BY k ORDER BY t) * 0.0625 AS DOUBLE) AS area, round(sum(cells) OVER (PARTITION BY k ORDER BY t) / (SELECT count(*) FROM inside), 8) AS share FROM n""")
def covered_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each user's covered area grew."""
    return coverage.area_over_time(cells(spark, sf_dir), ["k"], BOARD).withColumn("share", F.round("share", 8))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
o AS (SELECT vec_id, CASE WHEN (e[3] - e[1]) * (e[6] - e[2]) - (e[4] - e[2]) * (e[5] - e[1]) >= 0 THEN e ELSE [e[1], e[2], e[5], e[6], e[3], e[4]] END AS p FROM e),
l AS (SELECT *, least(p[1], p[3], p[5]) AS x0, greatest(p[1], p[3], p[5]) AS x1, least(p[2], p[4], p[6]) AS y0, greatest(p[2], p[4], p[6]) AS y1 FROM o),
n AS (SELECT *, greatest(1, ceil((x1 - x0) / 0.02)) AS nx, greatest(1, ceil((y1 - y0) / 0.02)) AS ny FROM l),
c AS (SELECT n.*, x0 + (i + 0.5) * (x1 - x0) / nx AS x, y0 + (j + 0.5) * (y1 - y0) / ny AS y FROM n, range(120) r(i), range(120) s(j) WHERE i < nx AND j < ny)
SELECT vec_id, count(*) FILTER (ok) AS cells, round(count(*) FILTER (ok) * any_value((x1 - x0) / nx * (y1 - y0) / ny), 8) AS area FROM (SELECT *,
  (p[3] - p[1]) * (y - p[2]) - (p[4] - p[2]) * (x - p[1]) >= -1e-12 AND (p[5] - p[3]) * (y - p[4]) - (p[6] - p[4]) * (x - p[3]) >= -1e-12 AND (p[1] - p[5]) * (y - p[6]) - (p[2] - p[6]) * (x - p[5]) >= -1e-12 AS ok FROM c) GROUP BY vec_id""")
def grid_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of an embedding's first six numbers, measured by the middles of cells."""
    e = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    c = [F.col("e")[i] for i in range(6)]
    left = (c[2] - c[0]) * (c[5] - c[1]) - (c[3] - c[1]) * (c[4] - c[0]) >= 0
    at = lambda *ks: F.array(*[c[k] for k in ks])
    corners = F.when(left, regions.corners(at(0, 2, 4), at(1, 3, 5))).otherwise(regions.corners(at(0, 4, 2), at(1, 5, 3)))
    d = d.select("vec_id", F.transform(corners, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("p"))
    return coverage.polygon_areas(d, "p", 0.02).select("vec_id", "cells", F.round("area", 8).alias("area"))
