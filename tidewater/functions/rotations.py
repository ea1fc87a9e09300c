"""Rotations and angles as column expressions (matrices row by row, quaternions as w, x, y, z)."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.clock import in_order


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: list[Column]) -> Column:
    """An array of the components divided by their length."""
    square = lambda a: sum((a[i] * a[i] for i in range(1, len(v))), a[0] * a[0])
    return let(F.array(*[x.cast("double") for x in v]), lambda a: let(F.sqrt(square(a)), lambda n: F.transform(a, lambda x: x / n)))


def matrix(q: Column) -> Column:
    """The 3 by 3 rotation matrix of a quaternion, which is scaled to length 1 first."""
    def of(p: Column) -> Column:
        w, x, y, z = (p[i] for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return let(unit([q[i] for i in range(4)]), of)


def six(m: Column) -> Column:
    """A rotation's first two columns, one after the other."""
    return F.array(m[0], m[3], m[6], m[1], m[4], m[7])


def from_six(s: Column) -> Column:
    """The rotation matrix of a 6-number form, by orthonormalising its two columns."""
    def second(s: Column, u: Column) -> Column:
        along = u[0] * s[3] + u[1] * s[4] + u[2] * s[5]
        return let(along, lambda a: unit([s[i + 3] - a * u[i] for i in range(3)]))

    def whole(u: Column, v: Column) -> Column:
        w = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        return F.array(*[x for i in range(3) for x in (u[i], v[i], w[i])])

    return let(s, lambda c: let(unit([c[i] for i in range(3)]), lambda u: let(second(c, u), lambda v: whole(u, v))))


def relative(a: Column, b: Column) -> Column:
    """The rotation from one matrix to another: the first one's transpose times the second."""
    return F.array(*[sum((a[3 * k + i] * b[3 * k + j] for k in (1, 2)), a[i] * b[j]) for i in range(3) for j in range(3)])


def rotation_vector(m: Column) -> Column:
    """Axis times angle of a rotation matrix, exact for small angles too; at half a turn the axis comes from the largest column of m + 1."""
    def of(r: Column) -> Column:
        skew = F.array((r[7] - r[5]) / 2, (r[2] - r[6]) / 2, (r[3] - r[1]) / 2)
        cosine = (r[0] + r[4] + r[8] - 1) / 2

        def turned(v: Column) -> Column:
            sine = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
            theta = F.atan2(sine, cosine)
            columns = F.array(*[F.array(*[r[3 * i + j] + (1.0 if i == j else 0.0) for i in range(3)]) for j in range(3)])
            length = lambda c: F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])
            largest = F.array_max(F.transform(columns, lambda c: F.struct(length(c).alias("n"), c.alias("c"))))
            half = F.transform(largest["c"], lambda x: x / largest["n"] * pi)
            scaled = F.transform(v, lambda x: x * F.when(sine > 1e-15, theta / sine).otherwise(1.0))
            return F.when((cosine < 0) & (sine <= 1e-9), half).otherwise(scaled)

        return let(skew, turned)

    return let(m, of)


def angle(a: Column, b: Column) -> Column:
    """The angle between two rotation matrices, in radians; through atan2, so that small ones keep their digits."""
    def of(r: Column) -> Column:
        x, y, z = r[7] - r[5], r[2] - r[6], r[3] - r[1]
        return F.atan2(F.sqrt(x * x + y * y + z * z) / 2, (r[0] + r[4] + r[8] - 1) / 2)

    return let(relative(a, b), of)


def turn_between(p: Column, q: Column) -> Column:
    """The rotation vector that leads from one quaternion to another, in the fixed frame and the short way round (q and -q are one rotation)."""
    def of(u: Column, v: Column) -> Column:
        w = v[0] * u[0] + v[1] * u[1] + v[2] * u[2] + v[3] * u[3]
        x = u[0] * v[1] - v[0] * u[1] - (v[2] * u[3] - v[3] * u[2])
        y = u[0] * v[2] - v[0] * u[2] - (v[3] * u[1] - v[1] * u[3])
        z = u[0] * v[3] - v[0] * u[3] - (v[1] * u[2] - v[2] * u[1])
        return let(F.array(w, x, y, z), lambda d: let(F.sqrt(d[1] * d[1] + d[2] * d[2] + d[3] * d[3]), lambda n: scaled(d, n)))

    def scaled(d: Column, n: Column) -> Column:
        by = F.when(n > 1e-15, 2 * F.atan2(n, F.abs(d[0])) / n).otherwise(0.0) * F.when(d[0] < 0, -1.0).otherwise(1.0)
        return F.transform(F.slice(d, 2, 3), lambda x: x * by)

    return let(unit([p[i] for i in range(4)]), lambda u: let(unit([q[i] for i in range(4)]), lambda v: of(u, v)))


def pose9(position: Column, m: Column) -> Column:
    """A pose as nine numbers: the position and the rotation's first two columns."""
    return F.concat(F.transform(position, lambda x: x.cast("double")), six(m))


def is_rigid(m: Column, tolerance: float = 1e-6) -> Column:
    """Whether a matrix is a rotation: columns of length 1 and at right angles within ``tolerance``, and no mirror image; null if a number is missing."""
    def of(r: Column) -> Column:
        own = relative(r, r)
        off = F.array_max(F.array(*[F.abs(own[3 * i + j] - (1.0 if i == j else 0.0)) for i in range(3) for j in range(3)]))
        det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
        return (off <= tolerance) & (det > 0)

    return F.when((F.size(m) == 9) & F.forall(m, lambda x: x.isNotNull()), let(m, of))


def unwrapped(df: DataFrame, key: list[str], order: list[str], radians: str, out: str) -> DataFrame:
    """Adds an angle without jumps: whole turns are taken off so that steps stay within half a turn."""
    w = in_order(key, *order)
    step = F.col(radians) - F.lag(radians).over(w)
    d = df.withColumn("_turns", F.coalesce(-F.floor((step + pi) / (2 * pi)), F.lit(0)))
    return d.withColumn(out, F.col(radians) + 2 * pi * F.sum("_turns").over(w)).drop("_turns")
