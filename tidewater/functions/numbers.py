"""Scalar formulas: ratios, intervals, availability, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the standard normal distribution (fixed value).
Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is zero or null."""
    return F.when(b != 0, a / b)


def rounded(x: Column, digits: int) -> Column:
    """Rounds half away from zero; unlike F.round, what becomes zero keeps its sign, as in other engines."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval, null without trials."""
    n, z2 = trials.cast("double"), F.lit(Z95 * Z95)
    p = ratio(successes.cast("double"), n)
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(Z95) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, middle - half), F.when(n > 0, middle + half)


def availability(valid: Column, total: Column, least: int = 1) -> Column:
    """missing, insufficient, partial or available, from counts of known and of all samples."""
    return (
        F.when((total == 0) | (valid == 0), "missing")
        .when(valid < least, "insufficient")
        .when(valid < total, "partial")
        .otherwise("available")
    )


def yaw(q: Column) -> Column:
    """Rotation about z of a quaternion array (w, x, y, z)."""
    w, x, y, z = (q[i] for i in range(4))
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    """Cosine of two arrays, null where the product of norms is at most ``least``."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > least, dot(a, b) / norms)


def shoelace(x: Column, y: Column) -> Column:
    """Area of a polygon from arrays of its corners in order."""
    turn = lambda c: F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))
    cross = F.zip_with(F.zip_with(x, turn(y), lambda a, b: a * b), F.zip_with(turn(x), y, lambda a, b: a * b), lambda a, b: a - b)
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def steps(lo: Column, hi: Column, step: int = 1, most: int = 1_000_000) -> Column:
    """The sequence from ``lo`` to ``hi``; one bad clock value must not make a row of endless cells, so more than ``most`` is an error."""
    many = (hi - lo) / step > most
    return F.when(many, F.raise_error(F.format_string(f"more than {most} cells between %s and %s", lo, hi))).otherwise(F.sequence(lo, hi, F.lit(step).cast("long")))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    since = (ts - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second")
    return (since.cast("decimal(20, 6)") * 1_000_000).cast("long")
