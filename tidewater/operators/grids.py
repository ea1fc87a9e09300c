"""Spatial arrays: loads on a taxel grid stored as one flat array per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loads(grid: Column, floor: float = 0.0) -> Column:
    """Values above ``floor``, others as 0."""
    return F.transform(grid, lambda x: F.greatest(x.cast("double"), F.lit(floor)))


def total(grid: Column) -> Column:
    return F.aggregate(grid, F.lit(0.0), lambda a, x: a + x)


def centre(grid: Column, columns: int) -> tuple[Column, Column]:
    """Row and column of the centre of pressure, null without load."""
    sum_ = total(grid)
    weigh = lambda place: total(F.transform(grid, lambda x, i: x * place(i)))
    row, col = weigh(lambda i: F.floor(i / columns)), weigh(lambda i: i % columns)
    return F.when(sum_ > 0, row / sum_), F.when(sum_ > 0, col / sum_)


def concentration(grid: Column) -> Column:
    """Sum of squared shares: 1 if one taxel carries everything."""
    sum_ = total(grid)
    return F.when(sum_ > 0, total(F.transform(grid, lambda x: x * x)) / (sum_ * sum_))


def variation(a: Column, b: Column) -> Column:
    """Total-variation distance of two load patterns, each scaled to one."""
    sa, sb = total(a), total(b)
    diff = total(F.zip_with(a, b, lambda x, y: F.abs(x / sa - y / sb)))
    return F.when((sa > 0) & (sb > 0), diff / 2)


def kernel(grid: Column, at: Column, columns: int, sigma: float, force: Column) -> Column:
    """A force spread over the grid by a Gaussian around position ``at``, conserving it."""
    r0, c0 = F.floor(at / columns), at % columns
    w = F.transform(
        grid, lambda x, i: F.exp(-(F.pow(F.floor(i / columns) - r0, F.lit(2)) + F.pow(i % columns - c0, F.lit(2))) / (2 * sigma * sigma))
    )
    return F.transform(w, lambda x: x / total(w) * force)


def by_names(df: DataFrame, array: str, have: list[str], want: list[str], out: str) -> DataFrame:
    """Array elements picked by name, in the wanted order; an unknown name is an error."""
    place = {n: i for i, n in enumerate(have)}
    missing = [n for n in want if n not in place]
    if missing:
        raise ValueError(f"unknown names: {missing}")
    return df.withColumn(out, F.array(*[F.col(array)[place[n]] for n in want]))
