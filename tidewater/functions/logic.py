"""Three-valued evidence: missing is null, never false or zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column, least: float | None = None, most: float | None = None) -> Column:
    """``x`` as double, or null where it is NaN, infinite, below ``least`` or above ``most``."""
    d = x.cast("double")
    ok = ~F.isnan(d) & (F.abs(d) != float("inf"))
    ok = ok if least is None else ok & (d >= least)
    return F.when(ok if most is None else ok & (d <= most), d)


def all_of(*conditions: Column) -> Column:
    """Kleene AND: false if any is false, else null if any is null."""
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    """Kleene OR."""
    return reduce(lambda a, b: a | b, conditions)


def is_true(condition: Column) -> Column:
    """Only known truth counts."""
    return F.coalesce(condition, F.lit(False))


def strict_total(*parts: Column) -> Column:
    """The sum, known only if every part is."""
    return reduce(lambda a, b: a + b, parts)


def strict_array_sum(values: Column) -> Column:
    """The sum of an array, known only if every element is."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.forall(values, lambda x: x.isNotNull()), total)


REDUCERS = {
    "min": F.array_min,
    "max": F.array_max,
    "sum": strict_array_sum,
    "mean": lambda c: strict_array_sum(c) / F.size(c),
    "norm": lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x)),
}
OPERATORS = {
    "is": lambda c, v: c == F.lit(v),
    "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "eq": lambda c, v: c == v,
}


def predicate(spec: dict) -> Column:
    """A declared predicate as a column: field, op, value, and perhaps reduce, length, center.

    ``op`` is one of OPERATORS, or one of them behind ``abs_``. With ``reduce`` the
    field is an array, which needs ``length`` elements, all known and finite.
    ``low`` and ``high`` bound the domain of the field (of each element); with
    ``physical`` (counts, speeds, loads, distances) it begins at zero. Outside the
    domain the result is null.
    """
    c, op = F.col(spec["field"]), spec["op"]
    least, most = spec.get("low", 0.0 if spec.get("physical") else None), spec.get("high")
    if "reduce" in spec:
        ok = (F.size(c) > 0) & F.forall(c, lambda x: known(x, least, most).isNotNull())
        if "length" in spec:
            ok = ok & (F.size(c) == spec["length"])
        c = F.when(ok, REDUCERS[spec["reduce"]](c))
    elif op != "is":
        c = known(c, least, most)
    if "center" in spec:
        c = c - F.lit(spec["center"])
    if op.startswith("abs_"):
        c, op = F.abs(c), op[4:]
    return OPERATORS[op](c, spec["value"])


def conjunction(specs: list[dict]) -> Column:
    """All declared predicates together, by Kleene logic."""
    return all_of(*map(predicate, specs))
