"""A Spark result against SQL over the same tables in another engine."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def plain(x):
    """A comparable form of a value."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    return x


def rows_of(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.select(*names).collect())


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def assert_same(df: DataFrame, sql: str, sf_dir: str) -> int:
    """Both sides have the same columns and the same rows, each as often; returns how many."""
    names, ours = rows_of(df)
    theirs_names, theirs = sql_rows(sql, sf_dir)
    assert names == theirs_names
    assert ours == theirs, f"{sum((ours - theirs).values())} rows only here, {sum((theirs - ours).values())} only in SQL: {list((ours - theirs))[:3]} {list((theirs - ours))[:3]}"
    return sum(ours.values())
