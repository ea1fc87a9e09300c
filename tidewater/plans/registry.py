"""The table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.numbers import micros

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Samples in SQL: key k, id, clock t (us), channel ch, value v (unknown in every 17th row).
SAMPLES_SQL = """s AS (
  SELECT user_id AS k, event_id AS id, epoch_us(ts) AS t, event_type AS ch,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.replace("{samples}", SAMPLES_SQL)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: k, id, t, ch, v."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("k"), F.col("event_id").alias("id"), micros(F.col("ts")).alias("t"),
        F.col("event_type").alias("ch"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("v"),
    )
