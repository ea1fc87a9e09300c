"""Values that only larger or odd tables have."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, sql_rows
from tidewater.operators import aggregates, cohorts
from tidewater.plans import ORACLE, QUERIES
from tidewater.streaming import late


def put(select: str, path: Path) -> None:
    """Writes a small table by SQL."""
    duckdb.connect().execute(f"COPY ({select}) TO '{path}' (FORMAT parquet)")


def test_agreement_of_a_stream_that_never_varies(spark, tmp_path):
    rows = [(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (3, 2.0, 4.0), (4, 1.0, None), (5, 1.0, 2.0), (5, 1.0, 2.0), (6, 1.0, 2.0), (6, 2.0, 1.0)]
    got = {r.k: (r.pairs, r.corr) for r in aggregates.agreement(spark.createDataFrame(rows, "k int, a double, b double"), ["k"], "a", "b").collect()}
    assert got == {1: (2, None), 2: (1, None), 3: (2, pytest.approx(1.0)), 5: (2, None), 6: (2, pytest.approx(-1.0))}
    put("""SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01 01:00:00' + to_days(day) AS ts, user_id, event_type, value FROM (VALUES
        (1, 0, 'click', 5.0::DOUBLE), (1, 0, 'view', 1.0), (1, 1, 'click', 5.0), (1, 1, 'view', 2.0), (2, 0, 'click', 1.0), (2, 0, 'view', 3.0),
        (2, 1, 'click', 2.0), (2, 1, 'view', 7.0)) e(user_id, day, event_type, value)""", tmp_path / "events.parquet")
    assert assert_same(QUERIES["stream_agreement"](spark, str(tmp_path)), ORACLE["stream_agreement"], str(tmp_path)) == 2


def test_packed_grids_keep_the_sign_of_zero(spark, tmp_path):
    put("""SELECT 1::BIGINT AS vec_id, 0::INTEGER AS label, list_transform(range(64), lambda i: CASE i WHEN 0 THEN -3e-7 WHEN 1 THEN 3e-7 WHEN 2 THEN '-0.0'::DOUBLE WHEN 3 THEN -5 ELSE 0.0 END::FLOAT) AS embedding""", tmp_path / "embeddings.parquet")
    got = QUERIES["packed_grids"](spark, str(tmp_path)).first()
    _, want = sql_rows(ORACLE["packed_grids"].replace("AS grid", "::VARCHAR AS grid"), str(tmp_path))
    ((grid, _, _),) = want
    assert str(got.grid) == grid and str(got.grid).count("-0.0,") == 2


def stage_tables(folder: Path, lines: str) -> str:
    """One valid trial with the given lines (number, flag)."""
    put("SELECT 1::BIGINT AS c_custkey, 'FURNITURE' AS c_mktsegment", folder / "customer.parquet")
    put("SELECT 7::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 'F' AS o_orderstatus, 100000.0::DOUBLE AS o_totalprice, '2-HIGH' AS o_orderpriority", folder / "orders.parquet")
    put(f"SELECT 7::BIGINT AS l_orderkey, l::INTEGER AS l_linenumber, f AS l_returnflag FROM {lines} x(l, f)", folder / "lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stage_counts", "group_stage_summary", "stage_csv"])
def test_stages_without_a_number_come_last(spark, tmp_path, name):
    folder = stage_tables(tmp_path, "(VALUES (NULL, 'R'), (1, 'N'), (2, 'A'), (NULL, 'A'), (2, 'R'))")
    assert assert_same(QUERIES[name](spark, folder), ORACLE[name], folder) == 5


@pytest.mark.parametrize("name", ["stage_counts", "group_stage_summary", "stage_csv"])
def test_stages_beyond_the_nineteenth_are_kept(spark, tmp_path, name):
    """The SQL of these queries lists the first 19 stages of a trial only; the queries list all."""
    folder = stage_tables(tmp_path, "(SELECT i, CASE WHEN i % 2 = 0 THEN 'R' ELSE 'N' END FROM range(1, 26) r(i))")
    assert assert_same(QUERIES[name](spark, folder), ORACLE[name].replace("range(1, 20)", "range(1, 26)"), folder) == 25


def test_differences_count_repeats_in_one_aggregation(spark):
    a = spark.createDataFrame([(1, "x")] * 3 + [(2, None)] * 2 + [(3, "y")], "i int, s string")
    b = spark.createDataFrame([(1, "x")] + [(2, None)] * 3 + [(4, "y")] * 70_000, "i int, s string")
    d = cohorts.differences(a, b)
    assert {(r.i, r.s, r.side): r["count"] for r in d.groupBy("i", "s", "side").count().collect()} == {
        (1, "x", "missing"): 2, (2, None, "unexpected"): 1, (3, "y", "missing"): 1, (4, "y", "unexpected"): 70_000,
    }
    assert d.columns == ["i", "s", "side"] and "replicaterows" not in d._jdf.queryExecution().toString()


def test_tasks_grow_in_number_with_the_rows(spark, sf_dir):
    d = cohorts.dealt(spark.range(1000).withColumn("k", F.col("id") % 100), ["k"], rows=100)
    assert d.rdd.getNumPartitions() == 11 and d.withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    assert "REPARTITION_BY_NUM" in QUERIES["published_against_rebuilt"](spark, sf_dir)._jdf.queryExecution().toString()


def test_late_rows_share_groups_and_a_batch_runs_once(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("k"), "id", F.timestamp_millis(F.col("id") * 1000).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, id long, ts timestamp").parquet(str(tmp_path / "in"))
    marked, kept = late.marked_late(stream, "k", "ts", "5 seconds"), []
    assert marked.columns == ["k", "id", "ts", "late"]
    assert "_shard" in marked._jdf.queryExecution().toString()

    def split(batch):
        kept.append(batch.storageLevel.useMemory)
        return {"on_time": batch.where(~F.col("late")), "late": batch.where("late")}

    sinks = late.run_into(marked, str(tmp_path / "out"), split)
    assert sinks["on_time"].count() == 3000 and sinks["late"].count() == 0
    assert len(kept) > 1 and all(kept[1:])
