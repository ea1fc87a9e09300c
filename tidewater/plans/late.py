"""Event time over a stream that arrives out of order: events come in six parts by their ids, each over all times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.publishing import event_stream
from tidewater.plans.registry import query, table
from tidewater.sources import tables
from tidewater.streaming import late

PARTS, GAP_MS = 6, 6 * 3_600_000
PART_SQL = f"""p AS (SELECT event_id AS id, user_id AS k, epoch_us(ts) // 1000 AS ms, event_id % {PARTS} AS part FROM events),
m AS (SELECT part, max(ms) AS top FROM p GROUP BY part), w AS (SELECT a.part, max(b.top) - 864000000 AS mark FROM m a JOIN m b ON b.part < a.part GROUP BY a.part)"""


def parts(spark: SparkSession, sf_dir: str) -> str:
    """Events in files that a stream reads one by one."""
    path = tables.scratch(spark, "parts")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(PARTS):
        events.where(F.col("event_id") % PARTS == i).coalesce(1).write.mode("append").parquet(path)
    return path


@query(f"WITH {PART_SQL} SELECT id, k, coalesce(ms < mark, false) AS late FROM p LEFT JOIN w USING (part)")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on time and late ones (ten days behind), each from a sink of their own."""
    path = parts(spark, sf_dir)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    marked = late.marked_late(stream.select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), "ts"), "k", "ts", "10 days")
    split = lambda batch: {"on_time": batch.where(~F.col("late")), "late": batch.where("late")}
    sinks = late.run_into(marked, tables.scratch(spark, "late"), split)
    return sinks["on_time"].unionByName(sinks["late"]).select("id", "k", "late")


@query(f"""WITH a AS (SELECT user_id AS k, epoch_us(ts) // 1000 AS ms, (SELECT max(epoch_us(ts) // 1000) FROM events) - 3600000 AS mark FROM events),
b AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY k ORDER BY ms) < {GAP_MS} THEN 0 ELSE 1 END AS new FROM a), c AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY ms ROWS UNBOUNDED PRECEDING) AS i FROM b)
SELECT k, min(ms) AS start, max(ms) AS "end", count(*) AS n FROM c GROUP BY k, i, mark HAVING max(ms) + {GAP_MS} <= any_value(mark)""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events less than six hours apart, once the watermark (an hour behind) says that no more can come."""
    stream = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return late.run_into(late.sessions(stream, "k", "ts", "1 hour", GAP_MS), tables.scratch(spark, "sessions"))["rows"]
