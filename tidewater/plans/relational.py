"""Plain relational queries. Spark's own operators do all of it; they are here because users combine them with ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.plans.registry import query, table


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), revenue.alias("revenue"))


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    d = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    d = d.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.groupBy("r_name", "n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("s"), 2).alias("total"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, GROUPING(o_orderpriority) + 2 * GROUPING(o_orderstatus) AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.grouping("o_orderpriority") + 2 * F.grouping("o_orderstatus")).cast("long")
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), level.alias("level"))


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")
def customer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 400000)
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("""SELECT c_nationkey, s_nationkey, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey""")
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 9000).groupBy("c_nationkey").agg(F.count("*").alias("c"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full")


@query("""SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"))
    return c.intersect(s)


@query("""SELECT o_custkey, o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranking_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    quarter = F.ntile(4).over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), quarter.cast("long").alias("quarter")
    )


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, g""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@query("""SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1""")
def json_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("""SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(quality) AS labelled, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang", "source").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )
