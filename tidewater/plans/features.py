"""Training-feature queries over events, embeddings and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.numbers import micros, rounded
from tidewater.operators import features
from tidewater.operators.clock import in_order
from tidewater.plans.registry import query, samples, table

K, BY = ["k"], ["t", "id"]


@query("""WITH {samples}, x AS (SELECT k, id, v, lead(v) OVER w AS next_v, lead(ch) OVER w AS next_ch, lead(1) OVER w AS more FROM s WINDOW w AS (PARTITION BY k ORDER BY t, id))
SELECT k, id, v, next_v, next_ch FROM x WHERE more = 1""")
def next_action_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.next_action(samples(spark, sf_dir), K, BY, ["v", "ch"]).select("k", "id", "v", "next_v", "next_ch")


@query("""WITH {samples}, x AS (SELECT k, id, list(v) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS actions FROM s) SELECT * FROM x WHERE len(actions) = 5""")
def action_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.action_windows(samples(spark, sf_dir), K, BY, "v", 5).select("k", "id", "actions")


@query("""WITH {samples}, n AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY t, id) AS r, v FROM s)
SELECT a.k, a.id, [b.v, c.v, a.v] AS history FROM n a JOIN n b ON b.k = a.k AND b.r = greatest(1, CASE WHEN a.r > 4 THEN a.r - 4 ELSE 1 END)
JOIN n c ON c.k = a.k AND c.r = CASE WHEN a.r > 2 THEN a.r - 2 ELSE 1 END""")
def history_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.history(samples(spark, sf_dir), K, BY, "v", 2, 3).select("k", "id", "history")


@query("""WITH {samples}, n AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY t, id) AS i, count(*) OVER (PARTITION BY k) AS n FROM s),
w AS (SELECT *, greatest(0, least(n - 5, i - 1) - greatest(1, i - 5) + 1) AS w FROM n), g AS (SELECT k, sum(w) AS n, sum(v * w) / sum(w) AS mean, sum(v * v * w) / sum(w) AS sq FROM w WHERE w > 0 AND v IS NOT NULL GROUP BY k)
SELECT k, CAST(n AS BIGINT) AS n, round(mean, 4) AS mean, round(sqrt(greatest(sq - mean * mean, 0)), 4) AS std FROM g""")
def window_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = features.window_stats(samples(spark, sf_dir), K, BY, "v", 5)
    return d.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query("""WITH x AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, count(x) AS n, round(min(x), 6) AS least, round(max(x), 6) AS most, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x GROUP BY label, pos""")
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"))
    return features.feature_stats(e, ["label"], "x").withColumns({c: F.round(c, 6) for c in ("least", "most", "mean", "std")})


@query("""WITH q AS (SELECT vec_id, label, CASE WHEN vec_id % 9 = 0 THEN [0.0, 0, 0, 0]::DOUBLE[] ELSE list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) END AS q FROM embeddings),
d AS (SELECT *, list_dot_product(lag(q) OVER (PARTITION BY label ORDER BY vec_id), q) AS dot FROM q),
z AS (SELECT *, sum(CASE WHEN dot = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS part FROM d),
f AS (SELECT *, sum(CASE WHEN dot < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label, part ORDER BY vec_id) % 2 AS odd FROM z)
SELECT vec_id, list_transform(q, lambda x: round(CASE WHEN odd = 1 THEN -x ELSE x END, 6)) AS q FROM f""")
def continuous_quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("vec_id") % 9 == 0, F.array_repeat(F.lit(0.0), 4)).otherwise(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", q.alias("q"))
    return features.continuous_signs(e, ["label"], ["vec_id"], "q").select("vec_id", F.transform("q", lambda x: rounded(x, 6)).alias("q"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1), r AS (SELECT *, CAST(sum(rows) OVER (ORDER BY l_orderkey) AS BIGINT) AS "end" FROM c) SELECT l_orderkey, rows, "end" - rows AS start, "end" FROM r""")
def episode_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.episode_offsets(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey % 4) AS shards, count(DISTINCT l_suppkey % 4) = 1 AS ok FROM lineitem GROUP BY 1""")
def split_one_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.one_shard(table(spark, sf_dir, "lineitem").withColumn("shard", F.col("l_suppkey") % 4), "l_orderkey", "shard")


@query("""WITH {samples}, x AS (SELECT k, abs(round(v) - lead(v) OVER (PARTITION BY k ORDER BY t, id)) AS off FROM s)
SELECT k, count(off) AS steps, count(*) FILTER (off > 50) AS wrong, round(max(off), 6) AS most FROM x GROUP BY k""")
def action_equals_next_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).withColumn("action", F.round("v"))
    return features.action_is_next_state(d, K, BY, "action", "v", 50.0).withColumn("most", F.round("most", 6))


@query("""SELECT vec_id, [0.0, CAST(embedding[2] AS DOUBLE), 0.0, CAST(embedding[1] AS DOUBLE), 0.0, CAST(embedding[3] AS DOUBLE)] AS packed,
[CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)] AS unpacked FROM embeddings""")
def state_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = [3, 1, 5]
    packed = features.scattered(F.slice("embedding", 1, 3).cast("array<double>"), places, 6)
    d = table(spark, sf_dir, "embeddings").select("vec_id", packed.alias("packed"))
    return d.withColumn("unpacked", features.gathered(F.col("packed"), places))


@query("""WITH a AS (SELECT vec_id, cos(x) AS c, sin(x) AS s, p, q, r FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) AS p, CAST(embedding[3] AS DOUBLE) AS q, CAST(embedding[4] AS DOUBLE) AS r FROM embeddings))
SELECT vec_id, [round(c * 0.1 + s * 0.2 - (c * p + s * q), 6), round(-s * 0.1 + c * 0.2 - (-s * p + c * q), 6), round(0.3 - r, 6)] AS relative,
[0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE] AS absolute FROM a""")
def relative_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    x = e(0) * 10
    pose = F.array(F.cos(x), -F.sin(x), F.lit(0.0), e(1), F.sin(x), F.cos(x), F.lit(0.0), e(2), *map(F.lit, (0.0, 0.0, 1.0)), e(3), *map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    target = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.1, 0.0, 1.0, 0.0, 0.2, 0.0, 0.0, 1.0, 0.3, 0.0, 0.0, 0.0, 1.0)))
    d = table(spark, sf_dir, "embeddings").select("vec_id", pose.alias("m"))
    d = d.withColumn("rel", features.composed(features.rigid_inverse(F.col("m")), target)).withColumn("abs", features.composed(F.col("m"), F.col("rel")))
    at = lambda c: F.array(*[rounded(F.col(c)[i], 6) for i in (3, 7, 11)])
    return d.select("vec_id", at("rel").alias("relative"), at("abs").alias("absolute"))


@query("""SELECT vec_id, list_transform(range(64), lambda i: round(greatest(-0.1, least(0.1, CAST(embedding[1 + (i % 8) * 8 + i // 8] AS DOUBLE))), 6)) AS grid, list_transform(range(6), lambda i: CASE WHEN i IN (1, 4) THEN 1 ELSE 0 END) AS mask FROM embeddings""")
def packed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = features.packed_grid(F.col("embedding"), 8, 8, -0.1, 0.1)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(grid, lambda x: rounded(x, 6)).alias("grid"), features.state_mask([1, 4], 6).alias("mask"))


@query("""WITH l AS (SELECT l_orderkey, l_linestatus || l_returnflag AS name, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey, map_from_entries(list((name, v))) AS m, list_sort(list(name) FILTER (name NOT IN ('FR', 'FA', 'ON'))) AS unknown FROM l GROUP BY 1)
SELECT l_orderkey, [coalesce(m['FR'], 0), coalesce(m['FA'], 0), coalesce(m['ON'], 0)] AS "values", coalesce(unknown, []) AS unknown, len(coalesce(unknown, [])) = 0 AS ok FROM g""")
def ordered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by name in canonical order, absent ones shown as zero."""
    name = F.concat("l_linestatus", "l_returnflag").alias("name")
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", name).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))
    return features.canonical_links(d, "name", "v", ["l_orderkey"], ["FR", "FA", "ON"], shown=True)


REBUILT_SQL = """WITH x AS (SELECT user_id AS k, event_id AS id, row_number() OVER w - 1 AS i, epoch_us(ts) AS t, value AS v, lead(epoch_us(ts)) OVER w AS nt, lead(value) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT k, id, i, v + (nv - v) * (((nt - t) // 2)::DOUBLE / (nt - t)) AS o, floor(v) AS c FROM x WHERE i % 3 = 0 AND nt IS NOT NULL),
r AS (SELECT *, lead(o) OVER w AS a0, lead(c) OVER w AS a1, lead(1) OVER w AS more FROM f WINDOW w AS (PARTITION BY k ORDER BY i))"""


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event as a frame halfway to the next one, its command the event's whole value; with the frame's id."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), micros(F.col("ts")).alias("t"), "value")
    w = in_order(K, *BY)
    e = e.withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("nt", F.lead("t").over(w))
    frames = e.where((F.col("i") % 3 == 0) & F.col("nt").isNotNull()).select("k", "i", "id", (F.col("t") + F.floor((F.col("nt") - F.col("t")) / 2).cast("long")).alias("t"))
    states = e.select("k", "t", F.array("value").alias("m"))
    commands = e.select("k", "i", F.array(F.floor("value").cast("double")).alias("c"))
    return features.rebuilt_actions(frames, states, commands, K, "i", "t", "m", "i", "c").join(frames.select("k", "i", "id"), ["k", "i"])


@query(REBUILT_SQL + " SELECT k, i, [round(o, 4)] AS observed, [round(a0, 4), a1] AS action FROM r WHERE more IS NOT NULL")
def rebuilt_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations and next-frame actions from states and commands."""
    near = lambda c: F.transform(c, lambda x: rounded(x, 4)).alias(c)
    return rebuilt(spark, sf_dir).select("k", "i", near("observed"), near("action"))


@query(REBUILT_SQL + """ SELECT k, count(*) AS frames, count(*) FILTER (id % 43 = 0) AS missing, 0::BIGINT AS extra, count(*) FILTER (id % 29 = 0 AND id % 43 <> 0) AS off,
round(max(CASE WHEN id % 43 <> 0 THEN CASE WHEN id % 29 = 0 THEN 1.0 ELSE 0.0 END END), 6)::DOUBLE AS most, min(i) FILTER (id % 29 = 0 AND id % 43 <> 0) AS first_off FROM r WHERE more IS NOT NULL GROUP BY k""")
def published_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release in which some actions are shifted and some are missing, against the rebuilt ones."""
    d = rebuilt(spark, sf_dir)
    shifted = F.when(F.col("id") % 29 == 0, F.array(F.col("action")[0] + 1, F.col("action")[1])).otherwise(F.col("action"))
    published = d.where(F.col("id") % 43 != 0).select("k", "i", shifted.alias("action"))
    return features.action_errors(d, published, K, "i", "action", 1e-6).withColumn("most", F.round("most", 6))
