"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, stash


def components(links: DataFrame) -> DataFrame:
    """The smallest vertex that each linked vertex can reach: v, label.

    ``links`` has columns a and b (of one type that has an order, not null; order,
    repeats and loops do not matter). Every round takes the smallest label among a vertex's neighbours
    and then that label's own label, so paths shrink as by halving; rounds end when
    no label changes. Each round is written to the shared folder, and the driver
    sees only a count.
    """
    spark = links.sparkSession
    links = links.select("a", "b").where(F.col("a") != F.col("b"))
    both = links.union(links.select("b", "a")).distinct()
    both, path_e = stash(both, "links")
    labels, path = stash(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("v", "b"), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("up"))
        step = step.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        step, path_new = stash(step, "labels")
        changed = step.where(F.col("label") != F.col("old")).limit(1).count()
        discard(spark, path)
        labels, path = step.select("v", "label"), path_new
        if not changed:
            discard(spark, path_e)
            return labels
