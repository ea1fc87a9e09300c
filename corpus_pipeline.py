"""A corpus pipeline of five training-data operators, each stage written and reread as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, jaccard, pii, quality, transducer
from tidewater.llm.common import discard, fresh, quoted, stash
from tidewater.llm.queries import PIECES, PII_KEY

#: Documents that score lower are rejected; well below what clean ones score.
LEAST_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the classifier takes for low quality."""
    network, column = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh(docs, "quality_score")
    kept = quality.scored(docs, network, column).where(F.col(column) >= LEAST_QUALITY)
    return kept.select(*[F.col(quoted(c)) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that near-duplicate links connect, keep one: that of the smallest doc_id, a null one only if there is no other."""
    return jaccard.one_of_each(docs, percent=75, size=5)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace private data by pseudonyms; n_chars follows the text."""
    column = fresh(docs, "pii")
    done = pii.pseudonymise(docs, PII_KEY, column=column).select(*[F.col(quoted(c)) for c in docs.columns])
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding."""
    return transducer.encode_decode(docs, public_tokenizers.path(PIECES), keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmarks),
    ("PII", hide_private_data),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express the classifier, the pseudonyms or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs, path = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            discard(spark, before)  # nothing reads it any more
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
