"""Reading and publishing tables under explicit contracts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines under a fixed schema, with source_file; a malformed line fails the read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


def read_lines(spark: SparkSession, path: str, schema: str, longest: int = 1 << 20) -> DataFrame:
    """JSON lines with where they stand: source_file and line (from 1), exact however Spark splits the files.

    A malformed line and one of more than ``longest`` letters fail the read.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    ok = F.assert_true(F.length("value") <= longest, F.lit(f"a line of {path} exceeds {longest} letters"))
    parsed = raw.select("source_file", "_block", "_id", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_v"), ok.alias("_ok"))
    before = F.sum("_n").over(Window.partitionBy("source_file").orderBy("_block")) - F.col("_n")
    blocks = raw.groupBy("source_file", "_block").agg(F.count("*").alias("_n")).withColumn("_before", before)
    line = F.row_number().over(Window.partitionBy("source_file", "_block").orderBy("_id")) + F.col("_before")
    d = parsed.join(blocks, ["source_file", "_block"]).withColumn("line", line.cast("long"))
    return d.where(F.col("_ok").isNull()).select("_v.*", "source_file", "line")


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a Parquet table; a missing one is an error, and nothing else is read."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the schema's column order; a missing, unknown or otherwise typed column is an error."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    wrong = [n for n in want if n in have and have[n] != want[n]]
    unknown, missing = sorted(set(have) - set(want)), sorted(set(want) - set(have))
    if wrong or unknown or missing:
        raise ValueError(f"schema: wrong type {wrong}, unknown {unknown}, missing {missing}")
    return df.select(*[F.col(f"`{n}`") for n in want])


def discover(spark: SparkSession, path: str, pattern: str, number: str) -> DataFrame:
    """Files below ``path`` that match ``pattern``, but for partial ones: file, number (of the first group), bytes.

    File contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    d = files.select(F.col("path").alias("file"), name.alias("_n"), F.col("length").alias("bytes"))
    d = d.where(F.col("_n").rlike(pattern) & ~F.col("_n").endswith(".partial"))
    return d.select("file", F.regexp_extract("_n", number, 1).cast("long").alias("number"), "bytes")


def published_only(episodes: DataFrame, manifest: DataFrame, key: list[str], expected: int) -> DataFrame:
    """Episodes that an authoritative manifest names; another number of them than ``expected`` is an error."""
    kept = episodes.join(manifest.select(*key).distinct(), key, "left_semi")
    found = kept.select(*key).distinct().count()
    if found != expected:
        raise ValueError(f"the manifest promises {expected} episodes, {found} are there")
    return kept


def preferred(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """The rows of each key from the first source that has it: all columns, and source (its place)."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    best = F.min("source").over(Window.partitionBy(*key))
    return both.withColumn("_best", best).where(F.col("source") == F.col("_best")).drop("_best")


def merged_fields(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Each key once, every field from the first source that knows it."""
    fields = [c for c in sources[0].columns if c not in key]
    ranked = [s.select(*key, F.lit(i).alias("_i"), *fields) for i, s in enumerate(sources)]
    both = reduce(DataFrame.unionByName, ranked)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("_i", c))).getField(c).alias(c)
    return both.groupBy(*key).agg(*map(first, fields))


def discovered(direct: DataFrame, batches: DataFrame, members: str, key: list[str]) -> DataFrame:
    """Trials given directly and those that batches list (an array of keys as structs), each once: key and batches (how many list it)."""
    a = direct.select(*key, F.lit(0).alias("_b"))
    b = batches.select(F.explode(members).alias("_m")).select("_m.*").select(*key, F.lit(1).alias("_b"))
    return a.unionByName(b).groupBy(*key).agg(F.sum("_b").cast("long").alias("batches"))


def listing(files: DataFrame, file: str, pattern: str, size: str) -> DataFrame:
    """Files named by episode and camera (two groups of ``pattern``): episode in numeric order, cameras as a sorted set, files, bytes; others are left out."""
    d = files.where(F.col(file).rlike(pattern))
    d = d.select(F.regexp_extract(file, pattern, 1).cast("long").alias("episode"), F.regexp_extract(file, pattern, 2).alias("camera"), size)
    return d.groupBy("episode").agg(F.array_sort(F.collect_set("camera")).alias("cameras"), F.count("*").alias("files"), F.sum(size).alias("bytes"))


def inspected(episodes: DataFrame, scene: str, cameras: str, wanted: list[str], success: str, target: int) -> DataFrame:
    """The episodes, if they are of one scene, each has the wanted cameras, and ``target`` of them succeeded; else an error that says what is missing."""
    lacking = F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col(cameras))) > 0
    r = episodes.agg(F.countDistinct(scene).alias("scenes"), F.count_if(lacking).alias("lacking"), F.count_if(F.coalesce(F.col(success), F.lit(False))).alias("wins")).first()
    if r.scenes != 1 or r.lacking or r.wins < target:
        raise ValueError(f"{r.scenes} scenes, {r.lacking} episodes without all of {wanted}, {r.wins} successes of {target}")
    return episodes


def publish_csv(df: DataFrame, path: str) -> int:
    """Flat columns as CSV with a header; never overwrites; returns the rows, counted again from the files."""
    df.write.option("header", True).mode("errorifexists").csv(path)
    have, want = df.sparkSession.read.option("header", True).csv(path).count(), df.count()
    if have != want:
        raise OSError(f"{path}: wrote {want}, read {have}")
    return have


def canonical_cameras(cameras: Column, order: list[str], head: str) -> Column:
    """Known cameras in canonical order; null unless they are not empty, unique, all known, and hold the head camera."""
    known = F.array(*map(F.lit, order))
    ok = (F.size(cameras) > 0) & (F.size(F.array_distinct(cameras)) == F.size(cameras)) & (F.size(F.array_except(cameras, known)) == 0) & F.array_contains(cameras, head)
    return F.when(ok, F.array_intersect(known, cameras))


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``); only a local session may have none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/tidewater-{tag}-{uuid.uuid4().hex}"


def cameras_missing(df: DataFrame, have: str, wanted: list[str]) -> DataFrame:
    """Rows whose array of cameras lacks some of the wanted ones, with those (as lacking)."""
    lacking = F.array_except(F.array(*map(F.lit, wanted)), F.col(have))
    return df.withColumn("lacking", lacking).where(F.size("lacking") > 0)


def table_digest(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free checksum of a table."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38, 0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, max_records: int = 0) -> tuple[int, int]:
    """Write beside ``path``, read back, compare, then rename: never overwrites, never shows half a table.

    Returns rows and checksum. ``df`` must be deterministic.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}"
    writer = df.write.option("compression", "snappy").option("maxRecordsPerFile", max_records)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    want = table_digest(df.select(*[F.col(f"`{f.name}`") for f in df.schema]))
    got = table_digest(spark.read.schema(df.schema).parquet(staging).select(*[F.col(f"`{f.name}`") for f in df.schema]))
    if want != got:
        raise OSError(f"{staging}: wrote {want}, read {got}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"could not publish {path}")
    return got


def flat_rows(df: DataFrame, key: list[str], array: str) -> DataFrame:
    """One row for each element of an array of structs, for CSV."""
    return df.select(*key, F.posexplode(array).alias("place", "_e")).select(*key, "place", "_e.*")
