"""Several tables that appear as one: staged, read back, and made visible by a single manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewater.sources.tables import table_digest

#: Without a leading underscore, which Spark would not read.
MANIFEST = "manifest.json"


def _files(spark: SparkSession, path: str):
    """The path in the file system's own terms, its file system, and the session's Java side."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def manifest(spark: SparkSession, path: str) -> dict[str, dict] | None:
    """What a published set holds, by table (folder, rows, digest, columns); None while nothing is visible."""
    at, fs, _ = _files(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not fs.exists(at):
        return None
    return json.loads(spark.read.text(at.toString(), wholetext=True).first().value)


def publish_set(tables: dict[str, DataFrame], path: str) -> dict[str, dict]:
    """Publishes all tables or none; returns the manifest.

    Each table is written to a folder of its own run, read back and compared by rows
    and digest. Then the manifest is put in place under a name that must be free:
    readers follow it alone, so that is the one moment at which the set appears.
    Nothing published is ever overwritten: the same set again is left as it is, another one
    is an error. A run that fails takes its own folders away; one that dies leaves
    folders that no manifest names. Tables must be deterministic.
    """
    if not tables:
        raise ValueError("a set needs a table")
    spark = next(iter(tables.values())).sparkSession
    root, run, out = path.rstrip("/"), uuid.uuid4().hex[:12], {}
    before = manifest(spark, root)
    try:
        for name, df in tables.items():
            want = table_digest(df)
            told = {"rows": want[0], "digest": str(want[1]), "columns": [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]}
            if before is not None:
                kept = {k: v for k, v in before.get(name, {}).items() if k != "folder"}
                if kept != told or set(before) != set(tables):
                    raise FileExistsError(f"{root} holds another set: {name}")
                continue
            folder = f"{name}-{run}"
            df.write.parquet(f"{root}/{folder}")
            got = table_digest(spark.read.schema(df.schema).parquet(f"{root}/{folder}"))
            if got != want:
                raise OSError(f"{root}/{folder}: wrote {want}, read {got}")
            out[name] = {"folder": folder, **told}
        if before is not None:
            return before
        _show(spark, root, run, out)
        return out
    except BaseException:
        for name in tables:
            at, fs, _ = _files(spark, f"{root}/{name}-{run}")
            fs.delete(at, True)
        raise


def _show(spark: SparkSession, root: str, run: str, content: dict[str, dict]) -> None:
    """Puts the manifest in place, whole, where none may be."""
    draft, fs, jvm = _files(spark, f"{root}/draft-{run}.json")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        # Without options a rename fails where the name is taken, so of two runs one wins.
        context.rename(fs.makeQualified(draft), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")), none)
    except Exception as e:
        fs.delete(draft, False)
        raise FileExistsError(f"{root}: {e}") from e


def read_set(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a published set by name; an error while none is visible."""
    told = manifest(spark, path)
    if told is None:
        raise FileNotFoundError(f"{path} holds no published set")
    return {n: spark.read.schema(", ".join(f"`{c.rsplit(' ', 1)[0]}` {c.rsplit(' ', 1)[1]}" for c in t["columns"])).parquet(f"{path.rstrip('/')}/{t['folder']}") for n, t in told.items()}


def verify_set(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables whose files no longer give the manifest's rows and digest."""
    told = manifest(spark, path) or {}
    return [n for n, df in read_set(spark, path).items() if table_digest(df) != (told[n]["rows"], int(told[n]["digest"]))]
