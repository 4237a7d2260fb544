"""Published feed documents in versions.

A run writes the documents of the channels that it changes to a folder of its
own, then a manifest (which folder each channel's document is in), and last one
small file that names the manifest and is named by the version's number. That
file is renamed into place and never replaces another. So readers see a version
whole or not at all, and of two runs that began from the same version one
commits and the other gets a Conflict. Documents are kept as they are, byte for
byte; feed_xml.write_feeds makes files of them for a server.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "channel string, rss string"
#: A commit that would leave the documents in more folders than this writes them all anew.
FOLDERS = 50


class Conflict(RuntimeError):
    """Another run has committed since this one read the documents."""


def _hadoop(spark: SparkSession, path: str):
    """The path's file system, and a function from text to paths under it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *x: jvm.org.apache.hadoop.fs.Path("/".join((path, *x)))


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _hadoop(spark, path)
    if not fs.exists(at("versions")):
        return []
    return sorted(int(n) for x in fs.listStatus(at("versions")) if (n := x.getPath().getName()).isdigit())


def version(spark: SparkSession, path: str) -> int:
    """The last version's number; 0 before the first."""
    return max(_versions(spark, path), default=0)


def _manifest(spark: SparkSession, path: str, number: int) -> DataFrame:
    """channel, folder of a version."""
    schema = "channel string, folder string"
    if not number:
        return spark.createDataFrame([], schema)
    name = spark.read.text(f"{path}/versions/{number}").first()["value"]
    return spark.read.schema(schema).parquet(f"{path}/manifests/{name}")


def _documents(manifest: DataFrame, path: str) -> DataFrame:
    spark = manifest.sparkSession
    folders = [r["folder"] for r in manifest.select("folder").distinct().collect()]  # FOLDERS at most
    if not folders:
        return spark.createDataFrame([], DOCUMENTS)
    found = None
    for folder in folders:
        some = spark.read.schema(DOCUMENTS).parquet(f"{path}/data/{folder}").withColumn("folder", F.lit(folder))
        found = some if found is None else found.unionByName(some)
    return found.join(manifest, ["channel", "folder"], "left_semi").select("channel", "rss")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """channel, rss of a version (the last one if none is given); no rows before the first."""
    return _documents(_manifest(spark, path, version(spark, path) if number is None else number), path)


def commit(documents: DataFrame, path: str, base: int) -> int:
    """Publish documents(channel, rss), each channel once, on top of version ``base``; returns the new version's number.

    Channels that documents hasn't stay as they are. Raises Conflict, and
    publishes nothing, if there is a version after ``base`` already.
    """
    spark = documents.sparkSession
    fs, at = _hadoop(spark, path)
    if version(spark, path) != base:
        raise Conflict(f"version {version(spark, path)} of {path} came after {base}")
    run = uuid.uuid4().hex
    before = _manifest(spark, path, base)
    if before.select("folder").distinct().count() >= FOLDERS:
        old = _documents(before, path).join(documents.select("channel"), "channel", "left_anti")
        documents, before = documents.unionByName(old), before.limit(0)
    documents.select("channel", "rss").write.parquet(f"{path}/data/{run}")
    written = spark.read.schema(DOCUMENTS).parquet(f"{path}/data/{run}").select("channel").distinct()
    kept = before.join(written, "channel", "left_anti")
    kept.unionByName(written.select("channel", F.lit(run).alias("folder"))).coalesce(1).write.parquet(f"{path}/manifests/{run}")
    fs.mkdirs(at("versions"))
    out = fs.create(at("versions", f"_{run}"), False)
    out.write(bytearray(run, "ascii"))
    out.close()
    _rename(spark, at("versions", f"_{run}"), at("versions", str(base + 1)), base)
    return base + 1


def _rename(spark: SparkSession, source, target, base: int) -> None:
    sc = spark.sparkContext
    rename = sc._jvm.org.apache.hadoop.fs.Options.Rename
    never = sc._gateway.new_array(rename, 1)
    never[0] = rename.NONE
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, never)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            context.delete(source, False)
            raise Conflict(f"{target} was committed after version {base} was read") from None
        raise


def clean(spark: SparkSession, path: str, keep: int = 10) -> None:
    """Delete the versions before the last ``keep``, and the folders and manifests that only they name."""
    fs, at = _hadoop(spark, path)
    numbers = _versions(spark, path)
    names, folders = set(), set()
    for n in numbers[-keep:]:
        names.add(spark.read.text(f"{path}/versions/{n}").first()["value"])
        folders |= {r["folder"] for r in _manifest(spark, path, n).select("folder").distinct().collect()}
    gone = {spark.read.text(f"{path}/versions/{n}").first()["value"] for n in numbers[:-keep]}
    older = set()
    for n in numbers[:-keep]:
        older |= {r["folder"] for r in _manifest(spark, path, n).select("folder").distinct().collect()}
    for n in numbers[:-keep]:
        fs.delete(at("versions", str(n)), False)
    for x in gone - names:
        fs.delete(at("manifests", x), True)
    for x in older - folders:
        fs.delete(at("data", x), True)
