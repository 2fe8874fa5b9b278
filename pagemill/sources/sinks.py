"""Sinks: versioned publication with a checked manifest, and keyed tables with insert-or-replace.

A published folder holds ``versions/<version>`` (data), ``manifests/<version>`` (file, sha256, size) and pointers
``current/<number>-<version>``: empty files of which the one with the highest number counts. A pointer is made by a
rename, after the version was read back; nothing is ever replaced, so at any time a reader finds the last published
version, and a crash in between leaves it in place.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.catalog import upsert

_POINTER = re.compile(r"(\d{12})-(.+)")


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path as its own."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    files, path = _files(spark, f"{root}/current")
    if not files.exists(path):
        return []
    found = (_POINTER.fullmatch(s.getPath().getName()) for s in files.listStatus(path))
    return sorted((int(m[1]), m[2]) for m in found if m)


def current_version(spark: SparkSession, root: str) -> str | None:
    """The published version; null before the first. A failure to look is raised, never taken as absence."""
    found = _pointers(spark, root)
    return found[-1][1] if found else None


def publish(df: DataFrame, root: str, version: str) -> DataFrame:
    """Write a version, check it by reading it back, then point to it by a rename; a version that exists is refused with ValueError."""
    spark = df.sparkSession
    target = f"{root}/versions/{version}"
    if _files(spark, target)[0].exists(_files(spark, target)[1]):
        raise ValueError(f"version {version} exists already")
    df.write.parquet(target)
    files = manifest(spark, target)
    rows = spark.read.parquet(target).count()
    files.withColumn("version", F.lit(version)).withColumn("n_rows", F.lit(rows)).write.parquet(f"{root}/manifests/{version}")
    if not verified(spark, root, version):
        raise ValueError(f"version {version} differs from its manifest")
    system, made = _files(spark, f"{root}/current/.{uuid.uuid4().hex}")
    system.create(made, False).close()
    number = max((n for n, _ in _pointers(spark, root)), default=-1) + 1
    if not system.rename(made, _files(spark, f"{root}/current/{number:012d}-{version}")[1]):
        raise ValueError(f"version {version} was not published: another one was at the same time")
    return files


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, size) of a written folder; parts are as large as the writer makes them (``spark.sql.files.maxRecordsPerFile`` bounds them)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def current(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/versions/{version}")


def verified(spark: SparkSession, root: str, version: str) -> bool:
    """Whether a version's files are those of its manifest."""
    want = spark.read.parquet(f"{root}/manifests/{version}").select("file", "sha256")
    have = manifest(spark, f"{root}/versions/{version}").select("file", "sha256")
    return want.exceptAll(have).isEmpty() and have.exceptAll(want).isEmpty()


def upsert_table(changes: DataFrame, path: str, keys: list[str], order: str, version: str) -> DataFrame:
    """Insert or replace by key into a versioned table; the new version is published whole. A table that can't be read is an error, and stays as it is."""
    spark = changes.sparkSession
    base = current(spark, path) if current_version(spark, path) is not None else changes.limit(0)
    publish(upsert(base, changes, keys, order), path, version)
    return current(spark, path)


def checked_artifact(spark: SparkSession, root: str, version: str) -> DataFrame:
    """A version's data, refused with ValueError if it isn't the current one or was changed after publication."""
    if current_version(spark, root) != version:
        raise ValueError(f"version {version} is stale")
    if not verified(spark, root, version):
        raise ValueError(f"version {version} was changed")
    return spark.read.parquet(f"{root}/versions/{version}")


def write_exports(documents: DataFrame, folder: str) -> DataFrame:
    """Markdown files, one folder for each document (``doc_id``; ``name`` and ``markdown`` in it), and an index (doc_id, name, sha256, n_chars) beside them; many documents go through one write, without a loop."""
    index = documents.select("doc_id", "name", F.sha2("markdown", 256).alias("sha256"), F.length("markdown").alias("n_chars"))
    documents.select("doc_id", "name", F.col("markdown").alias("value")).repartition("doc_id").write.partitionBy("doc_id", "name").option("lineSep", "\n").text(f"{folder}/documents")
    index.write.parquet(f"{folder}/index")
    return documents.sparkSession.read.parquet(f"{folder}/index")


def write_bundle(frames: dict[str, DataFrame], root: str, version: str) -> dict[str, DataFrame]:
    """Several tables of one version (plan, records, chunks, ...), each published with its manifest; they are current only when all are written, the last one named ``bundle`` lists the others."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        publish(df, f"{root}/{name}", version)
    publish(spark.createDataFrame([(name, version) for name in frames], "name string, version string"), f"{root}/bundle", version)
    return {r["name"]: spark.read.parquet(f"{root}/{r['name']}/versions/{r['version']}") for r in current(spark, f"{root}/bundle").collect()}  # one row for each name given
