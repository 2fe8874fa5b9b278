"""Parquet table source and the shared-folder lineage cut."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a data folder; the schema comes from the footers, so projections prune columns."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (all threads on one
    machine, as in tests) takes a folder of its own; on a cluster that is refused with ValueError, since executors would write to different disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context_dir = spark.sparkContext.getCheckpointDir()
        master = spark.sparkContext.master
        if not context_dir and not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors share")
        folder = context_dir or "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, label: str, before: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table ends the lineage, so a lost executor costs nothing that was computed before it, and a
    result used twice is computed once. The folders are removed when the driver ends or by ``release``; in a loop,
    ``before`` is what the last round wrote, of which nothing is needed any more once the new table stands.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pagemill/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append((spark, path))
    if before is not None and (old := getattr(before, "_written", None)):
        _remove(spark, old)
        _WRITTEN.remove((spark, old))
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone; local folders are removed directly
        if path.startswith("file://"):
            shutil.rmtree(path[len("file://") :], ignore_errors=True)


@atexit.register
def release() -> None:
    """Remove all folders that ``cut`` has written: for long sessions, when no result made from them is needed any more."""
    for spark, path in _WRITTEN:
        _remove(spark, path)
    _WRITTEN.clear()


def data_path(root: str, name: str) -> str:
    return os.path.join(root, f"{name}.parquet")
