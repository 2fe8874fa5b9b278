"""A work queue and stage checkpoints as streams.

Requests are files (JSON lines or parquet) in a folder; a stream takes them in the order in which they arrived, a bounded
number at a time, works on each batch and writes what came of it under the batch's number, so that a batch that is run again
after a failure replaces itself (at least once, without doubles). What was taken is in the stream's checkpoint, so a
restart goes on where it stopped.

A stage is done for a document when a receipt with the fingerprint of its inputs is there; work whose fingerprint hasn't changed is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(spark: SparkSession, queue: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, per_batch: int = 2) -> None:
    """Work on all waiting requests, ``per_batch`` files at a time, oldest first; returns when none is left."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("latestFirst", "false").json(queue)

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fingerprint(*parts: Column) -> Column:
    """A hash of what a stage depends on; nulls and empty texts differ."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, stage, fingerprint) of what was done; empty before the first."""
    schema = "doc_id string, stage string, fingerprint string, batch int"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def pending(inputs: DataFrame, done: DataFrame, stage: str) -> DataFrame:
    """Inputs (doc_id, fingerprint) for which the stage's latest receipt has another fingerprint, or that have none."""
    last = done.where(F.col("stage") == stage).groupBy("doc_id").agg(F.max_by("fingerprint", "batch").alias("_done"))
    joined = inputs.join(last, "doc_id", "left")
    return joined.where(~F.col("fingerprint").eqNullSafe(F.col("_done"))).drop("_done")


def run_stage(inputs: DataFrame, folder: str, stage: str, batch: int, work: Callable[[DataFrame], DataFrame], target: str) -> int:
    """Work on what is pending, then leave receipts; returns how many documents it was. A failure in between leaves no receipt, and the next call does the work again under its own number."""
    spark = inputs.sparkSession
    todo = pending(inputs, receipts(spark, folder), stage)
    n = todo.count()
    if n:
        work(todo).write.mode("overwrite").parquet(f"{target}/batch={batch}")
        todo.select("doc_id", F.lit(stage).alias("stage"), "fingerprint").write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    return n
