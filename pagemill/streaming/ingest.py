"""Incremental ingest: each new file or table part is taken once, equal documents once, after a restart nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema, key: str, target: str, checkpoint: str, per_batch: int = 16) -> None:
    """Take what is new in ``source`` (parquet parts), drop rows whose key is in the target already, append the rest; returns when all is taken.

    The checkpoint holds what was taken, so a restart goes on where it stopped. Keys seen are not kept as state: each batch is
    joined against those of the target's other batches, which are all that is read of it. Batch files are written
    under the batch's number, so a batch that is run again after a failure replaces itself. Rows with a null key are kept, all of them.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        known = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if number:
            seen = spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, batch int").parquet(target).where(F.col("batch") < number).select(key)
            known = known.join(seen, key, "left_anti")
        fresh = known.unionByName(batch.where(F.col(key).isNull())).select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; late rows within the watermark count. Works on a stream and on a table alike."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
        .select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("window_us"), "event_type", "n", "total")
    )
