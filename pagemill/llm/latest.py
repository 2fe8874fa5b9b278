"""The latest delivery of each chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_texts(chunks: DataFrame) -> DataFrame:
    """(run_id, chunk_id, content): of each key the latest delivery, of equally late ones the greatest text; rows whose key has a null are told apart by their content."""
    unknown = F.when(F.col("run_id").isNull() | F.col("chunk_id").isNull(), F.xxhash64("content"))
    newest = chunks.select("run_id", "chunk_id", "content", "written_at", unknown.alias("unknown")).groupBy("run_id", "chunk_id", "unknown")
    return newest.agg(F.max_by("content", F.struct("written_at", "content")).alias("content")).drop("unknown")
