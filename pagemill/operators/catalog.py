"""Catalogue operators: latest by key, paging, stage progress, anti-joins, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key: an aggregate with map-side combine instead of a sort of every group."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order``, which has to end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def current_stage(stages: DataFrame) -> DataFrame:
    """(run_id, stage, status): the running stage, else the last that failed or was cancelled, else the last that succeeded."""
    rank = F.when(F.col("status") == "running", 3).when(F.col("status").isin("failed", "canceled"), 2).when(F.col("status") == "succeeded", 1).otherwise(0)
    return stages.groupBy("run_id").agg(F.max_by(F.struct("stage", "status"), F.struct(rank, F.col("id"))).alias("x")).select("run_id", "x.stage", "x.status")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or replace by key; of several changes of a key the latest by ``order`` stands, and a change beats the base."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(order).desc())
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def invalidate(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def lookup(requests: DataFrame, cache: DataFrame, keys: list[str], value: str, order: str | None = None) -> DataFrame:
    """``requests`` with the cached value and ``hit``; of several values of a key the one with the greatest ``order`` (the value itself without one)."""
    found = cache.groupBy(*keys).agg(F.max_by(value, order or value).alias(value)).withColumn("hit", F.lit(True))
    return requests.join(found, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
