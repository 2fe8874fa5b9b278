"""From layout items to a checked delivery: the passes over blocks in their order, and what is said of a delivery at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators import coverage, layout, render
from pagemill.operators.blocks import is_ocr_noise_heading
from pagemill.operators.quality import severity_weight


def normalised(items: DataFrame, supplements: DataFrame | None = None) -> DataFrame:
    """Blocks from layout items (doc, block_id, page_idx, reading_order, the fields of an item, x0 .. y1), in the one order in which the passes make sense:

    types and texts; reading order by page; later occurrences of repeats dropped; supplements spliced in; furniture that stands on one
    page released, what repeats in the margins tagged (after the supplements, which may be furniture too); headings that are reading noise lose their level.
    """
    made = render.payload(items).withColumnRenamed("type", "item_type").withColumnRenamed("block_type", "type").drop("text").withColumnRenamed("body", "text")
    order = F.row_number().over(Window.partitionBy("doc").orderBy("page_idx", "reading_order")) - 1
    fields = ("doc", "block_id", "page_idx", "reading_order", "type", "text", "x0", "y0", "x1", "y1", "origin", "level")
    blocks = layout.drop_repeats(made.withColumn("reading_order", order).select(*fields))
    if supplements is not None:
        fresh = layout.uncovered(supplements.withColumnRenamed("block_id", "fragment_id"), blocks).withColumnRenamed("fragment_id", "block_id")
        placed = layout.place_supplements(blocks, fresh)
        more = fresh.select("doc", "block_id", "page_idx", F.lit(0).alias("reading_order"), F.lit("text").alias("type"), "text", "x0", "y0", "x1", "y1", F.lit(None).cast("string").alias("origin"), F.lit(None).cast("int").alias("level"))
        blocks = blocks.unionByName(more).drop("reading_order").join(placed, ["doc", "block_id"]).select(*fields)
    tagged = layout.tag_furniture(layout.release_single_furniture(blocks))
    return tagged.withColumn("level", F.when(~F.coalesce(is_ocr_noise_heading(F.col("text")), F.lit(False)), F.col("level")))


def finalised(blocks: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, expected, missing_documents, missing_chunks, n_issues, score, status, ready): what a delivery lacks of its source.

    Content blocks with a text are expected in the documents and in the chunks; issues are missing content in either, no document, no chunk and chunk ids that occur twice, all of them grave.
    """
    content = blocks.where(~layout.is_non_content() & (F.coalesce(F.trim("text"), F.lit("")) != ""))
    lost = lambda df, name: coverage.ledger(content, df, "doc", "block_id", "text", "text").groupBy("doc").agg(F.sum((~F.col("covered")).cast("int")).alias(name), F.count("*").alias(f"_{name}"))
    stats = chunks.groupBy("doc").agg(F.count("*").alias("_n"), F.countDistinct("chunk_id").alias("_ids"))
    has = documents.groupBy("doc").agg(F.count("*").alias("_docs"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = blocks.select("doc").distinct().join(lost(documents, "missing_documents"), "doc", "left").join(lost(chunks, "missing_chunks"), "doc", "left").join(stats, "doc", "left").join(has, "doc", "left")
    broken = (zero("_n") == 0) | (zero("_n") != zero("_ids"))
    issues = sum((x.cast("int") for x in (zero("missing_documents") > 0, zero("missing_chunks") > 0, broken, zero("_docs") == 0)), F.lit(0))
    out = joined.select("doc", zero("_missing_documents").cast("int").alias("expected"), zero("missing_documents").cast("int").alias("missing_documents"), zero("missing_chunks").cast("int").alias("missing_chunks"), issues.alias("n_issues"))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("n_issues") * severity_weight(F.lit("high")))
    return out.withColumn("score", F.round(score, 3)).withColumn("status", F.when(F.col("n_issues") > 0, "needs_review").otherwise("pass")).withColumn("ready", F.col("n_issues") == 0)
