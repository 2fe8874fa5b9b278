"""The block model: payloads, texts and kinds of blocks, and documents as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.facts import coerced

TYPES = ("text", "table", "image", "equation", "code", "list", "unknown")


def block_type(kind: Column, table_body: Column, img_path: Column) -> Column:
    """Code and lists are text, charts images; a table without a body is an image where it has one, else unknown."""
    body, image = (F.coalesce(F.trim(c), F.lit("")) != "" for c in (table_body, img_path))
    return F.when(kind.isin("code", "list", "header", "footer", "page_number", "page_footnote", "aside_text"), "text").when(kind == "chart", "image").when((kind == "table") & ~body, F.when(image, "image").otherwise("unknown")).when(kind.isin(*TYPES), kind).otherwise("unknown")


def payload(items: DataFrame) -> DataFrame:
    """Layout items with ``block_type``, ``origin`` (furniture by the reader's own kind), ``level`` (a heading's, above 0) and ``body``: the text of a block by its kind."""
    kind = F.col("type")
    lists = F.array_join(F.transform(F.coalesce("list_items", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")
    made = block_type(kind, F.col("table_body"), F.col("img_path"))
    origin = F.when(kind.isin("header", "footer", "page_number"), "page_furniture")
    body = (
        F.when(kind == "code", F.col("code_body")).when(kind == "list", lists).when(kind == "equation", F.coalesce("latex", "text"))
        .when(made == "table", F.col("table_body")).when(made == "image", coerced("img_caption")).otherwise(F.col("text"))
    )
    return items.withColumns({"block_type": made, "origin": origin, "level": F.when(F.col("text_level") > 0, F.col("text_level")), "body": F.coalesce(F.trim(body), F.lit(""))})


def chunk_text(kind: Column, body: Column, level: Column, caption: Column, table_text: Column) -> Column:
    """A block as it stands in a chunk: headings with their marks, tables as text under their caption, images by their description."""
    head = F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(6))), F.lit(" "), body)
    titled = F.concat_ws("\n\n", F.nullif(F.trim(caption), F.lit("")), F.coalesce(table_text, body))
    return F.when((kind == "text") & (level > 0), head).when(kind == "table", titled).when(kind == "equation", F.concat(F.lit("$$"), body, F.lit("$$"))).otherwise(body)


def document_text(blocks: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """(key, markdown): the texts of a document's blocks in their order with an empty line between; empty ones leave none."""
    item = F.struct(*(F.col(o).alias(f"o{k}") for k, o in enumerate(order)), F.trim(F.col(text)).alias("t"))
    return blocks.where(F.coalesce(F.trim(text), F.lit("")) != "").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n").alias("markdown"))


def scrubbed(metadata: Column, f) -> Column:
    """A chunk's metadata with ``f`` over its heading, every part of its path and every table."""
    each = lambda c: F.transform(c, f)
    return metadata.withField("heading", f(metadata["heading"])).withField("heading_path", each(metadata["heading_path"])).withField("table_html", each(metadata["table_html"]))


def needs(kind: Column, form: Column, scanned: Column, gate: Column) -> Column:
    """Which enrichment a block asks for; null for none."""
    return F.when(form & (kind == "table"), "form_asset").when((kind == "image") & scanned, "page_form").when(kind == "image", "figure_caption").when((kind == "table") & gate.isin("accept", "truncate"), "table_summary")


def is_low_value_icon(text: Column, caption: Column) -> Column:
    """No read text, and a short caption that says icon or that nothing can be made out."""
    c = F.coalesce(F.trim(caption), F.lit(""))
    return (F.coalesce(F.trim(text), F.lit("")) == "") & (F.length(c) <= 40) & F.lower(c).rlike("icon|logo|blurr|unclear|圖示|標誌|模糊|無法辨識")


def exported(assets: DataFrame) -> DataFrame:
    """Assets that are delivered: with a text, not decorative, the first of equal ones on a page, and no fragment beside three others or more on its page unless it says twenty characters."""
    from pyspark.sql import Window

    form = F.regexp_replace(F.coalesce("retrieval_text", F.lit("")), "[ \\t\\n\\r\\x{3000}]+", "")
    told = assets.withColumn("_f", form).withColumn("_k", F.row_number().over(Window.partitionBy("doc", "page_idx", "_f").orderBy("asset_id"))).withColumn("_n", F.count("*").over(Window.partitionBy("doc", "page_idx")))
    return told.where((F.col("_f") != "") & ~F.coalesce("decorative", F.lit(False)) & (F.col("_k") == 1) & ((F.col("_n") <= 3) | (F.length("_f") >= 20))).select(*assets.columns)
