"""Records of blocks, assets and runs: joins with what enriches them, groups in first-seen order, best of each page, merged fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_assets(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Blocks whose image is an asset take its ``retrieval_text``; those of decorative assets drop out."""
    own = assets.select("block_id", F.col("retrieval_text").alias("_text"), F.coalesce("decorative", F.lit(False)).alias("_drop"))
    joined = blocks.join(own, "block_id", "left").where(~F.coalesce("_drop", F.lit(False)))
    return joined.withColumn("text", F.coalesce(F.nullif(F.trim("_text"), F.lit("")), F.col("text"))).select(*blocks.columns)


def latest_enrichments(lines: DataFrame) -> DataFrame:
    """(block_id and the columns of the last line of each block): a later line takes the place of an earlier one; lines that weren't read are left out."""
    rest = [c for c in lines.columns if c not in ("block_id", "line_no", "_read_error")]
    good = lines.where("_read_error is null and block_id is not null")
    best = good.groupBy("block_id").agg(F.max_by(F.struct(*rest), "line_no").alias("_x"))
    return best.select("block_id", *(F.col(f"_x.{c}").alias(c) for c in rest))


def filtered(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal what is asked; a None asks for nothing, and a missing flag counts as false."""
    for name, value in wanted.items():
        if value is not None:
            own = F.coalesce(F.col(name), F.lit(False)) if isinstance(value, bool) else F.col(name)
            rows = rows.where(own == value)
    return rows


def without_replaced(rows: DataFrame, replaced_blocks: DataFrame, replaced_pages: DataFrame) -> DataFrame:
    """Rows of neither a replaced block nor a replaced page."""
    return rows.join(replaced_blocks.select("block_id").distinct(), "block_id", "left_anti").join(replaced_pages.select("page_idx").distinct(), "page_idx", "left_anti")


def usable(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings of verified pages, and verified blocks whose context is complete."""
    joined = findings.join(pages.select("page_idx", F.col("status").alias("_page")), "page_idx", "left")
    good = F.coalesce(F.col("_page") == "verified", F.lit(False)) | (F.col("status") == "verified") & F.coalesce("context_complete", F.lit(False))
    return joined.where(good).select(*findings.columns)


def evidence_for(targets: DataFrame, evidence: DataFrame) -> DataFrame:
    """(target_id, evidence_id): evidence of a target's page, of its block where it names one, and of its provider where it names one."""
    met = targets.alias("t").join(evidence.alias("e"), F.col("t.page_idx") == F.col("e.page_idx"))
    own = lambda c: F.col(f"t.{c}").isNull() | (F.col(f"t.{c}") == F.col(f"e.{c}"))
    return met.where(own("block_id") & own("provider")).select("t.target_id", "e.evidence_id")


def in_groups(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """(chunk_id, item_id): chunks that share a block with an item."""
    a = chunks.select("chunk_id", F.explode("block_ids").alias("_b")).distinct()
    b = items.select("item_id", F.explode("block_ids").alias("_b")).distinct()
    return a.join(b, "_b").select("chunk_id", "item_id").distinct()


def missing_fields(required: list[str], names: Column) -> Column:
    """Required names that an array of names lacks."""
    return F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.coalesce(names, F.array().cast("array<string>")))


def with_residual(structured: DataFrame, blocks: DataFrame, covered: DataFrame) -> DataFrame:
    """Structured chunks, and a ``preserved_`` chunk for each block that they don't cover."""
    rest = blocks.join(covered.where("covered").select("doc", "block"), ["doc", "block"], "left_anti")
    return structured.select("doc", "chunk_id", "content").unionByName(rest.select("doc", F.concat(F.lit("preserved_"), F.col("block")).alias("chunk_id"), F.col("text").alias("content")))


def groups_in_order(rows: DataFrame, keys: list[str], by: str, order: str, value: str) -> DataFrame:
    """(keys, by, place, members): groups in the order in which they are first seen, members in their order."""
    g = rows.groupBy(*keys, by).agg(F.min(order).alias("_first"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("members"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))).drop("_first")


def merged_fields(fields: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """(keys, name, type, required, aliases, evidence): one field for each (name without white space and case, type): required if any is, aliases in first-seen order, the first evidence that isn't empty."""
    form = fields.withColumn("_name", F.lower(F.regexp_replace("name", "[ \\t\\n\\r\\x{3000}]+", ""))).withColumn("_type", F.lower(F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("text")))).where("_name <> ''")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("aliases", F.array().cast("array<string>")).alias("a"))))
    aliases = F.array_distinct(F.filter(F.flatten(F.transform(ordered, lambda x: x["a"])), lambda t: F.coalesce(F.trim(t), F.lit("")) != ""))
    said = F.nullif(F.trim("evidence"), F.lit(""))
    return form.groupBy(*keys, "_name", F.col("_type").alias("type")).agg(
        F.min_by("name", order).alias("name"), F.bool_or(F.coalesce("required", F.lit(False))).alias("required"), aliases.alias("aliases"), F.min_by(F.when(said.isNotNull(), said), F.when(said.isNotNull(), F.col(order))).alias("evidence"), F.min(order).alias("_o")
    ).select(*keys, "name", "type", "required", "aliases", "evidence", F.col("_o").alias("seq"))


def best_of(rows: DataFrame, keys: list[str], scores: list[Column], order: str) -> DataFrame:
    """The row of each key with the greatest scores, compared one after the other; ties keep the first."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(s.alias(f"s{k}") for k, s in enumerate(scores)), (-F.col(order)).alias("o"))).alias("_x"))
    return best.select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))


def by_section(fields: DataFrame, keys: list[str], sections: list[str]) -> DataFrame:
    """(keys, section, place, names): fields of each section in their order, sections in the given order, others after them by name."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, sections)), F.col("section")), F.lit(0))
    names = F.transform(F.array_sort(F.collect_list(F.struct("field_order", "name"))), lambda x: x["name"])
    grouped = fields.groupBy(*keys, "section").agg(names.alias("names")).withColumn("_r", F.when(rank > 0, rank).otherwise(len(sections) + 1))
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_r", "section"))).drop("_r")


def carried(rows: DataFrame, keys: list[str], order: str, levels: list[str]) -> DataFrame:
    """``levels`` (outer to inner) carried down the rows of a table: each takes its last value, which a new value of an outer level clears."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for k, level in enumerate(levels):
        # the row of the last new value of any outer level; a value before it is of another context
        outer = [F.last(F.when(F.col(f"_own_{x}").isNotNull(), F.col(order)), ignorenulls=True).over(w) for x in levels[:k]]
        out = out.withColumn(f"_own_{level}", F.nullif(F.col(level), F.lit("")))
        since = reduce(F.greatest, [F.coalesce(x, F.lit(-1)) for x in outer]) if len(outer) > 1 else F.coalesce(outer[0], F.lit(-1)) if outer else F.lit(-1)
        at = F.last(F.when(F.col(f"_own_{level}").isNotNull(), F.col(order)), ignorenulls=True).over(w)
        out = out.withColumn(f"_to_{level}", F.when(at >= since, F.last(f"_own_{level}", ignorenulls=True).over(w)))
    return out.select(*(F.col(f"_to_{c}").alias(c) if c in levels else c for c in rows.columns))


def merged_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): overlapping or touching ranges as one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("_new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def collections(tables: DataFrame, least: int = 30) -> DataFrame:
    """(doc, title, place, members): tables of documents with ``least`` or more of them by their title, white space and case aside; groups by their first page, members by page and id."""
    many = tables.groupBy("doc").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("doc")
    form = tables.join(many, "doc", "left_semi").withColumn("_form", F.lower(F.regexp_replace("title", "[ \\t\\n\\x{3000}]+", "")))
    members = F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "table_id"))), lambda x: x["table_id"])
    g = form.groupBy("doc", "_form").agg(F.min_by("title", F.struct("page_idx", "table_id")).alias("title"), F.min("page_idx").alias("_p"), members.alias("members"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("_p", "_form"))).select("doc", "title", "place", "members")


def grounded(terms: DataFrame, visible: DataFrame) -> DataFrame:
    """(doc, item, text): captions without the Latin terms of three letters or more that nothing visible in their document holds; a keyword stays only if all its terms are there."""
    pattern = "([A-Za-z][A-Za-z0-9]{2,})"
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda t: F.lower(t)))
    asked = terms.select("doc", F.explode(words("text")).alias("_w")).distinct()
    seen = visible.select("doc", F.explode(words("text")).alias("_w")).distinct()
    lost = asked.join(seen, ["doc", "_w"], "left_anti").groupBy("doc").agg(F.collect_set("_w").alias("_lost"))
    joined = terms.join(lost, "doc", "left").withColumn("_lost", F.coalesce("_lost", F.array().cast("array<string>")))
    own = words("text")
    spaces = lambda c: F.trim(F.regexp_replace(c, "[ ]{2,}", " "))
    kept = F.filter(F.split("text", "(?<![A-Za-z0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?![A-Za-z0-9])"), lambda t: ~F.array_contains(F.col("_lost"), F.lower(t)))
    bad = F.arrays_overlap(own, F.col("_lost"))
    return joined.where(~((F.col("kind") == "keyword") & bad)).select("doc", "item", F.when(bad, spaces(F.array_join(kept, ""))).otherwise(F.col("text")).alias("text"))
