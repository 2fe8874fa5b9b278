"""Blocks on pages: the delivery filter, margins and repeats, supplements in reading order, coverage of fragments, scanned pages.

A block is a row (doc, page_idx, reading_order, type, text, x0, y0, x1, y1, origin), with coordinates from 0 to 1000; ``origin`` tells what
took a block out of the content (``page_furniture``, ``promotional_insert``) or marks it (``merged_table_remnant``), null for content.
Blocks of a document meet by (doc, text) or (doc, page): no document is gathered whole, and pages are never joined with themselves whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import compact

# The head and foot strip of a page, the longest running line and the least pages it repeats on.
TOP, BOTTOM, LONGEST, PAGES = 140, 900, 40, 2
#: Pages on which a text stands to be a repeat, and the characters below which none is.
REPEATS, SHORTEST = 3, 4
_NUMBER = "^[-–—]?[0-9]{1,4}[-–—]?$"
FURNITURE, INSERT, REMNANT = "page_furniture", "promotional_insert", "merged_table_remnant"


def is_furniture(origin: Column | str = "origin") -> Column:
    return _is(origin, FURNITURE)


def is_insert(origin: Column | str = "origin") -> Column:
    return _is(origin, INSERT)


def is_remnant(origin: Column | str = "origin") -> Column:
    return _is(origin, REMNANT)


def is_non_content(origin: Column | str = "origin") -> Column:
    """The one filter of everything that is delivered."""
    return is_furniture(origin) | is_insert(origin)


def _is(origin: Column | str, value: str) -> Column:
    return F.coalesce((F.col(origin) if isinstance(origin, str) else origin) == value, F.lit(False))


def in_margin() -> Column:
    """Whether a block lies in the head or foot strip; false without a box."""
    return F.coalesce((F.col("y1") <= TOP) | (F.col("y0") >= BOTTOM), F.lit(False))


def pages_by_text(blocks: DataFrame) -> DataFrame:
    """(doc, form, n_pages): distinct pages of each text, white space aside."""
    return blocks.where("type = 'text'").select("doc", compact("text").alias("form"), "page_idx").where("form <> ''").groupBy("doc", "form").agg(F.countDistinct("page_idx").alias("n_pages"))


def release_single_furniture(blocks: DataFrame) -> DataFrame:
    """Furniture whose text stands on one page only becomes content again, page numbers excepted."""
    form = blocks.withColumn("form", compact("text"))
    counted = form.join(pages_by_text(blocks), ["doc", "form"], "left")
    single = is_furniture() & (F.col("form") != "") & ~F.col("form").rlike(_NUMBER) & (F.coalesce("n_pages", F.lit(0)) < PAGES)
    return counted.withColumn("origin", F.when(single, F.lit(None)).otherwise(F.col("origin"))).select(*blocks.columns)


def tag_furniture(blocks: DataFrame) -> DataFrame:
    """Short texts in the margin that repeat on two pages or more, and numbers there if two pages or more have one, become page furniture."""
    form = blocks.withColumn("form", compact("text"))
    short = (F.col("type") == "text") & ~is_furniture() & in_margin() & F.length("form").between(1, LONGEST)
    found = form.where(short)
    repeats = found.groupBy("doc", "form").agg(F.countDistinct("page_idx").alias("_pages")).where(F.col("_pages") >= PAGES).select("doc", "form", F.lit(True).alias("_repeats"))
    numbers = found.where(F.col("form").rlike(_NUMBER)).groupBy("doc").agg(F.countDistinct("page_idx").alias("_pages")).where(F.col("_pages") >= PAGES).select("doc", F.lit(True).alias("_numbered"))
    joined = form.join(repeats, ["doc", "form"], "left").join(numbers, "doc", "left")
    running = F.coalesce("_repeats", F.lit(False)) | F.coalesce("_numbered", F.lit(False)) & F.col("form").rlike(_NUMBER)
    return joined.withColumn("origin", F.when(short & running, F.lit(FURNITURE)).otherwise(F.col("origin"))).select(*blocks.columns)


def drop_repeats(blocks: DataFrame) -> DataFrame:
    """Without the later occurrences of a text that stands on three pages or more; texts under four characters are exempt."""
    form = blocks.withColumn("form", F.regexp_replace(F.trim("text"), "[ \\n]", ""))
    seen = form.where(F.length("form") >= SHORTEST).groupBy("doc", "form").agg(F.countDistinct("page_idx").alias("_pages"), F.min("reading_order").alias("_first"))
    later = (F.col("_pages") >= REPEATS) & (F.col("reading_order") > F.col("_first"))
    return form.join(seen.where(F.col("_pages") >= REPEATS), ["doc", "form"], "left").where(~F.coalesce(later, F.lit(False))).select(*blocks.columns)


def place_supplements(blocks: DataFrame, supplements: DataFrame) -> DataFrame:
    """(doc, reading_order, block_id): blocks in their order, each supplement after the last block of its page, in *their* order, whose top isn't below its own, or before all of the page.

    Columns thread through a page, so the order of blocks isn't that of their tops: a supplement's anchor is the greatest order
    among the blocks that start at or above it.
    """
    pairs = supplements.select("doc", "page_idx", F.col("block_id").alias("_id"), F.col("y0").alias("_top")).join(blocks.select("doc", "page_idx", "reading_order", "y0"), ["doc", "page_idx"], "left")
    anchor = pairs.groupBy("doc", "page_idx", "_id", "_top").agg(F.max(F.when(F.col("y0") <= F.col("_top"), F.col("reading_order"))).alias("_anchor"))
    own = blocks.select("doc", "page_idx", "block_id", F.col("reading_order").alias("_anchor"), F.lit(0).alias("_after"), F.lit(0).alias("_top"))
    more = anchor.select("doc", "page_idx", F.col("_id").alias("block_id"), F.coalesce("_anchor", F.lit(-1)).alias("_anchor"), F.lit(1).alias("_after"), "_top")
    order = F.row_number().over(Window.partitionBy("doc").orderBy("page_idx", "_anchor", "_after", "_top", "block_id")) - 1
    return own.unionByName(more).select("doc", order.alias("reading_order"), "block_id")


def uncovered(fragments: DataFrame, blocks: DataFrame, radius: int = 1, inside: float = 0.9, share: float = 0.6) -> DataFrame:
    """Fragments (doc, page_idx, fragment_id, text, x0 .. y1) that no block carries: none within ``radius`` pages holds the text or, from ten characters on, more than
    ``share`` of its 4-grams, and none of its own page holds ``inside`` of its box. Fragments under four characters count as carried.

    A fragment asks for its own and its neighbouring pages, so the band of pages is an equi-join.
    """
    form = lambda c: F.regexp_replace(c, "[ \\t\\n\\r\\f\\x0B\\x{A0}\\x{3000}\\\\]+", "")
    own = fragments.withColumn("_form", form("text")).where(F.length("_form") >= 4)
    asked = own.select("doc", "fragment_id", "_form", F.col("page_idx").alias("_page"), F.struct("x0", "y0", "x1", "y1").alias("_a"), F.explode(F.sequence(F.col("page_idx") - radius, F.col("page_idx") + radius)).alias("page_idx"))
    met = asked.join(blocks.select("doc", "page_idx", form("text").alias("_text"), F.struct("x0", "y0", "x1", "y1").alias("_b")), ["doc", "page_idx"])
    side = lambda low, high: F.greatest(F.lit(0), F.least(F.col(f"_a.{high}"), F.col(f"_b.{high}")) - F.greatest(F.col(f"_a.{low}"), F.col(f"_b.{low}")))
    area = (F.col("_a.x1") - F.col("_a.x0")) * (F.col("_a.y1") - F.col("_a.y0"))
    boxed = (F.col("page_idx") == F.col("_page")) & (F.coalesce(F.try_divide((side("x0", "x1") * side("y0", "y1")).cast("double"), area), F.lit(0.0)) >= inside)
    grams = F.transform(F.sequence(F.lit(1), F.length("_form") - 3), lambda i: F.substring("_form", i, F.lit(4)))
    hits = F.size(F.filter(grams, lambda g: F.contains(F.col("_text"), g)))
    carried = boxed | F.contains("_text", F.col("_form")) | (F.length("_form") >= 10) & (hits / F.size(grams) > share)
    return own.join(met.where(carried).select("doc", "fragment_id").distinct(), ["doc", "fragment_id"], "left_anti").select(*fragments.columns)


def scanned_pages(pages: DataFrame, blocks: DataFrame, most: int = 200, cover: float = 0.85) -> DataFrame:
    """(doc, page_idx, scanned): pages whose file holds under 8 characters of text although there are blocks, or that have an image and either under ``most`` characters elsewhere or one image on ``cover`` of the page."""
    image = F.col("type") == "image"
    area = F.greatest(F.lit(0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0), F.col("y1") - F.col("y0")) / 1e6
    stats = blocks.groupBy("doc", "page_idx").agg(
        F.count("*").alias("_n"), F.sum(image.cast("int")).alias("_images"), F.sum(F.when(~image, F.length(F.trim(F.coalesce("text", F.lit("")))))).alias("_chars"), F.max(F.when(image, area)).alias("_area")
    )
    seen = pages.join(stats, ["doc", "page_idx"], "left")
    drawn = (F.coalesce("_images", F.lit(0)) > 0) & ((F.coalesce("_chars", F.lit(0)) < most) | (F.coalesce("_area", F.lit(0.0)) >= cover))
    return seen.select("doc", "page_idx", F.when(F.col("source_text_chars") < 8, F.col("_n").isNotNull()).otherwise(drawn).alias("scanned"))


def text_share(blocks: DataFrame) -> DataFrame:
    """(doc, page_idx, n_blocks, share, n_chars): the share of text blocks on each page and the length of their texts."""
    text = F.col("type") == "text"
    return blocks.groupBy("doc", "page_idx").agg(F.count("*").alias("n_blocks"), F.round(F.avg(text.cast("double")), 4).alias("share"), F.coalesce(F.sum(F.when(text, F.length("text"))), F.lit(0)).alias("n_chars"))


def nearest_labels(figures: DataFrame, labels: DataFrame, reach: int = 100) -> DataFrame:
    """(doc, figure_id, label_id): the label of the same page that is the nearest to a figure, by the gap between their boxes, within ``reach``; ties go to the lower id.

    Figures and labels meet in strips of the page of the height of the reach, so that a crowded page isn't joined with itself whole.
    """
    strip = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach)))
    a = figures.select("doc", "page_idx", F.col("block_id").alias("figure_id"), F.struct("x0", "y0", "x1", "y1").alias("a"), strip(F.col("y0") - reach, F.col("y1") + reach).alias("_strip"))
    b = labels.select("doc", "page_idx", F.col("block_id").alias("label_id"), F.struct("x0", "y0", "x1", "y1").alias("b"), strip(F.col("y0"), F.col("y1")).alias("_strip"))
    gap = lambda low, high: F.greatest(F.lit(0), F.col(f"b.{low}") - F.col(f"a.{high}"), F.col(f"a.{low}") - F.col(f"b.{high}"))
    met = a.join(b, ["doc", "page_idx", "_strip"]).withColumn("_gap", F.greatest(gap("x0", "x1"), gap("y0", "y1"))).where(F.col("_gap") <= reach)
    return met.groupBy("doc", "figure_id").agg(F.min_by("label_id", F.struct("_gap", "label_id")).alias("label_id"))


def missing_runs(lines: DataFrame, texts: DataFrame, shortest: int = 6) -> DataFrame:
    """(doc, page_idx, first, last, n, text): runs of neighbouring lines that no text of their page holds, by letters and digits only; a line too short to be looked for only goes on with a run.

    The page's texts come as one array to its lines; runs are islands of the lines that are told.
    """
    form = lambda c: F.regexp_replace(c, "[^\\p{L}\\p{N}]+", "")
    there = texts.groupBy("doc", "page_idx").agg(F.collect_set(form("text")).alias("_texts"))
    told = lines.withColumn("_form", form("text")).join(there, ["doc", "page_idx"], "left")
    long = F.length("_form") >= shortest
    lost = told.withColumn("_kind", F.when(~long, "short").when(F.exists(F.coalesce("_texts", F.array().cast("array<string>")), lambda t: F.contains(t, F.col("_form"))), "held").otherwise("lost"))
    w = Window.partitionBy("doc", "page_idx").orderBy("line_no")
    island = lost.withColumn("_island", F.sum((F.col("_kind") == "held").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # short lines before the first lost one of an island belong to no run
    began = F.max((F.col("_kind") == "lost").cast("int")).over(Window.partitionBy("doc", "page_idx", "_island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    run = island.withColumn("_began", began).where("_began = 1 and _kind <> 'held'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    return run.groupBy("doc", "page_idx", "_island").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("n"), text.alias("text")).drop("_island")


def promotional(blocks: DataFrame, families: dict[str, str], column: int = 500, signals: int = 2, least: int = 4) -> DataFrame:
    """``blocks`` with the right column of a document's last page tagged as an insert, if it has ``least`` blocks and the texts there hit ``signals`` different families of patterns."""
    last = blocks.groupBy("doc").agg(F.max("page_idx").alias("_last"))
    placed = blocks.join(last, "doc")
    aside = (F.col("page_idx") == F.col("_last")) & (F.col("x0") >= column)
    hit = sum((F.max(F.col("text").rlike(p).cast("int")) for p in families.values()), F.lit(0))
    found = placed.where(aside).groupBy("doc").agg(F.count("*").alias("_n"), hit.alias("_signals")).where((F.col("_n") >= least) & (F.col("_signals") >= signals)).select("doc", F.lit(True).alias("_promo"))
    tagged = placed.join(found, "doc", "left")
    return tagged.withColumn("origin", F.when(aside & F.coalesce("_promo", F.lit(False)), F.lit(INSERT)).otherwise(F.col("origin"))).select(*blocks.columns)


def normalised_box(box: str, width: str, height: str) -> Column:
    """A declared box (four numbers, or a polygon of eight) in thousandths of its page (array of four ints); null where it is malformed, outside the page or empty."""
    b, w, h = F.col(box), F.col(width).cast("double"), F.col(height).cast("double")
    at = lambda i: F.try_element_at(b, F.lit(i)).cast("double")
    even, odd = [at(i) for i in (1, 3, 5, 7)], [at(i) for i in (2, 4, 6, 8)]
    corners = [F.when(F.size(b) == 8, f(*side)).when(F.size(b) == 4, at(k)) for k, (f, side) in enumerate(((F.least, even), (F.least, odd), (F.greatest, even), (F.greatest, odd)), 1)]
    valid = (w > 0) & (h > 0) & (corners[0] >= 0) & (corners[0] < corners[2]) & (corners[2] <= w) & (corners[1] >= 0) & (corners[1] < corners[3]) & (corners[3] <= h)
    scaled = [F.bround(c * 1000 / (w if k % 2 == 0 else h)).cast("int") for k, c in enumerate(corners)]
    return F.when(valid & (scaled[0] < scaled[2]) & (scaled[1] < scaled[3]), F.array(*scaled))


def excerpts(lines: DataFrame, keys: list[str], order: str, source: str, text: str) -> DataFrame:
    """(keys, first, last, source, text): neighbouring lines of one source as one excerpt; nothing is taken twice or left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce(~F.col(source).eqNullSafe(F.lag(source).over(w)), F.lit(True)) | F.lag(order).over(w).isNull()
    numbered = lines.withColumn("_part", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return numbered.groupBy(*keys, "_part").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(source).alias("source"), joined.alias("text")).drop("_part")


def digest(rows: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """(keys, digest): a hash of the fields of a key's rows in their order, which doesn't change when orders are renumbered."""
    item = F.struct(F.col(order).alias("o"), F.to_json(F.struct(*fields)).alias("j"))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]), "\n"), 256).alias("digest"))


def in_tables(fragments: DataFrame, tables: DataFrame, shortest: int = 6, large: int = 100, share: float = 0.6, borrowed: float = 0.95) -> DataFrame:
    """(doc, fragment_id): fragments that a table of their own or a neighbouring page holds.

    A table (doc, page_idx, body, notes) holds what stands in its text without tags, or in its notes, white space aside, from
    ``shortest`` characters on; and from ``large`` characters on what shares more than ``share`` of its 4-grams with text and notes, of which the notes may
    give more than the text only if nearly all (``borrowed``) are there.
    """
    form = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", ""), "[ \\t\\n\\r\\f\\x0B\\x{A0}\\x{3000}\\\\]+", "")
    own = fragments.select("doc", "fragment_id", form(F.col("text")).alias("_f"), F.explode(F.sequence(F.col("page_idx") - 1, F.col("page_idx") + 1)).alias("page_idx")).where(F.length("_f") >= shortest)
    met = own.join(tables.select("doc", "page_idx", form(F.col("body")).alias("_b"), form(F.col("notes")).alias("_n")), ["doc", "page_idx"])
    grams = F.transform(F.sequence(F.lit(1), F.length("_f") - 3), lambda i: F.substring("_f", i, F.lit(4)))
    text = F.size(F.filter(grams, lambda g: F.contains(F.col("_b"), g)))
    more = F.size(F.filter(grams, lambda g: ~F.contains(F.col("_b"), g) & F.contains(F.col("_n"), g)))
    ratio = (text + more) / F.size(grams)
    likeness = (F.length("_f") >= large) & (ratio > share) & ((text >= more) | (ratio >= borrowed))
    return met.where(F.contains("_b", F.col("_f")) | F.contains("_n", F.col("_f")) | likeness).select("doc", "fragment_id").distinct()


NOTE_START = "^(?:備註|备注|註[:：]|[一二三四五六七八九十]+、|[0-9]+[.、])"


def table_notes(blocks: DataFrame, most: int = 40) -> DataFrame:
    """(doc, block_id, note): the notes after each table up to the next one: the first ``most`` text blocks, from the first that opens like a note on; a block that doesn't goes on with the note before it, and equal notes of a document count for the first table."""
    w = Window.partitionBy("doc").orderBy("reading_order")
    is_table = F.col("type") == "table"
    numbered = blocks.withColumn("_t", F.sum(is_table.cast("int")).over(w)).withColumn("_id", F.last(F.when(is_table, F.col("block_id")), ignorenulls=True).over(w))
    texts = numbered.where((F.col("type") == "text") & (F.col("_t") > 0) & ~is_non_content()).withColumn("_line", F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\x{3000}]+", " ")))
    own = Window.partitionBy("doc", "_t").orderBy("reading_order")
    placed = texts.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= most).where("_line <> ''")
    begun = placed.withColumn("_note", F.sum(F.col("_line").rlike(NOTE_START).cast("int")).over(own)).where("_note > 0")
    joined = begun.groupBy("doc", "_t", "_id", "_note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "_line"))), lambda x: x["_line"]), " ").alias("_text"))
    notes = joined.groupBy("doc", "_t", F.col("_id").alias("block_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_note", "_text"))), lambda x: x["_text"]), "\n").alias("note"))
    first = Window.partitionBy("doc", compact("note")).orderBy("_t")
    return notes.withColumn("_first", F.row_number().over(first)).where("_first = 1").select("doc", "block_id", "note")
