"""Line blocks of texts: types, headings, sections, offsets, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.arrow import running, slices, split_lines


def blocks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, reading_order, line): one row for each line of ``text``; null has none."""
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("reading_order", "line"))


def placed_blocks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``blocks`` with section_id (the number of headings up to the line), the half-open character range of the line in its
    text (range_start, range_end; a line break counts one), seen (how often the text held the line before), times (how
    often it does in all), table_no (of the pipe table that the line is in or after, 0 before the first), begins (a table
    does here), text (the line is neither blank nor of a table), text_no (how many such lines there are since the last table
    began, itself counted) and above (the last such line before it).

    All of it follows from the text itself, so the lines are numbered where they are read and nothing is shuffled.
    """
    made = (("reading_order", pa.int32()), ("line", pa.string()), ("section_id", pa.int64()), ("range_start", pa.int64()), ("range_end", pa.int64()), ("seen", pa.int64()), ("times", pa.int64()), ("table_no", pa.int64()), ("begins", pa.bool_()), ("text", pa.bool_()), ("text_no", pa.int64()), ("above", pa.string()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            row, lines, order = split_lines(b.column(text))
            size = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
            end = running(size + 1, order) - 1
            heading = pc.match_substring_regex(lines, "^#{1,6} ").to_numpy(zero_copy_only=False)
            table = pc.starts_with(lines, "|").to_numpy(zero_copy_only=False)
            begins = table & ~(np.r_[False, table[:-1]] & (order > 0))
            codes = pc.dictionary_encode(lines).indices.to_numpy(zero_copy_only=False).astype(np.int64)
            same = np.lexsort((order, codes, row))
            first = np.flatnonzero(np.r_[True, (row[same][1:] != row[same][:-1]) | (codes[same][1:] != codes[same][:-1])]) if row.size else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, row.size])
            seen, times = np.zeros(row.size, np.int64), np.zeros(row.size, np.int64)
            seen[same] = np.arange(row.size) - np.repeat(first, count)
            times[same] = np.repeat(count, count)
            # the place of the last line of text before each line, -1 where its text has none
            said = ~table & (pc.utf8_length(pc.utf8_trim(lines, " ")).to_numpy(zero_copy_only=False) > 0)
            last = np.maximum.accumulate(np.where(said, np.arange(row.size), -1)) if row.size else np.zeros(0, np.int64)
            before = np.r_[-1, last[:-1]] if row.size else last
            none = before < np.arange(row.size) - order
            above = lines.take(pa.array(np.where(none, 0, before), mask=none))
            texts = running(said.astype(np.int64), order)
            open_ = np.maximum.accumulate(np.where(begins | (order == 0), np.arange(row.size), 0)) if row.size else row
            since = texts - np.where(begins[open_], texts[open_], 0)
            columns = (order, lines, running(heading.astype(np.int64), order), end - size, end, seen, times, running(begins.astype(np.int64), order), begins, said, since, above)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, made))], names=[*keys, *(n for n, _ in made)])

    types = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean"}
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} {types[t]}" for n, t in made)])
    return df.where(F.col(text).isNotNull()).select(*keys, text).mapInArrow(place, schema)


def block_type(line: Column) -> Column:
    return (
        F.when(F.trim(line) == "", "blank")
        .when(line.rlike("^#{1,6} "), "heading")
        .when(line.startswith("|"), "table")
        .when(line.startswith(">"), "quote")
        .when(line.rlike("^[ ]*(?:[-*•]|[0-9]{1,3}[.)]) "), "list")
        .otherwise("text")
    )


def heading_level(line: Column) -> Column:
    return F.when(line.rlike("^#{1,6} "), F.length(F.regexp_extract(line, "^(#+)", 1)))


def is_ocr_noise_heading(text: Column) -> Column:
    """Digits and separators only, or an account with an at-sign."""
    return text.rlike("^[0-9 :：./-]+$") | text.rlike("@") & text.rlike("[A-Za-z]+\\\\[A-Za-z0-9]+")


def heading_paths(heads: DataFrame, keys: list[str], levels: int = 6) -> DataFrame:
    """``heads`` (keys, seq, level, title) with ``path``: at each level the last heading that no higher one has closed since.

    One window for each level instead of a running stack: a heading of level L is open if no heading above L came after it.
    """
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = heads
    for level in range(1, levels + 1):
        out = out.withColumn(f"_at{level}", F.last(F.when(F.col("level") == level, F.col("seq")), ignorenulls=True).over(w))
        out = out.withColumn(f"_title{level}", F.last(F.when(F.col("level") == level, F.col("title")), ignorenulls=True).over(w))
    parts = []
    for level in range(1, levels + 1):
        higher = F.greatest(*(F.coalesce(f"_at{k}", F.lit(-1)) for k in range(1, level)), F.lit(-1), F.lit(-1)) if level > 1 else F.lit(-1)
        parts.append(F.when((F.col(f"_at{level}") > higher) & (F.col("level") >= level), F.col(f"_title{level}")))
    path = F.array_compact(F.array(*parts))
    return out.withColumn("path", path).drop(*(f"_{k}{n}" for k in ("at", "title") for n in range(1, levels + 1)))


def repeated_lines(lines: DataFrame, key: str, least: int, shortest: int = 4) -> DataFrame:
    """(line, n): trimmed lines of at least ``shortest`` characters that stand in at least ``least`` different ``key`` values."""
    return (
        lines.select(key, F.trim("line").alias("line"))
        .where(F.length("line") >= shortest)
        .distinct()
        .groupBy("line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )


def first_occurrences(placed: DataFrame, least: int, shortest: int = 4) -> DataFrame:
    """Placed blocks without the later occurrences of a line that its text holds at least ``least`` times."""
    return placed.where((F.length(F.trim("line")) < shortest) | (F.col("times") < least) | (F.col("seen") == 0))
