"""Tables: HTML and pipe tables to cells, and what is derived from cells."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.arrow import slices

NUMERIC = "^[-+]?[0-9][0-9,. %/:-]*$"


class _Grid(HTMLParser):
    """Rows of (text, colspan, rowspan, header)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self._open = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.rows.append([])
            self._open = False
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            span = {k: v or "" for k, v in attrs}
            number = lambda k: min(1000, max(1, int(span[k]))) if span.get(k, "").isdigit() else 1
            self.rows[-1].append(["", number("colspan"), number("rowspan"), tag == "th"])
            self._open = True
        elif tag == "br" and self._open:
            self.rows[-1][-1][0] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self._open = False

    def handle_data(self, data: str) -> None:
        if self._open:
            self.rows[-1][-1][0] += data


def grid(html: str) -> list[tuple[int, int, str, int, int, bool]]:
    """(row, column, text, rowspan, colspan, header) of each cell, with the logical column after the spans above it."""
    parser = _Grid()
    parser.feed(html)
    parser.close()
    taken: dict[tuple[int, int], None] = {}
    out = []
    for r, row in enumerate(parser.rows):
        c = 0
        for text, colspan, rowspan, header in row:
            while (r, c) in taken:
                c += 1
            out.append((r, c, " ".join(text.split()), rowspan, colspan, header))
            for dr in range(rowspan):
                for dc in range(colspan):
                    taken[r + dr, c + dc] = None
            c += colspan
    return out


def html_cells(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, row, column, text, rowspan, colspan, header) of the tables in column ``html``; null and empty give none."""
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, html):
            at, cells = [], []
            for i, text in enumerate(b.column(html).to_pylist()):
                found = grid(text) if text else []
                at += [i] * len(found)
                cells += found
            columns = list(zip(*cells)) if cells else [[]] * 6
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()))]
            keep = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(keep) for k in keys), *made], names=[*keys, "row", "column", "text", "rowspan", "colspan", "header"])

    return df.select(*keys, html).mapInArrow(parse, f"{types}, row int, column int, text string, rowspan int, colspan int, header boolean")


def pipe_cells(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the pipe-table lines among ``lines``: (keys, reading_order, column, text)."""
    inner = F.regexp_replace(F.trim("line"), "^\\||\\|$", "")
    return (
        lines.where(F.col("line").startswith("|"))
        .select(*keys, "reading_order", F.posexplode(F.split(inner, "\\|")).alias("column", "text"))
        .withColumn("text", F.trim("text"))
    )


def is_numeric(text: Column) -> Column:
    return text.rlike(NUMERIC)


def table_stats(cells: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows, columns, cells, filled cells, characters, share of filled and of numeric cells by table."""
    filled = (F.col("text") != "").cast("int")
    return cells.groupBy(*keys).agg(
        F.countDistinct(row).alias("n_rows"),
        (F.max("column") + 1).cast("bigint").alias("n_columns"),
        F.count("*").alias("n_cells"),
        F.sum(filled).cast("bigint").alias("n_filled"),
        F.sum(F.length("text")).cast("bigint").alias("n_chars"),
        F.round(F.sum(filled) / F.count("*"), 4).alias("fill_ratio"),
        F.round(F.sum(is_numeric(F.col("text")).cast("int")) / F.count("*"), 4).alias("numeric_ratio"),
    )


def header_rows(cells: DataFrame, keys: list[str], row: str) -> DataFrame:
    """(keys, header_row): the first row with at least two filled cells none of which is a number."""
    rows = cells.groupBy(*keys, row).agg(
        F.sum((F.col("text") != "").cast("int")).alias("filled"), F.max(is_numeric(F.col("text")).cast("int")).alias("numeric")
    )
    return rows.where("filled >= 2 and numeric = 0").groupBy(*keys).agg(F.min(row).alias("header_row"))


def forward_fill(cells: DataFrame, keys: list[str], row: str, columns: int = 2) -> DataFrame:
    """``cells`` with ``filled``: in a row whose first cell is empty, the empty ones of the first ``columns`` cells take the last text above them; all others are the text itself."""
    w = Window.partitionBy(*keys, "column").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy(*keys, row)
    own = F.nullif("text", F.lit(""))
    goes_on = F.max(F.when(F.col("column") == 0, F.col("text") == "")).over(first)
    carried = F.last(own, ignorenulls=True).over(w)
    return cells.withColumn("filled", F.when((F.col("column") < columns) & F.coalesce(goes_on, F.lit(True)), F.coalesce(own, carried, F.lit(""))).otherwise(F.col("text")))


def number_repeats(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``name`` with ``(n)`` from its second occurrence on."""
    k = F.row_number().over(Window.partitionBy(*by, name).orderBy(order))
    return df.withColumn("numbered", F.when(k > 1, F.concat(F.col(name), F.lit("("), k.cast("string"), F.lit(")"))).otherwise(F.col(name)))


def to_markdown(cells: DataFrame, keys: list[str], row: str) -> DataFrame:
    """One pipe table as text for each table; bars in cells are escaped."""
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "text"))), lambda c: F.replace(c["text"], F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rows = cells.groupBy(*keys, row).agg(line.alias("line"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row, "line"))), lambda r: r["line"]), "\n").alias("markdown"))


def to_records(cells: DataFrame, keys: list[str], row: str) -> DataFrame:
    """One self-contained line for each data row: ``name: value`` for the filled cells, names from the header row (repeated ones numbered), merged key cells carried down."""
    head = header_rows(cells, keys, row)
    names = cells.join(head, keys).where((F.col(row) == F.col("header_row")) & (F.col("text") != ""))
    names = number_repeats(names, keys, "column", "text").select(*keys, "column", F.col("numbered").alias("name"))
    data = forward_fill(cells.join(head, keys).where(F.col(row) > F.col("header_row")), keys, row)
    # a row that is empty as it stands gives no record
    data = data.withColumn("_any", F.max((F.col("text") != "").cast("int")).over(Window.partitionBy(*keys, row))).where("_any = 1 and filled <> ''")
    named = data.join(names, [*keys, "column"], "left").withColumn("fact", F.concat(F.coalesce("name", F.concat(F.lit("column "), F.col("column") + 1)), F.lit(": "), F.col("filled")))
    return named.groupBy(*keys, row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "fact"))), lambda c: c["fact"]), "; ").alias("record"))
