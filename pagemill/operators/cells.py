"""Cells and rows of tables: what a cell is worth, what a row is, and tables as text.

Rows are arrays of cell texts with their table and number; everything but the header reader is an expression or an aggregate over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.arrow import slices
from pagemill.functions.text import compact
from pagemill.operators.tables import grid

# A figure, debris of punctuation, boxes and bullets, short Latin; characters that a bad reading mixes up; openings of a note row; words of a section row.
FIGURE = "^[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.][0-9]+)?%?$"
DEBRIS = ("^[0-9.,:：;；/-]+$", "^[□☐☑✓✔✕✗.。·•、,，:：;；_-]+$", "^[A-Za-z0-9.]{1,2}$")
MIXED_UP = "[圖图隊队阅閱样樣精验驗〇○昇鑑箇]"
GARBLED = "[圖图隊队].{0,8}[验驗]|[验驗].{0,8}[圖图隊队]"
NOTE = "(?i)^[ ]*(?:注[：:]|註[：:]|附註|說明[：:]|資料來源|來源[：:]|notes?[ ]*[:：]|source[ ]*[:：])"
SECTION = "類|項目|包含|管理"
HAN = "[\\x{4E00}-\\x{9FFF}]"


def is_figure(cell: Column) -> Column:
    """A number that says something: at least two characters."""
    x = compact(cell)
    return (F.length(x) >= 2) & x.rlike(FIGURE)


def is_weak(cell: Column) -> Column:
    """Empty, or debris: punctuation, boxes, one character that isn't Han, two Latin ones."""
    x = compact(cell)
    debris = x.rlike(DEBRIS[0]) | x.rlike(DEBRIS[1]) | x.rlike(DEBRIS[2]) | (F.length(x) <= 1) & ~x.rlike(HAN)
    return (x == "") | ~is_figure(cell) & debris


def is_meaningful(cell: Column) -> Column:
    """A figure, two Han or three Latin letters, or four characters with a letter among them."""
    x = compact(cell)
    letters = (F.regexp_count(x, F.lit(HAN)) >= 2) | (F.regexp_count(x, F.lit("[A-Za-z]")) >= 3) | (F.length(x) >= 4) & x.rlike(f"{HAN}|[A-Za-z]")
    return ~is_weak(cell) & (is_figure(cell) | letters)


def is_garbled(cell: Column) -> Column:
    x = compact(cell)
    return (F.regexp_count(x, F.lit(MIXED_UP)) >= 2) & (F.length(x) <= 24) | x.rlike(GARBLED)


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != "")


def is_note_row(cells: Column) -> Column:
    """One filled cell that opens like a note."""
    own = filled(cells)
    return (F.size(own) == 1) & F.coalesce(F.try_element_at(own, F.lit(1)).rlike(NOTE), F.lit(False))


def is_section_row(cells: Column) -> Column:
    """One filled cell of twelve characters or more with a word of a category."""
    own = filled(cells)
    text = F.try_element_at(own, F.lit(1))
    return (F.size(own) == 1) & F.coalesce((F.length(compact(text)) >= 12) & text.rlike(SECTION), F.lit(False))


def is_repeated_header(cells: Column, header: Column) -> Column:
    """As many cells equal to one of the header as it has, at least three of them where it has more."""
    own, head = (F.transform(filled(x), lambda c: compact(c)) for x in (cells, header))
    matches = F.size(F.filter(own, lambda c: F.array_contains(head, c)))
    return (F.size(own) > 0) & (F.size(head) > 0) & (matches >= F.least(F.lit(3), F.size(head)))


def low_confidence(rows: DataFrame, keys: list[str], cells: str) -> DataFrame:
    """(keys, low): tables of eight filled cells or more that are mostly debris: few meaningful cells in a wide table or many weak ones, or garbled cells among many weak ones."""
    own = filled(F.col(cells))
    each = rows.where(F.size(own) > 0).select(*keys, F.size(cells).alias("_width"), F.explode(own).alias("_c"))
    share = lambda f: F.avg(f(F.col("_c")).cast("double"))
    stats = each.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_width").alias("_w"), share(is_weak).alias("_weak"), share(is_meaningful).alias("_good"), F.max(is_garbled(F.col("_c")).cast("int")).alias("_bad"))
    wide = (F.col("_w") >= 5) & (F.col("_good") < 0.35) & (F.col("_weak") >= 0.45)
    weak = (F.col("_weak") >= 0.65) & (F.col("_good") < 0.45)
    return stats.select(*keys, ((F.col("_n") >= 8) & (wide | weak | (F.col("_bad") == 1) & (F.col("_weak") >= 0.45))).alias("low"))


def row_text(rows: DataFrame, keys: list[str], order: str, cells: str, caption: str) -> DataFrame:
    """(keys, text): ``TABLE``, ``COLUMNS`` and ``ROW`` lines; the first row with text names the columns, more than two empty rows in a line become one mark, at the end they go unless they are more than two."""
    w = Window.partitionBy(*keys).orderBy(order)
    line = F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")
    told = rows.withColumn("_empty", F.size(filled(F.col(cells))) == 0).withColumn("_seen", F.sum((~F.col("_empty")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.where("_seen > 0").withColumn("_run", F.sum(F.col("_empty").cast("int")).over(Window.partitionBy(*keys, "_seen")))
    last = F.max(F.when(~F.col("_empty"), F.col(order))).over(Window.partitionBy(*keys))
    told = told.withColumn("_last", last).withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_seen").orderBy(order)) - 1)
    mark = F.concat(F.lit("...("), F.col("_run").cast("string"), F.lit(" empty rows)"))
    shown = (
        F.when(~F.col("_empty") & (F.col("_seen") == 1), F.concat(F.lit("COLUMNS: "), line))
        .when(~F.col("_empty"), F.concat(F.lit("ROW: "), line))
        .when((F.col("_run") > 2) & (F.col("_place") == 1), mark)
        .when((F.col("_run") <= 2) & (F.col(order) < F.col("_last")), F.lit("ROW: (empty)"))
    )
    texts = told.withColumn("_line", shown).where("_line is not null").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_line").alias("l")))), lambda x: x["l"]), "\n").alias("_body"))
    title = rows.groupBy(*keys).agg(F.max(caption).alias("_caption"))
    head = F.rtrim(F.concat(F.lit("TABLE: "), F.coalesce("_caption", F.lit(""))))
    return title.join(texts, keys).select(*keys, F.concat_ws("\n", head, "_body").alias("text"))


def truncated(rows: DataFrame, keys: list[str], order: str, cells: str, head: int = 10, tail: int = 5, marker: str = "... (truncated) ...") -> DataFrame:
    """Large tables shortened: the header, ``head`` rows, a marker row and the last ``tail`` rows; the marker stands at the place of the first row left out."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    short = F.col("_n") <= head + tail + 1
    kept = short | (F.col("_k") <= head + 1) | (F.col("_k") > F.col("_n") - tail)
    marked = F.when(kept, F.col(cells)).when(F.col("_k") == head + 2, F.array(F.lit(marker)))
    return placed.withColumn(cells, marked).where(F.col(cells).isNotNull()).select(*rows.columns)


def to_html(rows: DataFrame, keys: list[str], order: str, cells: str) -> DataFrame:
    """(keys, html): canonical HTML of a grid, markup in cells escaped."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"]), "")
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), joined, F.lit("</table>")).alias("html"))


def grid_text(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): physical cells (row, column, text, rowspan, colspan) with their places, one line for each row; no column is named or lost."""
    label = F.concat(F.lit("Column "), F.col("column").cast("string"), F.when(F.col("colspan") > 1, F.concat(F.lit("-"), (F.col("column") + F.col("colspan") - 1).cast("string"))).otherwise(""), F.when(F.col("rowspan") > 1, F.concat(F.lit(" (spans "), F.col("rowspan").cast("string"), F.lit(" rows)"))).otherwise(""))
    each = cells.where("text <> ''").select(*keys, "row", F.struct("column", F.concat(label, F.lit(": "), F.col("text")).alias("t")).alias("c"))
    lines = each.groupBy(*keys, "row").agg(F.concat(F.lit("- Row "), F.col("row").cast("string"), F.lit(": "), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["t"]), "; ")).alias("_line"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_line"))), lambda x: x["_line"]), "\n").alias("text"))


def fragment_text(rows: DataFrame, keys: list[str], order: str, cells: str) -> DataFrame:
    """(keys, text): a table without a header as notes, a line for each row with text; narrow tables of four rows or more as plain entries."""
    own = rows.withColumn("_c", filled(F.col(cells))).where("size(_c) > 0")
    w = Window.partitionBy(*keys)
    numbered = own.withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("_plain", (F.max(F.size("_c")).over(w) <= 2) & (F.count("*").over(w) >= 4))
    line = F.concat(F.when(F.col("_plain"), F.lit("- ")).otherwise(F.concat(F.lit("- Row "), F.col("_k").cast("string"), F.lit(": "))), F.array_join("_c", " | "))
    return numbered.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_k"), line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def readable_text(rows: DataFrame, keys: list[str], order: str, cells: str, most: int = 12) -> DataFrame:
    """(keys, text): of a noisy table only its meaningful cells, each line once, the first ``most`` lines (the report's length)."""
    good = F.filter(cells, lambda c: is_meaningful(c) & ~is_garbled(c))
    lines = rows.withColumn("_c", good).where("size(_c) > 0").withColumn("_line", F.array_join("_c", " | ")).withColumn("_form", F.lower(compact("_line")))
    first = lines.groupBy(*keys, "_form").agg(F.min_by("_line", order).alias("_line"), F.min(order).alias("_o"))
    ranked = first.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))).where(F.col("_k") <= most)
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_line"))), lambda x: F.concat(F.lit("- "), x["_line"])), "\n").alias("text"))


def gate(stats: DataFrame, least: int = 4, most: int = 200, ratio: float = 0.3, chars: float = 2.0) -> Column:
    """Why a table (n_rows, n_columns, n_cells, n_filled, n_chars) isn't processed as it is: no body, a layout, too small; or that it is shortened; else accepted."""
    layout = (F.col("n_rows") <= 1) | (F.col("n_columns") <= 1) | (F.col("n_filled") / F.col("n_cells") < ratio) | (F.col("n_chars") / F.col("n_cells") < chars)
    return F.when(F.coalesce("n_cells", F.lit(0)) == 0, "no_table_body").when(layout, "layout_table").when(F.col("n_cells") < least, "too_small").when(F.col("n_cells") > most, "truncate").otherwise("accept")


def title(caption: Column, nearby: Column, document: Column, index: Column) -> Column:
    """The caption, else the nearby one, else the document's title with the table's number; placeholders count as none."""
    generic = "(?i)^[ ]*(?:table|figure|表格?|圖表?|untitled|無標題)?[ .:#_-]*[0-9]*[ ]*$"
    real = lambda c: F.when(~c.rlike(generic), F.trim(c))
    return F.coalesce(real(caption), real(nearby), F.concat(F.trim(document), F.lit(" #"), index.cast("string")), F.concat(F.lit("#"), index.cast("string")))


def headers(html: str, deepest: int = 3, longest: int = 40) -> tuple[int, list[str]]:
    """(rows of the header, column names) of a table: more than one row only where the first has a colspan and a rowspan, no long label, and each further row fills exactly what the cells above leave open.

    The names of a column are joined with a dash, each once; repeated names are numbered; the width is that of the first row.
    """
    cells = grid(html)
    if not cells:
        return 0, []
    top = [c for c in cells if c[0] == 0]
    width = sum(c[4] for c in top)
    depth = 1
    if any(c[4] > 1 for c in top) and (most := max(c[3] for c in top)) > 1 and all(len(c[2]) <= longest for c in top):
        depth = min(most, deepest)
        for k in range(1, depth):
            carried = sum(c[4] for c in top if c[3] > k)
            own = [c for c in cells if c[0] == k]
            if not own or sum(c[4] for c in own) + carried != width:
                depth = 1
                break
    names: list[str] = []
    for column in range(width):
        parts = dict.fromkeys(c[2] for c in cells if c[0] < depth and c[1] <= column < c[1] + c[4] and c[2])
        names.append("－".join(parts))
    met: dict[str, int] = {}
    for k, name in enumerate(names):
        if name:
            met[name] = met.get(name, 0) + 1
            names[k] = name if met[name] == 1 else f"{name}({met[name]})"
    return depth, names


def expanded(html: str) -> list[list[str]]:
    """The logical grid: a cell that spans rows stands in each of them, one that spans columns in the first; the others are empty."""
    cells = grid(html)
    height = max((c[0] for c in cells), default=-1) + 1
    width = max((c[1] + c[4] for c in cells), default=0)
    out = [[""] * width for _ in range(height)]
    for row, column, text, rowspan, *_ in cells:
        for k in range(row, min(height, row + rowspan)):
            out[k][column] = text
    return out


def folded(html: str) -> str:
    """HTML with more than two empty rows in a line replaced by a comment."""
    import re

    parts = re.split(r"(<tr[^>]*>.*?</tr>)", html, flags=re.S | re.I)
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        out.extend([f"<!-- {len(run)} empty rows -->"] if len(run) > 2 else run)
        run.clear()

    for k, part in enumerate(parts):
        if k % 2 and not re.sub(r"<[^>]*>|&nbsp;|\s", "", part):
            run.append(part)
        elif part.strip() or not run:
            close()
            out.append(part)
    close()
    return "".join(out)


def read_tables(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, header_rows, names, rows, folded): of each table in ``html`` its header, logical grid and folded form; null and empty give an empty grid."""
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, html):
            texts = [x or "" for x in b.column(html).to_pylist()]
            heads = [headers(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), pa.array([n for n, _ in heads], pa.int32()), pa.array([names for _, names in heads], pa.list_(pa.string())), pa.array([expanded(x) for x in texts], pa.list_(pa.list_(pa.string()))), pa.array([folded(x) for x in texts], pa.string())],
                names=[*keys, "header_rows", "names", "rows", "folded"],
            )

    return df.select(*keys, html).mapInArrow(read, f"{types}, header_rows int, names array<string>, rows array<array<string>>, folded string")


# Marks and words of a form that is to be filled in, and units of amounts.
FILL_IN = "[□☐☑☒]|_{3,}|＿{3,}|-{5,}|[：:][ ]*(?:年[ ]*月[ ]*日|[ ]{3,})|申請人|申請單位|填寫|填表|請勾選|簽名|簽章|簽核欄"
AMOUNT = "[0-9]|元|美元|USD|%"


def is_reference(rows: DataFrame, keys: list[str], cells: str) -> DataFrame:
    """(keys, reference): dense tables of data: three rows and columns or more, nothing to fill in, a header among the first rows (three filled cells), three rows with two filled cells, filled to 0.45 or three rows of three, and figures or four such rows."""
    own = rows.withColumn("_n", F.size(filled(F.col(cells)))).withColumn("_w", F.size(cells)).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("row")))
    text = F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " ")
    count = lambda c: F.sum(c.cast("int"))
    figures = lambda p: F.size(F.filter(cells, lambda c: F.coalesce(c.rlike(p), F.lit(False))))
    s = own.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("_w").alias("w"), F.sum("_n").alias("cells"), count(F.col("_n") >= 2).alias("data"), count((F.col("_w") >= 3) & (F.col("_n") >= 3)).alias("shaped"), F.sum(figures("[0-9]")).alias("numeric"), F.sum(figures(AMOUNT)).alias("amounts"),
        F.max((F.col("_k") <= 3).cast("int") * (F.col("_n") >= 3).cast("int")).alias("header"), F.max(text.rlike(FILL_IN).cast("int")).alias("fill"),
    )
    dense = (F.col("cells") / (F.col("n") * F.col("w")) >= 0.45) | (F.col("shaped") >= 3)
    told = (F.col("amounts") >= 2) | (F.col("numeric") >= 3) | (F.col("shaped") >= 4)
    return s.select(*keys, ((F.col("n") >= 3) & (F.col("w") >= 3) & (F.col("fill") == 0) & (F.col("data") >= 3) & (F.col("header") == 1) & dense & told).alias("reference"))


def is_form_like(rows: DataFrame, keys: list[str], cells: str, terms: tuple[str, ...]) -> DataFrame:
    """(keys, form): tables of five rows or more that hold four of ``terms`` and either are filled to less than 0.45 or have marks to fill in; tables of data are none."""
    text = F.array_join(F.flatten(F.array_sort(F.collect_list(F.struct("row", F.transform(cells, lambda c: F.coalesce(c, F.lit(""))).alias("c"))))["c"]), " ")
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.size(filled(F.col(cells)))).alias("cells"), F.sum(F.size(cells)).alias("all"), text.alias("text"))
    hits = sum((F.contains("text", F.lit(t)).cast("int") for t in terms), F.lit(0))
    form = (F.col("n") >= 5) & (hits >= 4) & ((F.col("cells") / F.col("all") < 0.45) | F.col("text").rlike("[□☐☑]|_{3,}| [年月日] "))
    return s.select(*keys, form.alias("form")).join(is_reference(rows, keys, cells), keys).select(*keys, (F.col("form") & ~F.col("reference")).alias("form"))
