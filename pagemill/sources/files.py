"""File sources: tolerant JSON lines, layout item lists, sheets, word documents and web pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.text import html_main, html_title, html_to_markdown, plain_text

SUPPORTED = ("pdf", "docx", "doc", "xlsx", "xls", "html", "htm", "png", "jpg", "jpeg", "txt", "md")
ITEM = "type string, text string, text_level int, bbox array<int>, page_idx int, img_path string, img_caption array<string>, table_body string, table_caption array<string>, code_body string, list_items array<string>, latex string"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that isn't JSON becomes a row with the line in ``_read_error``, blank lines are skipped."""
    return spark.read.schema(f"{schema}, _read_error string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_read_error")


def read_content_list(spark: SparkSession, path: str) -> DataFrame:
    """Layout items (a JSON array in each file) in reading order, with the block type and heading level."""
    items = spark.read.schema(ITEM).json(path, multiLine=True).withColumn("source", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    order = F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1
    kind = (
        F.when(F.col("type").isin("code", "list"), "text")
        .when(F.col("type") == "chart", "image")
        .when((F.col("type") == "table") & F.col("table_body").isNull(), F.when(F.col("img_path").isNotNull(), "image").otherwise("unknown"))
        .otherwise(F.col("type"))
    )
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("code_body"), F.array_join("list_items", "\n"), F.col("latex"))
    return items.withColumn("reading_order", order).withColumn("block_type", kind).withColumn("block_text", text).withColumn("heading_level", F.when(F.col("text_level") > 0, F.col("text_level"))).drop("at")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, sha256, doc_id, content) of the supported files of a folder; equal bytes have equal ids."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    sha = F.sha2("content", 256)
    return files.where(ext.isin(*SUPPORTED)).select("path", ext.alias("ext"), sha.alias("sha256"), F.substring(sha, 1, 16).alias("doc_id"), "content")


def _cell_at(ref: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference like ``B3``."""
    m = re.fullmatch(r"([A-Z]*)(\d*)", ref or "")
    column = 0
    for letter in m[1] if m else "":
        column = column * 26 + ord(letter) - 64
    return (int(m[2]) if m and m[2] else 0) - 1, column - 1


def format_cell(text: str) -> str:
    """A stored cell value as text: whole floats without their fraction, spaces at the ends gone."""
    return text.split(".")[0] if re.fullmatch(r"-?\d+\.0+", text) else text.strip()


def header_row(rows: list[list[str]]) -> int:
    """The first of the ten leading rows with two filled cells, else 0."""
    return next((k for k, r in enumerate(rows[:10]) if sum(map(bool, r)) >= 2), 0)


def _sheet_rows(data: bytes) -> Iterator[tuple[int, str, list[list[str]]]]:
    """(number, title, rows) of the sheets in the workbook's order: titles and files meet by the workbook's relationships.

    Cells that a merge covers are blank but for its first; empty rows and empty ends are dropped, all rows padded to one width.
    """
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{_SHEET}t")))
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target") or ""
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    for n, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")):
        name = targets.get(sheet.get(_RELATION), f"xl/worksheets/sheet{n + 1}.xml")
        if name not in names:
            continue
        root = ElementTree.fromstring(book.read(name))
        covered = set()
        for merge in root.iter(f"{_SHEET}mergeCell"):
            first, _, last = (merge.get("ref") or "").partition(":")
            (r0, c0), (r1, c1) = _cell_at(first), _cell_at(last or first)
            covered |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - {(r0, c0)}
        rows: list[list[str]] = []
        for k, row in enumerate(root.iter(f"{_SHEET}row")):
            at = int(row.get("r") or k + 1) - 1
            cells: list[str] = []
            for c in row.iter(f"{_SHEET}c"):
                column = _cell_at(c.get("r"))[1] if c.get("r") else len(cells)
                value = c.find(f"{_SHEET}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                else:
                    text = (value.text or "") if value is not None else ""
                    text = shared[int(text)] if c.get("t") == "s" and text else format_cell(text)
                cells += [""] * (column - len(cells))
                cells.append("" if (at, column) in covered else text.strip())
            while cells and not cells[-1]:
                cells.pop()
            if cells:
                rows.append(cells)
        width = max(map(len, rows), default=0)
        yield n, sheet.get("name") or name, [r + [""] * (width - len(r)) for r in rows]


def _sheet_items(data: bytes) -> Iterator[tuple[int, str, int, str]]:
    """(page_idx, type, text_level, text): for each sheet its title as a heading and its rows as one HTML table, the header row in ``th``."""
    for n, title, rows in _sheet_rows(data):
        yield n, "text", 1, title
        if rows:
            head = header_row(rows)
            lines = ["<tr>" + "".join(f"<{tag}>{escape(x)}</{tag}>" for x in r) + "</tr>" for k, r in enumerate(rows) for tag in ["th" if k == head else "td"]]
            yield n, "table", 0, "<table>" + "".join(lines) + "</table>"


def _word_text(node: ElementTree.Element) -> str:
    """Text as it reads when revisions are accepted: insertions stay, deletions go; a note leaves ``[^id]``."""
    out: list[str] = []
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag in (f"{_WORD}del", f"{_WORD}moveFrom", f"{_WORD}tbl"):
            continue
        if x.tag == f"{_WORD}t":
            out.append(x.text or "")
        elif x.tag in (f"{_WORD}br", f"{_WORD}tab"):
            out.append(" ")
        elif x.tag in (f"{_WORD}footnoteReference", f"{_WORD}endnoteReference"):
            out.append(f"[^{x.get(f'{_WORD}id')}]")
        stack.extend(reversed(list(x)))
    return "".join(out).strip()


class _Numbering:
    """Labels of automatic lists: one counter for each abstract list and level, deeper levels restart, a list instance's own start counts when it first appears."""

    def __init__(self, root: ElementTree.Element | None):
        self.levels: dict[str, dict[int, tuple[int, str, str]]] = {}
        self.lists: dict[str, tuple[str, dict[int, int]]] = {}
        self.counters: dict[str, dict[int, int]] = {}
        self.met: set[str] = set()
        value = lambda node, tag, default: (x.get(f"{_WORD}val") if (x := node.find(f"{_WORD}{tag}")) is not None else None) or default
        for a in root.iter(f"{_WORD}abstractNum") if root is not None else ():
            self.levels[a.get(f"{_WORD}abstractNumId")] = {int(x.get(f"{_WORD}ilvl")): (int(value(x, "start", "1")), value(x, "numFmt", "decimal"), value(x, "lvlText", "")) for x in a.iter(f"{_WORD}lvl")}
        for n in root.iter(f"{_WORD}num") if root is not None else ():
            starts = {int(o.get(f"{_WORD}ilvl")): int(value(o, "startOverride", "1")) for o in n.iter(f"{_WORD}lvlOverride") if o.find(f"{_WORD}startOverride") is not None}
            self.lists[n.get(f"{_WORD}numId")] = (value(n, "abstractNumId", ""), starts)

    def label(self, paragraph: ElementTree.Element) -> str:
        of = paragraph.find(f"{_WORD}pPr/{_WORD}numPr")
        number = of.find(f"{_WORD}numId") if of is not None else None
        instance = number.get(f"{_WORD}val") if number is not None else None
        if instance not in self.lists:
            return ""
        depth = of.find(f"{_WORD}ilvl")
        depth = int(depth.get(f"{_WORD}val") or 0) if depth is not None else 0
        abstract, starts = self.lists[instance]
        levels = self.levels.get(abstract, {})
        if depth not in levels:
            return ""
        counts = self.counters.setdefault(abstract, {})
        if instance not in self.met:
            self.met.add(instance)
            for k, start in starts.items():
                counts[k] = start - 1
        counts[depth] = counts.get(depth, levels[depth][0] - 1) + 1
        for k in [k for k in counts if k > depth]:
            del counts[k]
        kind, text = levels[depth][1:]
        if kind == "bullet":
            return "•"
        return re.sub(r"%(\d)", lambda m: _counted(counts.get(int(m[1]) - 1, levels.get(int(m[1]) - 1, (1, "", ""))[0]), levels.get(int(m[1]) - 1, (1, "decimal", ""))[1]), text)


def _counted(n: int, kind: str) -> str:
    """A number in the form of a list level."""
    if kind in ("lowerLetter", "upperLetter"):
        x = chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)
    elif kind in ("lowerRoman", "upperRoman"):
        x = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            x, n = x + sign * (n // value), n % value
    elif kind in ("taiwaneseCountingThousand", "chineseCounting", "japaneseCounting", "ideographDigital"):
        ones = "〇一二三四五六七八九"
        x = str(n) if n > 99 else ones[n] if n < 10 else (ones[n // 10] if n >= 20 else "") + "十" + (ones[n % 10] if n % 10 else "")
    else:
        x = str(n)
    return x.upper() if kind.startswith("upper") else x


def _word_table(table: ElementTree.Element) -> str:
    """A table as HTML: grid spans and vertical merges as colspan and rowspan, each text once; a table inside a cell as one line for each of its rows."""

    def cell_text(c: ElementTree.Element) -> str:
        parts = []
        for x in c:
            if x.tag == f"{_WORD}p" and (t := _word_text(x)):
                parts.append(t)
            elif x.tag == f"{_WORD}tbl":
                parts += [" ".join(filter(None, map(cell_text, r.findall(f"{_WORD}tc")))) for r in x.findall(f"{_WORD}tr")]
        return "\n".join(filter(None, parts))

    rows: list[list[list]] = []
    open_: dict[int, list] = {}
    for r in table.findall(f"{_WORD}tr"):
        at, row = 0, []
        for c in r.findall(f"{_WORD}tc"):
            span = c.find(f"{_WORD}tcPr/{_WORD}gridSpan")
            width = int(span.get(f"{_WORD}val") or 1) if span is not None else 1
            merge = c.find(f"{_WORD}tcPr/{_WORD}vMerge")
            if merge is not None and (merge.get(f"{_WORD}val") or "continue") == "continue" and at in open_:
                open_[at][2] += 1
            else:
                row.append([cell_text(c), width, 1])
                open_.pop(at, None)
                if merge is not None:
                    open_[at] = row[-1]
            at += width
        rows.append(row)
    spans = lambda w, h: (f' colspan="{w}"' if w > 1 else "") + (f' rowspan="{h}"' if h > 1 else "")
    return "<table>" + "".join("<tr>" + "".join(f"<td{spans(w, h)}>{escape(t)}</td>" for t, w, h in row) + "</tr>" for row in rows) + "</table>"


def _word_blocks(data: bytes) -> Iterator[tuple[str, int, str, str | None]]:
    """(type, level, text, label) in document order, then the notes; tables are HTML."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    tree = lambda name: ElementTree.fromstring(book.read(name)) if name in names else None
    numbering = _Numbering(tree("word/numbering.xml"))
    body = ElementTree.fromstring(book.read("word/document.xml")).find(f"{_WORD}body")
    for node in body if body is not None else ():
        if node.tag == f"{_WORD}p":
            label, text = numbering.label(node), _word_text(node)
            style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
            m = re.fullmatch(r"[Hh]eading ?(\d)", style.get(f"{_WORD}val") or "") if style is not None else None
            if any(True for _ in node.iter(f"{_DRAW}blip")):
                yield "image", 0, text, None
            elif text:
                yield "text", int(m[1]) if m else 0, f"{label} {text}" if label else text, label or None
        elif node.tag == f"{_WORD}tbl":
            yield "table", 0, _word_table(node), None
    for kind in ("footnote", "endnote"):
        root = tree(f"word/{kind}s.xml")
        for note in root.iter(f"{_WORD}{kind}") if root is not None else ():
            if not note.get(f"{_WORD}type") and (text := " ".join(filter(None, map(_word_text, note.findall(f"{_WORD}p"))))):
                yield "note", 0, text, f"[^{note.get(f'{_WORD}id')}]"


def _per_file(files: DataFrame, make: Callable[[bytes], list[tuple]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """The rows of each file; a file that can't be read gives one row with what is wrong in ``error``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows = [(*r, None) for r in make(data)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError, TypeError) as e:
                    rows = [(*(None for _ in fields), f"{type(e).__name__}: {e}")]
                columns = list(zip(*rows)) if rows else [[] for _ in range(len(fields) + 1)]
                types = [*(t for _, _, t in fields), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *(f[0] for f in fields), "error"])

    return files.select("doc_id", "content").mapInArrow(parse, "doc_id string, " + ", ".join(f"{n} {t}" for n, t, _ in fields) + ", error string")


def read_sheets(files: DataFrame) -> DataFrame:
    """(doc_id, page_idx, sheet, row, cells, error) of xlsx files."""
    make = lambda data: [(n, title, k, cells) for n, title, rows in _sheet_rows(data) for k, cells in enumerate(rows)]
    return _per_file(files.where("ext = 'xlsx'"), make, [("page_idx", "int", pa.int32()), ("sheet", "string", pa.string()), ("row", "int", pa.int32()), ("cells", "array<string>", pa.list_(pa.string()))])


ITEMS = [("page_idx", "int", pa.int32()), ("reading_order", "int", pa.int32()), ("type", "string", pa.string()), ("text_level", "int", pa.int32()), ("text", "string", pa.string()), ("label", "string", pa.string())]


def read_sheet_items(files: DataFrame) -> DataFrame:
    """Items of xlsx files: each sheet's title and its table."""
    make = lambda data: [(n, k, kind, level, text, None) for k, (n, kind, level, text) in enumerate(_sheet_items(data))]
    return _per_file(files.where("ext = 'xlsx'"), make, ITEMS)


def read_word(files: DataFrame) -> DataFrame:
    """Items of docx files: paragraphs with their list labels, images, tables and notes in document order."""
    make = lambda data: [(0, k, kind, level, text, label) for k, (kind, level, text, label) in enumerate(_word_blocks(data))]
    return _per_file(files.where("ext = 'docx'"), make, ITEMS)


def _text_items(text: str) -> list[tuple]:
    parts = [x.strip() for x in re.split(r"\n[ \t]*\n", text) if x.strip()]
    level = [len(m[1]) if (m := re.match(r"(#{1,6}) ", x)) else 0 for x in parts]
    return [(0, k, "text", n, x[n:].strip() if n else x, None) for k, (n, x) in enumerate(zip(level, parts))]


#: Readers by name: a function from files to items. More may be registered; files go to the first whose extensions hold theirs.
READERS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {
    "sheet": (("xlsx",), read_sheet_items),
    "word": (("docx",), read_word),
    "html": (("html", "htm"), lambda files: _per_file(read_html(files).select("doc_id", F.encode("markdown", "UTF-8").alias("content")), lambda data: _text_items(data.decode()), ITEMS)),
    "text": (("txt", "md"), lambda files: _per_file(files, lambda data: _text_items(data.decode("utf-8", "replace")), ITEMS)),
}


def register_reader(name: str, extensions: tuple[str, ...], read: Callable[[DataFrame], DataFrame]) -> None:
    """Add a reader, or put another in the place of one."""
    READERS[name] = (extensions, read)


def routed(files: DataFrame) -> DataFrame:
    """``files`` with ``reader``: the name of the reader that takes them, ``external`` for formats that need another program (pdf, images, old office files)."""
    out = F.lit("external")
    for name, (extensions, _) in reversed(READERS.items()):
        out = F.when(F.lower("ext").isin(*extensions), name).otherwise(out)
    return files.withColumn("reader", out)


def read_items(files: DataFrame) -> DataFrame:
    """Items of all files that a reader takes, each file through its own."""
    placed = routed(files)
    made = [read(placed.where(F.col("reader") == name)).withColumn("reader", F.lit(name)) for name, (_, read) in READERS.items()]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def read_html(files: DataFrame) -> DataFrame:
    """(doc_id, title, text, markdown) of web pages; the main part where it holds over 100 characters, else the whole page."""
    html = files.where("ext in ('html', 'htm')").select("doc_id", F.decode("content", "UTF-8").alias("html"))
    main = plain_text(html_main("html"))
    return html.select("doc_id", html_title("html").alias("title"), F.when(F.length(main) > 100, main).otherwise(plain_text("html")).alias("text"), html_to_markdown("html").alias("markdown"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, term) of expectation manifests (one JSON object in each file): what must be in a delivery, what must not, the facts, and the limits ``min_chunk_count`` and ``max_chunk_tokens``."""
    lists, limits = ("must_include", "must_not_include", "fact_tokens"), ("min_chunk_count", "max_chunk_tokens")
    fields = ", ".join([*(f"{k} array<string>" for k in lists), *(f"{k} int" for k in limits)])
    m = spark.read.schema(f"doc struct<name string, source_pdf string, notes string>, expectations struct<{fields}>").json(path, multiLine=True)
    own = lambda k: F.col(f"expectations.{k}") if k in lists else F.array(F.col(f"expectations.{k}").cast("string"))
    named = lambda k: lambda t: F.struct(F.lit(k).alias("kind"), t.alias("term"))
    each = [F.transform(F.coalesce(own(k), F.array().cast("array<string>")), named(k)) for k in (*lists, *limits)]
    return m.select(F.col("doc.name").alias("name"), F.explode(F.flatten(F.array(*each))).alias("x")).select("name", "x.kind", "x.term").where("term is not null")


def read_layout_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_idx, block_no, kind, text, bbox, width, height) of layout results in either schema: pages with ``preproc_blocks`` or ``para_blocks`` and a ``page_size``, or a list of pages with ``layout_dets`` and a ``page_info``."""
    block = "struct<type:string,category:string,text:string,bbox:array<double>,poly:array<double>>"
    page = f"struct<page_idx:int,page_size:array<double>,preproc_blocks:array<{block}>,para_blocks:array<{block}>,layout_dets:array<{block}>,page_info:struct<page_no:int,width:double,height:double>>"
    files = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    pages = F.coalesce(F.from_json("value", f"struct<pdf_info:array<{page}>>")["pdf_info"], F.from_json("value", f"array<{page}>"))
    each = files.select("file", F.posexplode(pages).alias("_k", "p"))
    own = each.select("file", F.coalesce("p.page_idx", "p.page_info.page_no", "_k").alias("page_idx"), F.coalesce(F.col("p.page_size")[0], "p.page_info.width").alias("width"), F.coalesce(F.col("p.page_size")[1], "p.page_info.height").alias("height"), F.posexplode(F.coalesce("p.preproc_blocks", "p.para_blocks", "p.layout_dets")).alias("block_no", "b"))
    return own.select("file", "page_idx", "block_no", F.coalesce("b.type", "b.category").alias("kind"), "b.text", F.coalesce("b.bbox", "b.poly").alias("bbox"), "width", "height")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, run_id, file) of the run folders under ``docs/<doc>/runs/<run>``, in the order of documents and runs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/docs").select("path")
    m = lambda k: F.regexp_extract("path", "/docs/([^/]+)/runs/([^/]+)/(.+)$", k)
    return files.select(m(1).alias("doc_id"), m(2).alias("run_id"), m(3).alias("file")).where("run_id <> ''").orderBy("doc_id", "run_id", "file")
