"""Operators on small literal inputs, against results worked out by hand."""

from __future__ import annotations

import io
import random
import shutil
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill import rules
from pagemill.functions import tokens as tk
from pagemill.operators import blocks as bl
from pagemill.operators import catalog, chunking, coverage, geometry, graph, retrieval
from pagemill.operators import tables as tb
from pagemill.sources import files, sinks
from pagemill.streaming import ingest, work


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "given_text", "want"),
    [
        (tx.plain_text, "<p>a&amp;b<!-- c --> &lt;d&gt;</p>\n e", "a&b <d> e"),
        (tx.plain_text, "", ""),
        (tx.normalized_text, "Größe 12-b_c!", "größe12b_c"),
        (tx.fullwidth_fold, "１２．５％", "12.5%"),
        (tx.slug, "Form  TR-12 / 表單", "form-tr-12-表單"),
        (tx.heading_key, "## §12 Notes, on X", "notesonx"),
        (tx.markdown_to_text, "# A\n\n![p](u) [l](v) `c` **b**\n- x", "A\n\np l c b\nx"),
        (tx.source_title, "/data/inbox/a/2024/03_Guide_to_x_v1.2.pdf", "Guide to x"),
        (tx.mask_domain_account, "ab NORV\\e12345, c", "ab NORV\\e*****, c"),
        (tx.mask_email_id, "to d23456@host.test", "to d*****@host.test"),
        (tx.mask_email_id, "to name@host.test", "to name@host.test"),
        (tx.html_title, "<html><TITLE a=1> T </TITLE>", "T"),
        (tx.html_to_markdown, "<nav>n</nav><main id=m><h2>H</h2><p>a <b>b</b></p><pre>x</pre></main>", "## H\n\na **b**\n\n```\nx\n```"),
        (tx.decode_entities, "&amp;lt;", "&lt;"),
        (tx.plain_text, None, None),
    ],
)
def test_text(spark, f, given_text, want):
    assert one(spark, given_text, f) == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aé表。，ー\U0001f4ce\n ｆ", max_size=40), min_size=1, max_size=8))
def test_estimates_agree(spark, texts):
    df = spark.createDataFrame([(x,) for x in [*texts, None]], "x string")
    rows = df.select("x", tk.token_estimate("x").alias("a"), tk.token_estimate_expr("x").alias("b")).collect()
    assert all(r["a"] == r["b"] == (chunking.tokens(r["x"]) if r["x"] else 0) for r in rows)


def test_grid_spans():
    cells = tb.grid("<table><tr><th rowspan=2>a</th><th colspan=2>b</th></tr><tr><td>c</td><td>d &amp; e</td></tr></table>")
    assert [(r, c, t) for r, c, t, *_ in cells] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c"), (1, 2, "d & e")]
    assert tb.grid("") == [] and tb.grid("<p>no table") == []


def test_records_and_markdown(spark):
    html = "<table><tr><td>Form</td><td>Days</td></tr><tr><td>A|1</td><td>3</td></tr><tr><td></td><td>4</td></tr></table>"
    cells = tb.html_cells(spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string"), ["id"], "html")
    assert [r["record"] for r in tb.to_records(cells, ["id"], "row").orderBy("row").collect()] == ["Form: A|1; Days: 3", "Form: A|1; Days: 4"]
    assert tb.to_markdown(cells, ["id"], "row").first()["markdown"] == "| Form | Days |\n| A\\|1 | 3 |\n|  | 4 |"
    assert [r["filled"] for r in tb.forward_fill(cells, ["id"], "row").where("column = 0").orderBy("row").collect()] == ["Form", "A|1", "A|1"]
    named = tb.number_repeats(spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "y")], "t int, k int, name string"), ["t"], "k", "name")
    assert [r["numbered"] for r in named.orderBy("k").collect()] == ["x", "x(2)", "y"]


def test_heading_paths(spark):
    heads = spark.createDataFrame([("d", i, lv, t) for i, (lv, t) in enumerate([(1, "A"), (2, "B"), (3, "C"), (2, "D"), (1, "E"), (3, "F")])], "doc string, seq int, level int, title string")
    got = [r["path"] for r in bl.heading_paths(heads, ["doc"]).orderBy("seq").collect()]
    assert got == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"], ["E", "F"]]


def test_chunks_cover_and_stay_within(spark):
    text = "# A\n" + "\n".join(f"line {i} of the first part, which is long enough to count." for i in range(60)) + "\n## B\n\n# C\nshort\n" + "表" * 900
    rows = chunking.chunk_documents(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n ")], "doc int, text string"), "doc", "text", 200, 40).orderBy("chunk_id").collect()
    assert rows and all(r["tokens"] <= 200 and chunking.tokens(r["content"]) == r["tokens"] for r in rows)
    assert all(any(x.strip() in r["content"] for r in rows) for x in text.split("\n")[:65] if x.strip())
    assert "".join(r["content"] for r in rows).count("表") >= 900 and {r["doc"] for r in rows} == {1}
    assert "Exchange" not in chunking.chunk_documents(spark.createDataFrame([(1, text)], "doc int, text string"), "doc", "text")._jdf.queryExecution().toString()


def test_bare_heading_takes_its_follower_whatever_the_size():
    body = "word " * 500
    rows = chunking.chunks_of(f"# A\n## B\n{body}\nlast line", 100, 10)
    assert rows[0][6].startswith("# A\n\n## B") and all(r[4] == ["A", "B"] for r in rows)
    # a heading at the end goes back to what stands before it
    assert chunking.chunks_of("# A\ntext\n# B")[0][6] == "# A\n\ntext\n\n# B"
    # both small, but only as they were: merged sections don't grow past the limit
    small = "\n".join(f"# H{i}\n" + "word " * 60 for i in range(6))
    assert [r[6].count("# H") for r in chunking.chunks_of(small, 180, 10)] == [2, 2, 2]


def test_parts_end_at_breaks_and_name_their_parent():
    rows = chunking.chunks_of("regulation " * 300, 50, 10)
    assert all(r[6].endswith("regulation ") or r[6].endswith("regulation") for r in rows)
    assert [r[0] for r in rows] == [f"c000000_part{i}" for i in range(1, len(rows) + 1)] and {(r[1], r[3]) for r in rows} == {("c000000", len(rows))}
    parts = list(chunking.bound("申請。" * 100, 20))
    assert all(p.endswith("。") for p in parts) and chunking.tokens(parts[0]) <= 20


def test_continued_chunks_repeat_the_path():
    rows = chunking.chunks_of("# A\n" + "\n".join("word " * 20 for _ in range(20)), 100, 30)
    assert len(rows) > 2 and all(r[6].startswith("A（續）\n\n") for r in rows[1:] if r[2] in (None, 1))


def test_placed_blocks(spark):
    text = "# H\none\none\n|a|b|\n|c|\n\nafter\n## I\none"
    rows = bl.placed_blocks(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x\nx")], "id int, text string"), ["id"], "text").orderBy("id", "reading_order").collect()
    one_ = [r for r in rows if r["id"] == 1]
    assert [r["section_id"] for r in one_] == [1] * 7 + [2] * 2 and [r["seen"] for r in one_ if r["line"] == "one"] == [0, 1, 2]
    assert all(text[r["range_start"] : r["range_end"]] == r["line"] for r in one_)
    assert [r["table_no"] for r in one_] == [0, 0, 0, 1, 1, 1, 1, 1, 1] and [r["text_no"] for r in one_ if r["table_no"] and r["text"]] == [1, 2, 3]
    assert [r["above"] for r in one_ if r["begins"]] == ["one"]
    assert [(r["id"], r["line"], r["seen"], r["above"]) for r in rows if r["id"] > 1] == [(3, "", 0, None), (4, "x", 0, None), (4, "x", 1, "x")]


def test_coverage(spark):
    df = spark.createDataFrame([("", "x", True), ("Pay 12 by Friday", "pay 12 by friday noon", True), ("Pay 13", "pay 12", False), ("short", "other", False), (None, "x", None), ("<b>Pay</b> -1,200", "we pay -1200 now", True), ("Pay -12 by Friday", "pay 12 by friday", False), ("the same words again the same words ag ain zz", "the same words again", False)], "s string, d string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", coverage.covers("s", "d")).collect())


def test_catalogue(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    assert {(r["k"], r["v"]) for r in catalog.upsert(base, new, ["k"], "t").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {r["k"] for r in catalog.invalidate(base, new, ["k"]).collect()} == {1}
    stages = spark.createDataFrame([("r", 1, "parse", "succeeded"), ("r", 2, "chunk", "failed"), ("s", 3, "parse", "succeeded"), ("s", 4, "chunk", "running"), ("t", 5, "a", "succeeded"), ("t", 6, "b", "succeeded")], "run_id string, id int, stage string, status string")
    assert {r["run_id"]: r["stage"] for r in catalog.current_stage(stages).collect()} == {"r": "chunk", "s": "chunk", "t": "b"}


def test_geometry(spark):
    rows = [("p", 0, "text", 0, 0, 100, 100), ("p", 1, "table", 0, 0, 100, 99), ("p", 2, "text", 500, 0, 600, 50), ("p", 3, "text", 500, 0, 600, 50)]
    df = spark.createDataFrame(rows, "page string, at int, type string, x0 int, y0 int, x1 int, y1 int")
    assert {r["at"] for r in geometry.dedup_regions(df, ["page"], "at").collect()} == {1, 2}
    assert {(r["first"], r["second"]) for r in geometry.overlapping(df, ["page"], "at").collect()} == {(0, 1), (2, 3)}
    lines = spark.createDataFrame([("p", 0, 0, 100, 10, "one"), ("p", 0, 12, 90, 22, "two"), ("p", 0, 90, 90, 100, "three")], "page string, x0 int, y0 int, x1 int, y1 int, text string")
    assert [r["text"] for r in geometry.merge_lines(lines, ["page"]).orderBy("y0").collect()] == ["one two", "three"]
    rng = random.Random(1)
    boxes = [(x, y, x + rng.randint(1, 60), y + rng.randint(1, 40)) for x, y in ((rng.randint(0, 30), rng.randint(0, 30)) for _ in range(150))]
    for least in (0.5, 0.7, 0.9):
        share = lambda a, b: (lambda both: both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both))(max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1])))
        want = {(i, j) for i in range(150) for j in range(i + 1, 150) if share(boxes[i], boxes[j]) > least}
        some = spark.createDataFrame([("p", i, *b) for i, b in enumerate(boxes)], "page string, at int, x0 int, y0 int, x1 int, y1 int")
        got = [(r["first"], r["second"]) for r in geometry.overlapping(some, ["page"], "at", least).collect()]
        assert sorted(got) == sorted(want) and (want or least > 0.8)
    columns = spark.createDataFrame([("p", 50, 400), ("p", 600, 950), ("p", 60, 420)], "page string, x0 int, x1 int")
    assert abs(geometry.gutters(columns, ["page"]).first()["gutter"] - 510) <= 10


def test_graph(spark):
    edges = spark.createDataFrame([("c", 2, 1), ("c", 3, 2), ("c", 5, 6), ("c", 6, 5)], "chart string, child int, parent int")
    names = spark.createDataFrame([("c", i, n) for i, n in ((1, "a"), (2, "b"), (3, "c"), (5, "x"), (6, "y"))], "chart string, id int, name string")
    got = {r["id"]: (r["path"], r["cyclic"]) for r in graph.paths(edges, names, ["chart"]).collect()}
    assert got[3] == ("a > b > c", False) and got[1] == ("a", False) and got[5][1] and got[6][1]
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    needs = spark.createDataFrame([(1, 2), (2, 9), (3, 4)], "id int, needed int")
    assert {r["id"] for r in graph.closed_subset(items, needs).collect()} == {3, 4}


def test_parent_score(spark):
    """Scores worked out by hand on a page of 800 by 400."""
    nodes = spark.createDataFrame([("p", 1, 300, 0, 500, 50, 0), ("p", 2, 0, 100, 100, 150, 1), ("p", 3, 320, 100, 480, 150, 1), ("p", 4, 600, 350, 800, 400, 2)], "chart string, id int, x0 int, y0 int, x1 int, y1 int, level int")
    got = {(r["child"], r["parent"]): (r["score"], r["place"]) for r in graph.parents(nodes, ["chart"]).collect()}
    assert got[3, 1] == (round(0.4 + 0.3 * (1 - 100 / 400) + 0.3, 6), 1)
    assert got[2, 1] == (round(0.3 * 0.75 + 0.3 * (1 - min(1, 350 / 240)), 6), 1)
    assert got[4, 1][0] == round((0.3 * (1 - 350 / 400) + 0.0) / 2, 6) and got[4, 2][1] == 1 and got[4, 3] == (0.1125, 2) and len(got) == 5


def test_fact_recall(spark):
    q = spark.createDataFrame(
        [(1, "en", ["Fee", "fee", "old fee", "x", None, "fee"]), (2, "de", ["fee"]), (3, None, ["fee", ""]), (4, "en", [""]), (4, "fr", ["", "FEE"]), (5, "en", [None]), (6, "en", None), (7, "en", [])],
        "id int, lang string, terms array<string>",
    )
    t = spark.createDataFrame([("en", "the FEE of x"), ("en", None), ("de", "no charge"), (None, "fee"), ("fr", "the old fee"), ("EN", "old fee")], "lang string, text string")
    found = retrieval.fact_recall(q, t, "lang", "terms", "text", "id")
    want = [(1, 4, 3, 0.75), (2, 1, 0, 0.0), (3, 2, 0, 0.0), (4, 2, 2, 1.0)]
    assert sorted(map(tuple, found.collect())) == want
    # no text takes part in a join
    assert all("_text" not in line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line or "Exchange" in line)
    assert sorted(map(tuple, retrieval.fact_recall(q, t.limit(0), "lang", "terms", "text", "id").collect())) == [(k, n, 0, 0.0) for k, n, *_ in want]


def test_retrieval(spark):
    q = spark.createDataFrame([(1, "Where is form_12 a?", "x"), (2, "流程圖 說明", "x"), (3, None, "x")], "id int, query string, k string")
    assert [r["t"] for r in q.select(retrieval.query_terms("query").alias("t")).collect()] == [sorted(["where", "is", "form_12", "a", "a?"]), sorted(["流程圖", "說明", "flowchart", "chart", "diagram"]), None]
    c = spark.createDataFrame([(10, "chunk", "the FORM_12 is here", "x"), (11, "table", "form_12 is", "x"), (12, "chunk", "a flowchart", "x"), (13, "chunk", None, "x"), (14, "chunk", "zzz", "x")], "cid int, kind string, text string, extra string")
    got = {(r["id"], r["place"]): (r["cid"], r["score"]) for r in retrieval.top_k(q, c, "query", "text", "id", "cid", 2).collect()}
    assert got == {(1, 1): (10, 2), (1, 2): (11, 2), (2, 1): (12, 2)} or got[1, 1] == (11, 2)
    assert retrieval.automaton(["ab", "b"])("xab") == {"ab", "b"} and retrieval.automaton([])("x") == set()


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _xlsx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Second file" r:id="a"/><sheet name="First file" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="b" Target="worksheets/sheet1.xml"/><Relationship Id="a" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}><si><t>Form</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {_MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.0</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {_MAIN}><sheetData><row r="1"><c r="A1" t="str"><v>m &amp; n</v></c><c r="B1" t="str"><v>covered</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    return out.getvalue()


def _docx() -> bytes:
    out, ns = io.BytesIO(), 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    item = lambda t, n, k: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{k}"/><w:numId w:val="{n}"/></w:numPr></w:pPr>{run(t)}</w:p>'
    p = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run("T")}</w:p><w:p>{run("kept")}<w:del>{run("gone")}</w:del><w:ins>{run(" new")}</w:ins><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
    lists = item("one", 1, 0) + item("sub", 1, 1) + item("two", 1, 0) + item("sub", 1, 1) + item("other", 2, 0)
    cell = lambda t, extra="": f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p>{run(t)}</w:p></w:tc>"
    nested = f"<w:tc><w:p/><w:tbl><w:tr>{cell('n1')}{cell('n2')}</w:tr><w:tr>{cell('n3')}</w:tr></w:tbl></w:tc>"
    wide, top, rest = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    t = f"<w:tbl><w:tr>{cell('a', top)}{cell('b', wide)}</w:tr><w:tr>{cell('', rest)}{cell('c &lt;')}{nested}</w:tr></w:tbl>"
    level = lambda k, kind, text: f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{text}"/></w:lvl>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p}{lists}{t}</w:body></w:document>")
        z.writestr("word/numbering.xml", f'<w:numbering {ns}><w:abstractNum w:abstractNumId="7">{level(0, "decimal", "%1.")}{level(1, "lowerRoman", "%1.%2)")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>')
        z.writestr("word/footnotes.xml", f'<w:footnotes {ns}><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p>{run("a note")}</w:p></w:footnote></w:footnotes>')
    return out.getvalue()


def test_file_sources(spark, tmp_path):
    for name, data in (("a.xlsx", _xlsx()), ("b.docx", _docx()), ("c.html", b"<title>T</title><main><p>" + b"word " * 40 + b"</p></main>"), ("d.exe", b"x"), ("e.docx", b"broken"), ("f.md", "# Kopf\n\nText".encode()), ("g.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(data)
    found = files.read_files(spark, str(tmp_path))
    assert {r["ext"] for r in found.select("ext").collect()} == {"xlsx", "docx", "html", "md", "pdf"}
    assert [(r["sheet"], r["cells"]) for r in files.read_sheets(found).orderBy("page_idx", "row").collect()] == [("Second file", ["m & n"]), ("First file", ["Form", "", "3"]), ("First file", ["", "x", ""])]
    items = [(r["type"], r["text_level"], r["text"]) for r in files.read_sheet_items(found).orderBy("reading_order").collect()]
    assert items == [("text", 1, "Second file"), ("table", 0, "<table><tr><th>m &amp; n</th></tr></table>"), ("text", 1, "First file"), ("table", 0, "<table><tr><th>Form</th><th></th><th>3</th></tr><tr><td></td><td>x</td><td></td></tr></table>")]
    word = files.read_word(found).orderBy("reading_order").collect()
    assert [r["error"] is not None for r in word if r["type"] is None] == [True]
    good = [(r["type"], r["text_level"], r["text"]) for r in word if r["type"]]
    assert good[:7] == [("text", 1, "T"), ("text", 0, "kept new[^2]"), ("text", 0, "1. one"), ("text", 0, "1.i) sub"), ("text", 0, "2. two"), ("text", 0, "2.i) sub"), ("text", 0, "5. other")]
    assert good[7] == ("table", 0, '<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c &lt;</td><td>n1 n2\nn3</td></tr></table>') and good[8] == ("note", 0, "a note")
    assert {r["reader"]: r["n"] for r in files.routed(found).groupBy("reader").agg(F.count("*").alias("n")).collect()} == {"sheet": 1, "word": 2, "html": 1, "text": 1, "external": 1}
    assert {(r["reader"], r["text"]) for r in files.read_items(found).where("reader = 'text'").collect()} == {("text", "Kopf"), ("text", "Text")}
    assert files.read_html(found).first()["title"] == "T"
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    assert sorted((r["a"] or 0, r["_read_error"] or "") for r in rows) == [(0, "not json"), (1, ""), (2, "")]
    (tmp_path / "l.json").write_text('[{"type": "text", "text": "H", "text_level": 1}, {"type": "table", "img_path": "i"}, {"type": "list", "list_items": ["a", "b"]}]')
    got = files.read_content_list(spark, str(tmp_path / "l.json")).orderBy("reading_order").collect()
    assert [(r["block_type"], r["heading_level"], r["block_text"]) for r in got] == [("text", 1, "H"), ("image", None, None), ("text", None, "a\nb")]


def test_entities_and_links(spark):
    assert one(spark, "a &#174; &#xAE; &reg; &trade; &amp;amp; x&nbsp;y & z", tx.decode_entities) == "a ® ® ® ™ &amp; x y & z"
    assert one(spark, "see https://a.example/ b/ c/ d/ e and f", tx.rejoin_urls) == "see https://a.example/b/c/d/e and f"
    assert one(spark, "a<!-- x -->&lt;b", tx.plain_text) == "a <b"


def test_publish(spark, tmp_path):
    root = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a", 1)], "k int, v string, t int")
    assert sinks.upsert_table(a, root, ["k"], "t", "v1").count() == 1
    b = spark.createDataFrame([(1, "b", 2), (2, "c", 1)], "k int, v string, t int")
    assert {r["v"] for r in sinks.upsert_table(b, root, ["k"], "t", "v2").collect()} == {"b", "c"}
    assert sinks.verified(spark, root, "v1") and sinks.verified(spark, root, "v2")
    assert sinks.current_version(spark, root) == "v2" and sinks.current_version(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError, match="exists"):
        sinks.publish(a, root, "v2")
    with pytest.raises(ValueError, match="stale"):
        sinks.checked_artifact(spark, root, "v1")
    # a version that can't be read raises, and the table stays as it is
    shutil.move(f"{root}/versions/v2", f"{root}/hidden")
    with pytest.raises(Exception, match="v2"):
        sinks.upsert_table(a, root, ["k"], "t", "v3")
    shutil.move(f"{root}/hidden", f"{root}/versions/v2")
    assert {r["v"] for r in sinks.current(spark, root).collect()} == {"b", "c"}
    assert sinks.checked_artifact(spark, root, "v2").count() == 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc int, text string")
    lines = bl.blocks(empty, ["doc"], "text")
    assert chunking.chunk_documents(empty, "doc", "text").count() == 0 and bl.placed_blocks(empty, ["doc"], "text").count() == 0
    assert bl.repeated_lines(lines, "doc", 2).count() == 0
    assert empty.select(F.sum(tk.token_estimate("text"))).first()[0] is None


def test_queue_and_receipts(spark, tmp_path):
    queue, root = tmp_path / "queue", f"file://{tmp_path}"
    queue.mkdir()
    for k in range(5):
        (queue / f"{k}.json").write_text('{"doc_id": "d%d", "n": %d}\n' % (k, k))
    double = lambda df: df.withColumn("n", F.col("n") * 2)
    for _ in range(2):
        work.drain(spark, str(queue), "doc_id string, n int", double, f"{root}/done", f"{root}/checkpoint")
    (queue / "9.json").write_text('{"doc_id": "d9", "n": 9}\n')
    work.drain(spark, str(queue), "doc_id string, n int", double, f"{root}/done", f"{root}/checkpoint")
    assert sorted(r["n"] for r in spark.read.parquet(f"{root}/done").collect()) == [0, 2, 4, 6, 8, 18]

    def inputs(texts):
        return spark.createDataFrame(texts, "doc_id string, text string").withColumn("fingerprint", work.fingerprint(F.col("text"), F.lit("v1")))

    stage = lambda texts, k: work.run_stage(inputs(texts), f"{root}/receipts", "chunk", k, lambda df: df, f"{root}/chunks")
    assert [stage([("a", "x"), ("b", None)], 1), stage([("a", "x"), ("b", None)], 2), stage([("a", "y"), ("b", "")], 3), stage([("a", "x"), ("c", "z")], 4), stage([("a", "x")], 5)] == [2, 0, 2, 2, 0]
    assert work.pending(inputs([("a", "x")]), work.receipts(spark, f"{root}/receipts"), "other").count() == 1


def test_ingest_takes_a_key_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    add = lambda rows: spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(f"{root}/source")
    for rows in ([("a", 1), ("a", 1), (None, 2), (None, 3)], [("a", 4), ("b", 5)]):
        add(rows)
        ingest.ingest(spark, f"{root}/source", "k string, v int", "k", f"{root}/target", f"{root}/checkpoint")
    assert sorted((r["k"] or "", r["v"]) for r in spark.read.parquet(f"{root}/target").collect()) == [("", 2), ("", 3), ("a", 1), ("b", 5)]


def test_exports_and_bundles(spark, tmp_path):
    root = f"file://{tmp_path}"
    docs = spark.createDataFrame([("d1", "main", "# A\nx"), ("d1", "child", "y"), ("d2", "main", "")], "doc_id string, name string, markdown string")
    assert sinks.write_exports(docs, f"{root}/exports").count() == 3
    assert {p.parent.name for p in tmp_path.glob("exports/documents/doc_id=d1/*/*.txt")} == {"name=main", "name=child"}
    bundle = sinks.write_bundle({"plan": docs.limit(1), "records": docs}, f"{root}/b", "r1")
    assert bundle["records"].count() == 3 and sinks.current_version(spark, f"{root}/b/bundle") == "r1"


def test_manifests_layouts_and_runs(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"doc": {"name": "leave"}, "expectations": {"must_include": ["a", "b"], "fact_tokens": ["12"], "min_chunk_count": 3}}')
    assert {(r["kind"], r["term"]) for r in files.read_golden(spark, str(tmp_path / "g.json")).collect()} == {("must_include", "a"), ("must_include", "b"), ("fact_tokens", "12"), ("min_chunk_count", "3")}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "m.json").write_text('{"pdf_info": [{"page_idx": 2, "page_size": [600, 800], "preproc_blocks": [{"type": "text", "bbox": [1, 2, 3, 4]}]}]}')
    (tmp_path / "l" / "n.json").write_text('[{"page_info": {"page_no": 1, "width": 100, "height": 50}, "layout_dets": [{"category": "table", "poly": [0, 0, 9, 0, 9, 9, 0, 9]}]}]')
    got = {(r["file"], r["page_idx"], r["kind"], r["width"], len(r["bbox"])) for r in files.read_layout_evidence(spark, str(tmp_path / "l")).collect()}
    assert got == {("m.json", 2, "text", 600.0, 4), ("n.json", 1, "table", 100.0, 8)}
    for doc, run in (("d2", "r1"), ("d1", "r2"), ("d1", "r1")):
        (tmp_path / "w" / "docs" / doc / "runs" / run).mkdir(parents=True)
        (tmp_path / "w" / "docs" / doc / "runs" / run / "chunks.jsonl").write_text("{}")
    assert [(r["doc_id"], r["run_id"]) for r in files.list_runs(spark, str(tmp_path / "w")).collect()] == [("d1", "r1"), ("d1", "r2"), ("d2", "r1")]


def test_rules_and_profiles(tmp_path, monkeypatch):
    default = {"markers": {"x": "one"}, "text_fixes": [{"pattern": "a(b)", "replacement": "\\1$", "flags": "IGNORECASE"}]}
    assert rules.load(default).markers == {"x": ("one",)} and rules.load(default).text_fixes[0].to == "$1\\$" and rules.load(default).text_fixes[0].java == "(?i)a(b)"
    (tmp_path / "r.json").write_text('{"keywords": {"k": ["v"]}}')
    monkeypatch.setenv(rules.VARIABLE, str(tmp_path / "r.json"))
    assert rules.load(default).keywords == {"k": ("v",)}
    monkeypatch.setenv(rules.VARIABLE, str(tmp_path / "none.json"))
    with pytest.warns(UserWarning, match="default"):
        assert rules.load(default).markers
    with pytest.raises(ValueError, match="flags"):
        rules.RegexRule("a", flags=("odd",))
    p = rules.Profile()
    assert p.with_overrides({"package": {"chunk_max_tokens": 512}}).hash == p.hash != p.with_overrides({"chunk_max_tokens": 100}).hash
    with pytest.raises(ValueError, match="unknown"):
        p.with_overrides({"other": 1})


def test_ledger_edges(spark):
    empty = spark.createDataFrame([], "doc string, block string, text string")
    one_ = spark.createDataFrame([("a", "b", None), ("a", "c", ""), (None, "d", "some text of a length"), ("a", "e", "some text of a length"), ("a", "e", "some text of a length")], "doc string, block string, text string")
    assert coverage.ledger(empty, empty, "doc", "block", "text", "text").count() == 0
    got = {(r["block"], r["covered"]) for r in coverage.ledger(one_, one_, "doc", "block", "text", "text").collect()}
    assert ("e", True) in got and ("c", True) in got
