"""Queries over literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import cells as ce
from pagemill.operators import tables as tb
from pagemill.plans.literal import Literal

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


CELL = Literal("id int, cell string", list(enumerate(["", " ", "12", "1,234.5%", "4.64.74.7", ".7", "7", "項", "項目", "ab", "abc", "a1", "Form", "□ □", "2024/01", "圖样", "隊x验", "一二三四 ab", "-", "x-y9", "１２", "驗證圖", "12 %"])))
ROWS = Literal("tbl string, row int, caption string, cells array<string>", [
    ("a", 0, "Stock", ["Item", "Unit", "Count"]), ("a", 1, "Stock", ["Pen", "box", "12"]), ("a", 2, "Stock", ["", "", ""]), ("a", 3, "Stock", ["", "", ""]), ("a", 4, "Stock", ["", "", ""]), ("a", 5, "Stock", ["Ink", "", "7 < 8 & 9"]),
    ("a", 6, "Stock", ["Item", "Unit", "Count"]), ("a", 7, "Stock", ["Source: store", "", ""]), ("a", 8, "Stock", ["", "", ""]),
    ("b", 0, None, ["", ""]), ("b", 1, None, ["辦公用品及消耗品項目（包含紙張）", ""]), ("b", 2, None, ["甲", "乙"]), ("b", 3, None, ["", ""]), ("b", 4, None, ["丙", ""]), ("b", 5, None, ["", ""]), ("b", 6, None, ["", ""]), ("b", 7, None, ["", None]), ("b", 8, None, ["丁", "戊己"]),
    *(("c", k, "noise", [".", "x", "圖样" if k % 2 else "", "-", "12" if k == 1 else "·", ""]) for k in range(4)),
    *(("d", k, "long", [f"r{k}", str(k * 10)]) for k in range(30)),
])
_R = "with " + ROWS.cte("r")
_SPACE = r"[ \t\n\r\f\x0B\x{A0}\x{3000}]+"


def _c(x: str) -> str:
    return f"regexp_replace({x}, '{_SPACE}', '', 'g')"


FIG = f"(length({_c('cell')}) >= 2 and regexp_matches({_c('cell')}, '{ce.FIGURE}'))"
WEAK = f"({_c('cell')} = '' or (not {FIG} and (regexp_matches({_c('cell')}, '{ce.DEBRIS[0]}') or regexp_matches({_c('cell')}, '{ce.DEBRIS[1]}') or regexp_matches({_c('cell')}, '{ce.DEBRIS[2]}') or (length({_c('cell')}) <= 1 and not regexp_matches({_c('cell')}, '{ce.HAN}')))))"
GOOD = f"(not {WEAK} and ({FIG} or len(regexp_extract_all({_c('cell')}, '{ce.HAN}')) >= 2 or len(regexp_extract_all({_c('cell')}, '[A-Za-z]')) >= 3 or (length({_c('cell')}) >= 4 and regexp_matches({_c('cell')}, '{ce.HAN}|[A-Za-z]'))))"
BAD = f"((len(regexp_extract_all({_c('cell')}, '{ce.MIXED_UP}')) >= 2 and length({_c('cell')}) <= 24) or regexp_matches({_c('cell')}, '{ce.GARBLED}'))"
_FILLED = "list_filter(cells, lambda c: coalesce(c, '') <> '')"


@query(f"with {CELL.cte('t')} select id, {FIG} as figure, {WEAK} as weak, {GOOD} as meaningful, {BAD} as garbled from t")
def cell_classes(spark, root):
    """Figures, debris, meaningful and garbled cells."""
    c = F.col("cell")
    return CELL.df(spark).select("id", ce.is_figure(c).alias("figure"), ce.is_weak(c).alias("weak"), ce.is_meaningful(c).alias("meaningful"), ce.is_garbled(c).alias("garbled"))


@query(f"""{_R}, h as (select tbl, cells as head from r where row = 0), f as (select r.*, {_FILLED} as own, list_transform(list_filter(head, lambda c: coalesce(c, '') <> ''), lambda c: {_c('c')}) as names from r join h on h.tbl = r.tbl)
select tbl, row, len(own) = 1 and coalesce(regexp_matches(own[1], '{ce.NOTE}'), false) as note, len(own) = 1 and coalesce(length({_c('own[1]')}) >= 12 and regexp_matches(own[1], '{ce.SECTION}'), false) as section,
 len(own) > 0 and len(names) > 0 and len(list_filter(list_transform(own, lambda c: {_c('c')}), lambda c: list_contains(names, c))) >= least(3, len(names)) as header from f""")
def row_classes(spark, root):
    """Notes, sections and repeated headers among the rows of tables."""
    r = ROWS.df(spark)
    head = r.where("row = 0").select("tbl", F.col("cells").alias("head"))
    return r.join(head, "tbl").select("tbl", "row", ce.is_note_row(F.col("cells")).alias("note"), ce.is_section_row(F.col("cells")).alias("section"), ce.is_repeated_header(F.col("cells"), F.col("head")).alias("header"))


@query(f"""{_R}, e as (select tbl, len(cells) as width, unnest({_FILLED}) as cell from r), s as (select tbl, count(*) as n, max(width) as w, avg({WEAK}::int) as weak, avg({GOOD}::int) as good, max({BAD}::int) as bad from e group by 1)
select tbl, n >= 8 and ((w >= 5 and good < 0.35 and weak >= 0.45) or (weak >= 0.65 and good < 0.45) or (bad = 1 and weak >= 0.45)) as low from s""")
def table_confidence(spark, root):
    return ce.low_confidence(ROWS.df(spark), ["tbl"], "cells")


@query("""select * from (values ('a', 'TABLE: Stock' || chr(10) || 'COLUMNS: Item | Unit | Count' || chr(10) || 'ROW: Pen | box | 12' || chr(10) || '...(3 empty rows)' || chr(10) || 'ROW: Ink |  | 7 < 8 & 9' || chr(10) || 'ROW: Item | Unit | Count' || chr(10) || 'ROW: Source: store |  | '),
('b', 'TABLE:' || chr(10) || 'COLUMNS: 辦公用品及消耗品項目（包含紙張） | ' || chr(10) || 'ROW: 甲 | 乙' || chr(10) || 'ROW: (empty)' || chr(10) || 'ROW: 丙 | ' || chr(10) || '...(3 empty rows)' || chr(10) || 'ROW: 丁 | 戊己')) as t(tbl, text)""")
def table_row_text(spark, root):
    return ce.row_text(ROWS.df(spark).where("tbl in ('a', 'b')"), ["tbl"], "row", "cells", "caption")


@query(f"""{_R}, k as (select tbl, row, cells, row_number() over (partition by tbl order by row) as i, count(*) over (partition by tbl) as n from r)
select tbl, row, array_to_string(case when n <= 16 or i <= 11 or i > n - 5 then cells else ['... (truncated) ...'] end, '|') as line from k where n <= 16 or i <= 12 or i > n - 5""")
def truncated_tables(spark, root):
    """Header, first and last rows of large tables with a marker between."""
    return ce.truncated(ROWS.df(spark), ["tbl"], "row", "cells").select("tbl", "row", F.array_join("cells", "|").alias("line"))


@query(f"""{_R}, t as (select tbl, row, '<tr>' || array_to_string(list_transform(cells, lambda c: '<td>' || replace(replace(replace(coalesce(c, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>'), '') || '</tr>' as h from r) select tbl, '<table>' || string_agg(h, '' order by row) || '</table>' as html from t group by 1""")
def table_html(spark, root):
    return ce.to_html(ROWS.df(spark), ["tbl"], "row", "cells")


@query(f"""{_R}, f as (select tbl, row, {_FILLED} as own from r), k as (select *, row_number() over (partition by tbl order by row) as i, max(len(own)) over (partition by tbl) <= 2 and count(*) over (partition by tbl) >= 4 as plain from f where len(own) > 0)
select tbl, string_agg(case when plain then '- ' else '- Row ' || i || ': ' end || array_to_string(own, ' | '), chr(10) order by i) as text from k group by 1""")
def table_fragments(spark, root):
    """Tables without a header as notes."""
    return ce.fragment_text(ROWS.df(spark), ["tbl"], "row", "cells")


@query(f"""{_R}, e as (select tbl, row, unnest(cells) as cell, unnest(range(len(cells))) as k from r), g as (select tbl, row, string_agg(cell, ' | ' order by k) as line from e where {GOOD} and not {BAD} group by 1, 2),
d as (select tbl, arg_min(line, row) as line, min(row) as o from g group by tbl, lower({_c('line')})), n as (select *, row_number() over (partition by tbl order by o) as i from d)
select tbl, string_agg('- ' || line, chr(10) order by i) as text from n where i <= 12 group by 1""")
def readable_tables(spark, root):
    """What can be read of noisy tables."""
    return ce.readable_text(ROWS.df(spark), ["tbl"], "row", "cells")


@query(f"""{_R}, e as (select tbl, row, coalesce(unnest(cells), '') as cell, len(cells) as w from r), s as (select tbl, count(distinct row) as n_rows, max(w) as n_columns, count(*) as n_cells, count(*) filter (cell <> '') as n_filled, sum(length(cell)) as n_chars from e group by 1)
select tbl, case when n_rows <= 1 or n_columns <= 1 or n_filled / n_cells < 0.3 or n_chars / n_cells < 2 then 'layout_table' when n_cells < 4 then 'too_small' when n_cells > 50 then 'truncate' else 'accept' end as gate from s""")
def table_gate_reasons(spark, root):
    each = ROWS.df(spark).select("tbl", "row", F.size("cells").alias("w"), F.explode("cells").alias("c")).withColumn("c", F.coalesce("c", F.lit("")))
    s = each.groupBy("tbl").agg(F.countDistinct("row").alias("n_rows"), F.max("w").alias("n_columns"), F.count("*").alias("n_cells"), F.sum((F.col("c") != "").cast("int")).alias("n_filled"), F.sum(F.length("c")).alias("n_chars"))
    return s.select("tbl", ce.gate(s, most=50).alias("gate"))


HTML = Literal("id int, html string", [
    (1, "<table><tr><th rowspan=2>Name</th><th colspan=2>Cost</th></tr><tr><td>2024</td><td>2025</td></tr><tr><td>Pen</td><td>1</td><td>2</td></tr></table>"),
    (2, "<table><tr><td rowspan=2>Band</td><td>Width</td></tr><tr><td>5</td></tr></table>"),
    (3, "<table><tr><td colspan='2'>Group</td><td rowspan='2'>A label of more than forty characters stands in this cell</td></tr><tr><td>a</td><td>b</td></tr></table>"),
    (4, "<table><tr><td>a</td><td>a</td><td></td></tr><tr><td></td></tr><tr><td>&nbsp;</td></tr><tr><td> </td></tr><tr><td>x &amp; y</td></tr></table>"),
    (5, "<table><tr><td colspan=3>A whole row that was read as one cell, of forty characters</td></tr><tr><td colspan=2>short</td><td>1 | 2</td></tr></table>"),
    (6, None), (7, ""), (8, "<table><tr><td colspan=2 rowspan=2>g</td><td>h</td></tr><tr><td>i</td><td>j</td></tr></table>"),
])


@query("""select * from (values (1, 2, 'Name,Cost－2024,Cost－2025'), (2, 1, 'Band,Width'), (3, 1, 'Group,Group(2),A label of more than forty characters stands in this cell'), (4, 1, 'a,a(2),'), (5, 1, 'A whole row that was read as one cell, of forty characters,A whole row that was read as one cell, of forty characters(2),A whole row that was read as one cell, of forty characters(3)'),
(6, 0, ''), (7, 0, ''), (8, 1, 'g,g(2),h')) as t(id, header_rows, names)""")
def table_headers(spark, root):
    """Rows of the header and names of the columns."""
    return ce.read_tables(HTML.df(spark), ["id"], "html").select("id", "header_rows", F.array_join("names", ",").alias("names"))


@query("""select * from (values (1, 'Name,Cost,/Name,2024,2025/Pen,1,2'), (2, 'Band,Width/Band,5'), (3, 'Group,,A label of more than forty characters stands in this cell/a,b,A label of more than forty characters stands in this cell'), (4, 'a,a,/,,/,,/,,/x & y,,'), (5, 'A whole row that was read as one cell, of forty characters,,/short,,1 | 2'), (6, ''), (7, ''), (8, 'g,,h,/g,,i,j')) as t(id, grid)""")
def table_grids(spark, root):
    """The logical grid with spans carried down."""
    return ce.read_tables(HTML.df(spark), ["id"], "html").select("id", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), "/").alias("grid"))


@query(f"""with {HTML.cte("h")} select id, case when id = 4 then '<table><tr><td>a</td><td>a</td><td></td></tr><!-- 3 empty rows --><tr><td>x &amp; y</td></tr></table>' else coalesce(html, '') end as folded from h""")
def folded_tables(spark, root):
    """More than two empty rows in a line become a comment."""
    return ce.read_tables(HTML.df(spark), ["id"], "html").select("id", "folded")


@query("""select * from (values (1, 0, 0, 'Name', 2, 1), (1, 0, 1, 'Cost', 1, 2), (1, 1, 1, '2024', 1, 1), (1, 1, 2, '2025', 1, 1), (1, 2, 0, 'Pen', 1, 1), (1, 2, 1, '1', 1, 1), (1, 2, 2, '2', 1, 1), (2, 0, 0, 'Band', 2, 1), (2, 0, 1, 'Width', 1, 1), (2, 1, 1, '5', 1, 1), (8, 0, 0, 'g', 2, 2), (8, 0, 2, 'h', 1, 1), (8, 1, 2, 'i', 1, 1), (8, 1, 3, 'j', 1, 1)) as t(id, row, "column", text, rowspan, colspan)""")
def literal_table_cells(spark, root):
    """Physical cells with their logical columns."""
    return tb.html_cells(HTML.df(spark).where("id in (1, 2, 6, 7, 8)"), ["id"], "html").drop("header")


@query(r"""select * from (values (2, '| Band | Width |' || chr(10) || '| 5 |'), (5, '| A whole row that was read as one cell, of forty characters |' || chr(10) || '| short | 1 \| 2 |')) as t(id, markdown)""")
def literal_table_markdown(spark, root):
    return tb.to_markdown(tb.html_cells(HTML.df(spark).where("id in (2, 5)"), ["id"], "html"), ["id"], "row")


@query("""select * from (values (1, '- Row 0: Column 0 (spans 2 rows): Name; Column 1-2: Cost' || chr(10) || '- Row 1: Column 1: 2024; Column 2: 2025' || chr(10) || '- Row 2: Column 0: Pen; Column 1: 1; Column 2: 2'), (8, '- Row 0: Column 0-1 (spans 2 rows): g; Column 2: h' || chr(10) || '- Row 1: Column 2: i; Column 3: j')) as t(id, text)""")
def source_grid_text(spark, root):
    return ce.grid_text(tb.html_cells(HTML.df(spark).where("id in (1, 8)"), ["id"], "html"), ["id"])


@query("select * from (values (5, 0, 0, 58)) as t(id, row, \"column\", n_chars)")
def wide_cells(spark, root):
    """Cells over two columns or more that hold more than a label."""
    c = tb.html_cells(HTML.df(spark), ["id"], "html")
    return c.where("colspan >= 2 and length(text) >= 40").select("id", "row", "column", F.length("text").alias("n_chars"))


TITLES = Literal("id int, caption string, nearby string, document string", [(1, "Prices of 2025", None, "Store"), (2, "Table 3", "Stock", "Store"), (3, "", " ", " Store "), (4, None, "表格 2", None), (5, None, None, None)])


@query("select * from (values (1, 'Prices of 2025'), (2, 'Stock'), (3, 'Store #3'), (4, '#4'), (5, '#5')) as t(id, title)")
def table_titles(spark, root):
    return TITLES.df(spark).select("id", ce.title(F.col("caption"), F.col("nearby"), F.col("document"), F.col("id")).alias("title"))


REPEATED = Literal("tbl string, pos int, name string", [("a", 0, "x"), ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 0, "x"), ("b", 1, "")])


@query(f"with {REPEATED.cte('r')} select tbl, pos, case when row_number() over (partition by tbl, name order by pos) > 1 then name || '(' || row_number() over (partition by tbl, name order by pos) || ')' else name end as numbered from r")
def numbered_names(spark, root):
    return tb.number_repeats(REPEATED.df(spark), ["tbl"], "pos", "name").select("tbl", "pos", "numbered")


@query(f"""{_R}, g as (select tbl, count(distinct row) as n from r group by 1) select tbl, row_number() over (order by tbl)::int as place from g qualify row_number() over (order by tbl) <= 2""")
def table_budget(spark, root):
    """The first tables of a pass."""
    from pyspark.sql import Window

    g = ROWS.df(spark).select("tbl").distinct().withColumn("pass", F.lit(1))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("pass").orderBy("tbl"))).where("place <= 2").select("tbl", "place")


KINDS = Literal("tbl string, row int, cells array<string>", [
    *(("data", k, [f"item {k}", str(k * 10), f"{k} 元"]) for k in range(4)), *(("narrow", k, ["a", "1"]) for k in range(5)), *(("fill", k, ["申請人", "□ yes", f"{k}"]) for k in range(5)),
    ("form", 0, ["申請單位", "", ""]), ("form", 1, ["備註", "", ""]), ("form", 2, ["單位主管", "", "核准"]), ("form", 3, ["", "", ""]), ("form", 4, ["出差", "", None]), ("words", 0, ["a b", "c d", "e f"]), ("words", 1, ["g", "h", "i"]), ("words", 2, ["j", "k", "l"]), ("words", 3, ["m", "n", "o"]),
])


@query("select * from (values ('data', true, false), ('narrow', false, false), ('fill', false, false), ('form', false, true), ('words', true, false)) as t(tbl, reference, form)")
def table_kinds(spark, root):
    """Tables of data, and tables that are forms to be filled in."""
    k = KINDS.df(spark)
    return ce.is_reference(k, ["tbl"], "cells").join(ce.is_form_like(k, ["tbl"], "cells", ("申請", "備註", "單位主管", "核准", "出差")), "tbl")
