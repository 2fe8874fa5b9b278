"""Queries over literal pages: blocks, lines and boxes as a layout reader gives them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import geometry, graph
from pagemill.operators import layout as lo
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


_FIELDS = "doc string, block_id string, page_idx int, reading_order int, type string, text string, x0 int, y0 int, x1 int, y1 int, origin string"


def _rows() -> list[tuple]:
    """Five pages of one document with running heads, page numbers and a repeated notice, and a second of two pages."""
    out = []

    def add(doc: str, page: int, kind: str, text: str | None, x0: int, y0: int, x1: int, y1: int, origin: str | None = None) -> None:
        k = sum(r[0] == doc for r in out)
        out.append((doc, f"{doc}{k}", page, k, kind, text, x0, y0, x1, y1, origin))

    for page in range(5):
        add("a", page, "text", "Guide to badges" if page % 2 else "Guide  to badges", 100, 40, 400, 80)
        add("a", page, "text", f"The desk keeps the badge of visitor {page} until the evening.", 100, 200, 450, 300)
        add("a", page, "text", "This notice stands on every page.", 100, 500, 450, 540)
        add("a", page, "text", "ok" if page < 4 else "Order now: 20 % off", 550, 200, 900, 240)
        add("a", page, "text", str(page + 1), 480, 950, 520, 980)
    add("a", 4, "text", "www.badges.example", 550, 300, 900, 340)
    add("a", 4, "image", None, 550, 400, 900, 640)
    add("a", 4, "text", "Tel. 555 0100, subscribe today", 550, 700, 900, 740)
    add("b", 0, "text", "A cover line of the series", 200, 30, 700, 70, lo.FURNITURE)
    add("b", 0, "image", None, 0, 0, 1000, 990)
    add("b", 0, "text", "7", 480, 960, 520, 985, lo.FURNITURE)
    add("b", 1, "table", "item price pen 3 ink 40", 100, 200, 800, 600)
    add("b", 1, "text", "Table 2: prices of the store", 100, 150, 500, 180)
    add("b", 1, "text", "a remnant", 100, 610, 200, 640, lo.REMNANT)
    add("b", 1, "text", "Guide to badges", 100, 300, 400, 340)
    add("b", 1, "text", None, 0, 0, 0, 0)
    return out


BLOCKS = Literal(_FIELDS, _rows())
PAGES = Literal("doc string, page_idx int, source_text_chars int", [("a", k, 200) for k in range(5)] + [("b", 0, 3), ("b", 1, None), ("b", 2, 0)])
_B = "with " + BLOCKS.cte("b")
_SPACE = r"[ \t\n\r\f\x0B\x{A0}\x{3000}]+"
_FORM = f"regexp_replace(text, '{_SPACE}', '', 'g')"
_NUMBER = "'^[-–—]?[0-9]{1,4}[-–—]?$'"


@query(f"{_B} select doc, block_id, coalesce(origin = 'page_furniture', false) as furniture, coalesce(origin = 'promotional_insert', false) as insert_, coalesce(origin = 'merged_table_remnant', false) as remnant, coalesce(origin in ('page_furniture', 'promotional_insert'), false) as non_content, coalesce(y1 <= 140 or y0 >= 900, false) as margin from b")
def block_filters(spark, root):
    """The tags of blocks, the delivery filter and the margin band."""
    return BLOCKS.df(spark).select("doc", "block_id", lo.is_furniture().alias("furniture"), lo.is_insert().alias("insert_"), lo.is_remnant().alias("remnant"), lo.is_non_content().alias("non_content"), lo.in_margin().alias("margin"))


@query(f"{_B} select doc, {_FORM} as form, count(distinct page_idx) as n_pages from b where type = 'text' and {_FORM} <> '' group by 1, 2")
def page_texts(spark, root):
    return lo.pages_by_text(BLOCKS.df(spark))


@query(f"""{_B}, n as (select doc, {_FORM} as form, count(distinct page_idx) as n from b where type = 'text' group by 1, 2)
select b.doc, b.block_id, case when origin = 'page_furniture' and {_FORM} <> '' and not regexp_matches({_FORM}, {_NUMBER}) and coalesce(n.n, 0) < 2 then null else origin end as origin from b left join n on n.doc = b.doc and n.form = {_FORM} where b.origin is not null""")
def released_furniture(spark, root):
    """Furniture that stands on one page only is content again."""
    tagged = BLOCKS.df(spark).where("origin is not null").select("block_id")
    return lo.release_single_furniture(BLOCKS.df(spark)).join(tagged, "block_id", "left_semi").select("doc", "block_id", "origin")


@query(f"""{_B}, c as (select *, {_FORM} as form from b where type = 'text' and origin is distinct from 'page_furniture' and (y1 <= 140 or y0 >= 900) and length({_FORM}) between 1 and 40),
r as (select doc, form from c group by 1, 2 having count(distinct page_idx) >= 2), m as (select doc from c where regexp_matches(form, {_NUMBER}) group by 1 having count(distinct page_idx) >= 2)
select doc, block_id from b where origin = 'page_furniture' union select doc, block_id from c where (doc, form) in (select doc, form from r) or (regexp_matches(form, {_NUMBER}) and doc in (select doc from m))""")
def margin_furniture(spark, root):
    """Running heads and page numbers by repetition in the margin."""
    return lo.tag_furniture(BLOCKS.df(spark)).where(lo.is_furniture()).select("doc", "block_id")


@query(f"""{_B}, f as (select *, replace(replace(trim(text, ' '), ' ', ''), chr(10), '') as form from b), s as (select doc, form, min(reading_order) as first from f where length(form) >= 4 group by 1, 2 having count(distinct page_idx) >= 3)
select f.doc, f.block_id from f left join s on s.doc = f.doc and s.form = f.form where s.first is null or f.reading_order <= s.first""")
def cross_page_dedup(spark, root):
    """The first occurrence of what repeats on three pages or more."""
    return lo.drop_repeats(BLOCKS.df(spark)).select("doc", "block_id")


SUPPLEMENTS = Literal("doc string, block_id string, page_idx int, y0 int", [("a", "s1", 0, 210), ("a", "s2", 0, 10), ("a", "s3", 4, 320), ("a", "s4", 4, 999), ("b", "s5", 7, 5), ("a", "s6", 0, 205)])


@query(f"""{_B}, {SUPPLEMENTS.cte("s")}, a as (select s.doc, s.block_id, s.page_idx, s.y0, coalesce(max(b.reading_order) filter (b.y0 <= s.y0), -1) as anchor from s left join b on b.doc = s.doc and b.page_idx = s.page_idx group by 1, 2, 3, 4),
u as (select doc, block_id, page_idx, reading_order as anchor, 0 as after, 0 as y from b union all select doc, block_id, page_idx, anchor, 1, y0 from a)
select doc, (row_number() over (partition by doc order by page_idx, anchor, after, y, block_id) - 1)::int as reading_order, block_id from u""")
def supplement_order(spark, root):
    """As-of join in list order: each supplement after the last block that starts at or above it."""
    return lo.place_supplements(BLOCKS.df(spark), SUPPLEMENTS.df(spark))


FRAGMENTS = Literal("doc string, fragment_id string, page_idx int, text string, x0 int, y0 int, x1 int, y1 int", [
    ("a", "f1", 1, "The desk keeps the badge of visitor 2", 0, 0, 10, 10), ("a", "f2", 1, "visitor 4 until the evening", 0, 0, 10, 10), ("a", "f3", 2, "nothing of this is anywhere", 0, 0, 10, 10), ("a", "f4", 2, "odd order words", 110, 210, 440, 290),
    ("a", "f5", 3, "ab", 0, 0, 10, 10), ("a", "f6", 3, "The desk keeps the badge for the visitors until evening", 0, 0, 10, 10), ("b", "f7", 1, "pen 3 ink 40", 0, 0, 0, 0), ("b", "f8", 4, "pen 3 ink 40", 5, 5, 9, 9),
])
_COVER = r"regexp_replace({}, '[ \t\n\r\f\x0B\x{{A0}}\x{{3000}}\\]+', '', 'g')"


@query(f"""{_B}, {FRAGMENTS.cte("f")}, g as (select *, {_COVER.format('text')} as form from f), t as (select *, {_COVER.format('text')} as form from b where text is not null),
c as (select g.doc, g.fragment_id from g join b on b.doc = g.doc and b.page_idx = g.page_idx and (g.x1 - g.x0) * (g.y1 - g.y0) > 0 and greatest(0, least(g.x1, b.x1) - greatest(g.x0, b.x0)) * greatest(0, least(g.y1, b.y1) - greatest(g.y0, b.y0)) / ((g.x1 - g.x0) * (g.y1 - g.y0))::double >= 0.9
 union select g.doc, g.fragment_id from g join t on t.doc = g.doc and abs(t.page_idx - g.page_idx) <= 1 where contains(t.form, g.form) or (length(g.form) >= 10 and list_sum(list_transform(range(1, length(g.form) - 2), lambda i: contains(t.form, substring(g.form, i, 4))::int)) / (length(g.form) - 3) > 0.6))
select doc, fragment_id from g where length(form) >= 4 and (doc, fragment_id) not in (select doc, fragment_id from c)""")
def uncovered_fragments(spark, root):
    """Fragments that no block of their or the neighbouring pages carries."""
    return lo.uncovered(FRAGMENTS.df(spark), BLOCKS.df(spark)).select("doc", "fragment_id")


@query(f"""{_B}, {PAGES.cte("p")}, s as (select doc, page_idx, count(*) as n, count(*) filter (type = 'image') as images, coalesce(sum(length(trim(coalesce(text, ''), ' '))) filter (type <> 'image'), 0) as chars, max((x1 - x0) * (y1 - y0) / 1e6::double) filter (type = 'image') as area from b group by 1, 2)
select p.doc, p.page_idx, case when source_text_chars < 8 then s.n is not null else coalesce(images > 0 and (chars < 200 or area >= 0.85), false) end as scanned from p left join s on s.doc = p.doc and s.page_idx = p.page_idx""")
def scanned_pages(spark, root):
    return lo.scanned_pages(PAGES.df(spark), BLOCKS.df(spark))


@query(f"{_B} select doc, page_idx, count(*) as n_blocks, round(count(*) filter (type = 'text') / count(*), 4) as share, coalesce(sum(length(text)) filter (type = 'text'), 0)::bigint as n_chars from b group by 1, 2")
def page_text_coverage(spark, root):
    return lo.text_share(BLOCKS.df(spark))


@query(f"""{_B}, m as (select a.doc, a.block_id as figure_id, l.block_id as label_id, greatest(0, l.x0 - a.x1, a.x0 - l.x1, l.y0 - a.y1, a.y0 - l.y1) as gap from b a join b l on a.doc = l.doc and a.page_idx = l.page_idx and a.type in ('image', 'table') and l.type = 'text' and l.text is not null)
select doc, figure_id, arg_min(label_id, (gap, label_id)) as label_id from m where gap <= 100 group by 1, 2""")
def figure_labels(spark, root):
    """Nearest neighbour on the page."""
    b = BLOCKS.df(spark)
    return lo.nearest_labels(b.where("type in ('image', 'table')"), b.where("type = 'text' and text is not null"))


LINES = Literal("doc string, page_idx int, line_no int, text string", [
    ("a", 0, 0, "The desk keeps"), ("a", 0, 1, "a line that was lost"), ("a", 0, 2, "ok."), ("a", 0, 3, "and goes on here"), ("a", 0, 4, "until the evening"), ("a", 0, 5, "hm"), ("a", 0, 6, "lost again, twice"), ("a", 0, 7, "--"), ("b", 9, 0, "a page without any block"), ("b", 1, 0, "ink 40"), ("b", 1, 1, "pen ink"),
])
_WORDS = r"regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"""{_B}, {LINES.cte("l")}, k as (select l.*, case when length({_WORDS.format('l.text')}) < 6 then 'short' when exists (select 1 from b where b.doc = l.doc and b.page_idx = l.page_idx and b.text is not null and contains({_WORDS.format('b.text')}, {_WORDS.format('l.text')})) then 'held' else 'lost' end as kind from l),
i as (select *, sum((kind = 'held')::int) over (partition by doc, page_idx order by line_no) as island from k), r as (select *, max((kind = 'lost')::int) over (partition by doc, page_idx, island order by line_no) as began from i)
select doc, page_idx, min(line_no) as first, max(line_no) as last, count(*) as n, string_agg(text, ' ' order by line_no) as text from r where began = 1 and kind <> 'held' group by doc, page_idx, island""")
def lines_missing_runs(spark, root):
    return lo.missing_runs(LINES.df(spark), BLOCKS.df(spark).where("text is not null"))


# Families of patterns that speak for an insert.
PROMOTION = {"offer": "[0-9]+ ?%", "address": "www[.]|https?://", "telephone": "[Tt]el[.]|電話", "subscription": "[Ss]ubscribe|訂閱"}


@query(f"""{_B}, l as (select b.* from b join (select doc, max(page_idx) as last from b group by 1) m on m.doc = b.doc and b.page_idx = m.last where b.x0 >= 500),
s as (select doc from l group by doc having count(*) >= 4 and max(coalesce(regexp_matches(text, '[0-9]+ ?%'), false)::int) + max(coalesce(regexp_matches(text, 'www[.]|https?://'), false)::int) + max(coalesce(regexp_matches(text, '[Tt]el[.]|電話'), false)::int) + max(coalesce(regexp_matches(text, '[Ss]ubscribe|訂閱'), false)::int) >= 2)
select doc, block_id from l where doc in (select doc from s)""")
def promotional_inserts(spark, root):
    return lo.promotional(BLOCKS.df(spark), PROMOTION).where(lo.is_insert()).select("doc", "block_id")


BOXES = Literal("id int, box array<int>, width int, height int", [(1, [0, 0, 50, 100], 100, 200), (2, [10, 20, 60, 20, 60, 90, 10, 90], 100, 100), (3, [10, 20], 100, 100), (4, [10, 20, 300, 90], 100, 100), (5, [10, 20, 10, 90], 100, 100), (6, None, 100, 100), (7, [0, 0, 1, 1], 0, 10), (8, [1, 1, 2, 2], 9000, 9000), (9, [1, 1, 20, 30], 1600, 1600)])


@query(f"""with {BOXES.cte("b")}, c as (select id, width::double as w, height::double as h, case len(box) when 8 then least(box[1], box[3], box[5], box[7]) when 4 then box[1] end as a, case len(box) when 8 then least(box[2], box[4], box[6], box[8]) when 4 then box[2] end as b,
 case len(box) when 8 then greatest(box[1], box[3], box[5], box[7]) when 4 then box[3] end as c, case len(box) when 8 then greatest(box[2], box[4], box[6], box[8]) when 4 then box[4] end as d from b),
s as (select *, round_even(a * 1000 / w, 0)::int as p, round_even(b * 1000 / h, 0)::int as q, round_even(c * 1000 / w, 0)::int as r, round_even(d * 1000 / h, 0)::int as t from c where w > 0 and h > 0 and a >= 0 and a < c and c <= w and b >= 0 and b < d and d <= h)
select c.id, case when p < r and q < t then [p, q, r, t] end as box from c left join s on s.id = c.id""")
def normalised_boxes(spark, root):
    return BOXES.df(spark).select("id", lo.normalised_box("box", "width", "height").alias("box"))


NOTES = Literal("doc string, pos int, source string, text string", [("a", 1, "p1", "one"), ("a", 2, "p1", "two"), ("a", 3, "p2", "three"), ("a", 4, "p1", "four"), ("a", 5, None, "five"), ("a", 6, None, None), ("b", 9, "p1", "one")])


@query(f"""with {NOTES.cte("n")}, c as (select *, coalesce((source is distinct from lag(source) over w)::int, 1) + 0 as new_, row_number() over w as i from n window w as (partition by doc order by pos)),
p as (select *, sum(case when i = 1 then 1 else new_ end) over (partition by doc order by pos) as part from c)
select doc, min(pos) as first, max(pos) as last, any_value(source) as source, string_agg(coalesce(text, ''), chr(10) order by pos) as text from p group by doc, part""")
def compact_excerpts(spark, root):
    """Neighbouring lines of one source as one excerpt."""
    return lo.excerpts(NOTES.df(spark), ["doc"], "pos", "source", "text")


@query(f"""with {NOTES.cte("n")}, m as (select doc, pos, '{{' || rtrim(coalesce('"source":"' || source || '",', '') || coalesce('"text":"' || text || '"', ''), ',') || '}}' as j from n)
select doc, sha256(string_agg(j, chr(10) order by pos)) as digest from m group by doc""")
def scope_digests(spark, root):
    """A hash of what was reviewed that renumbering doesn't change."""
    return lo.digest(NOTES.df(spark).withColumn("pos", F.col("pos") * 10), ["doc"], "pos", ["source", "text"])


REGIONS = Literal("page string, pos int, type string, x0 int, y0 int, x1 int, y1 int", [
    ("p", 0, "text", 0, 0, 100, 100), ("p", 1, "table", 0, 0, 100, 99), ("p", 2, "text", 500, 0, 600, 50), ("p", 3, "text", 500, 0, 600, 50), ("p", 4, "image", 500, 0, 600, 51), ("p", 5, "unknown", 500, 0, 601, 50), ("p", 6, "text", 0, 400, 100, 500), ("p", 7, "text", 5, 400, 105, 500), ("q", 0, "text", 0, 0, 100, 100), ("q", 1, "text", 7, 7, 7, 7), ("q", 2, "text", 7, 7, 7, 7),
])


@query(f"""with {REGIONS.cte("r")}, p as (select a.page, a.pos as first, b.pos as second, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as shared, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as both_ from r a join r b on a.page = b.page and a.pos < b.pos)
select page, first, second, round(shared::double / (both_ - shared), 6) as iou from p where both_ > shared and shared::double / (both_ - shared) > 0.6""")
def literal_overlaps(spark, root):
    """Boxes that cover each other by more than 0.6."""
    return geometry.overlapping(REGIONS.df(spark), ["page"], "pos", 0.6).withColumn("iou", F.round("iou", 6))


@query("select * from (values ('p', 1), ('p', 4), ('p', 6), ('p', 7), ('q', 0), ('q', 1), ('q', 2)) as t(page, pos)")
def literal_region_dedup(spark, root):
    """Greedy in reading order: 1 takes the place of 0 by priority, 4 that of 2, which 3 had not; 5 is beaten by 4; 6 and 7 cover each other by 0.905 no further."""
    return geometry.dedup_regions(REGIONS.df(spark), ["page"], "pos", 0.91).select("page", "pos")


CHART = Literal("chart string, id int, label string, x0 int, y0 int, x1 int, y1 int, level int", [
    ("c", 1, "Board", 300, 0, 500, 50, 0), ("c", 2, "Finance", 0, 100, 200, 150, 1), ("c", 3, "Operations", 320, 100, 480, 150, 1), ("c", 4, "Stores", 300, 200, 420, 250, 2), ("c", 5, "Fleet", 440, 200, 560, 250, 2), ("c", 6, "Night shift", 430, 300, 570, 350, 3), ("c", 7, "Audit", 800, 400, 900, 450, 5), ("d", 1, "Alone", 0, 0, 10, 10, 0),
])


@query(f"""with {CHART.cte("n")}, pg as (select chart, max(x1) as width, max(y1) as height from n group by 1),
s as (select a.chart, a.id as child, b.id as parent, round((case when least(a.x1, b.x1) <= greatest(a.x0, b.x0) then 0::double else (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0)::double end * 0.4::double
 + (1::double - abs((a.y0 + a.y1) / 2::double - (b.y0 + b.y1) / 2::double) / height) * 0.3::double + (1::double - least(1::double, abs((a.x0 + a.x1) / 2::double - (b.x0 + b.x1) / 2::double) / (width * 0.3::double))) * 0.3::double) / (a.level - b.level), 6) as score
 from n a join pg on pg.chart = a.chart join n b on a.chart = b.chart and b.level < a.level and a.level - b.level <= 3)
select chart, child, parent, score, (row_number() over (partition by chart, child order by score desc, parent))::int as place from s""")
def chart_parents(spark, root):
    """Scored parent candidates of a literal chart."""
    return graph.parents(CHART.df(spark), ["chart"], 99)


_TOP = """, best as (select chart, child, arg_max(parent, (score, -parent)) as parent, max(score) as score from s group by 1, 2)"""


@query(SQL["chart_parents"].split("\nselect chart, child, parent, score, (row")[0] + _TOP + """ select b.chart, b.child, b.parent, case when b.score < 0.7 then true else false end as needs_review from best b""")
def chart_edges(spark, root):
    """The best parent of each node, and whether it has to be looked at."""
    return graph.edges(CHART.df(spark), ["chart"]).select("chart", "child", "parent", "needs_review")


@query(SQL["chart_parents"].split("\nselect chart, child, parent, score, (row")[0].replace("with ", "with recursive ", 1) + _TOP + """, w(chart, id, top, path, depth) as (select chart, id, id, label, 0 from n union all select w.chart, w.id, b.parent, n.label || ' > ' || w.path, w.depth + 1 from w join best b on b.chart = w.chart and b.child = w.top join n on n.chart = b.chart and n.id = b.parent)
select chart, id, arg_max(path, depth) as path, max(depth)::int as depth from w group by 1, 2""")
def chart_paths(spark, root):
    """The names from the root to every node."""
    nodes = CHART.df(spark)
    return graph.paths(graph.edges(nodes, ["chart"]).select("chart", "child", "parent"), nodes.select("chart", "id", F.col("label").alias("name")), ["chart"]).select("chart", "id", "path", "depth")


EDGES = Literal("chart string, child int, parent int", [("c", 2, 1), ("c", 3, 1), ("c", 4, 3), ("c", 5, 6), ("c", 6, 7), ("c", 7, 5), ("c", 8, 5), ("d", 1, 1), ("d", 3, 2)])
NODES = Literal("chart string, id int, category string, confidence double", [*(("c", k, "unit" if k % 2 else "role", k / 10) for k in range(1, 10)), ("d", 1, None, None), ("d", 2, "role", 0.5), ("d", 3, "role", 0.25)])


@query("select * from (values ('c', [5, 6, 7]), ('d', [1])) as t(chart, members)")
def chart_cycles(spark, root):
    """Every cycle once, as its sorted members."""
    return graph.cycles(EDGES.df(spark), ["chart"])


@query("select chart, id, level::int as level from (values ('c', 1, 0), ('c', 2, 1), ('c', 3, 1), ('c', 4, 2), ('c', 5, 99), ('c', 6, 99), ('c', 7, 99), ('c', 8, 99), ('c', 9, 0), ('d', 1, 99), ('d', 2, 0), ('d', 3, 1)) as t(chart, id, level)")
def chart_levels(spark, root):
    """Levels by the edges: breadth first from the nodes without a parent; what no root reaches has 99."""
    return graph.levels_by_edges(NODES.df(spark).select("chart", "id"), EDGES.df(spark), ["chart"])


@query(f"""with {NODES.cte("n")}, {EDGES.cte("e")}, d as (select chart, parent, count(*) as out from e group by 1, 2),
s as (select n.chart, count(*) as n_nodes, count(*) filter (not exists (select 1 from e where e.chart = n.chart and e.child = n.id)) as n_roots, count(*) filter (category is null) as n_unknown from n group by 1)
select s.chart, n_nodes, n_roots, (select count(*) from e where e.chart = s.chart) as n_edges, round(coalesce((select max(out) from d where d.chart = s.chart), 0) / n_nodes, 4) as busiest, round(n_unknown / n_nodes, 4) as unknown from s""")
def chart_validation(spark, root):
    return graph.validation(NODES.df(spark), EDGES.df(spark), ["chart"])


@query(f"""with {NODES.cte("n")} select chart, category, list(id order by id) as members, min(confidence) as confidence from n where category is not null group by 1, 2""")
def chart_groups(spark, root):
    return graph.groups(NODES.df(spark), ["chart"])


UNITS = Literal("id int, label string, x0 double, y0 double, x1 double, y1 double, parent string", [
    (1, "董事會", 300, 10, 500, 60, "董事長"), (2, "董事長", 300, 100, 500, 150, "監察人"), (3, "人事評議委員會", 0, 100, 100, 150, "院長"), (4, "第一研究所", 0, 300, 100, 350, "院長"), (5, "資訊中心", 200, 300, 300, 350, "第一研究所"), (6, "稽核室", 300, 300, 400, 350, "院長"), (7, "3-1", 400, 500, 420, 520, None), (8, "頁碼", 950, 970, 990, 990, None), (9, "A", 500, 500, 520, 520, None), (10, "頁碼", 0.95, 0.97, 0.99, 0.99, None), (11, "訪客", 400, 500, 500, 520, None),
])


@query("""select id, hint, category, c::double as confidence, relation, noise from (values (1, 'governance', 'governance', 0.95, 'oversight', false), (2, 'management', 'management', 0.9, 'reports_to', false), (3, 'committee', 'committee', 0.9, 'advisory', false), (4, 'department', 'department', 0.85, 'reports_to', false), (5, 'taskforce', 'taskforce', 0.75, 'contains', false), (6, 'department', 'unknown', 0.6, 'unknown', false),
(7, 'unknown', 'unknown', 0.3, null, true), (8, 'unknown', 'unknown', 0.3, null, true), (9, 'unknown', 'unknown', 0.3, null, true), (10, 'unknown', 'unknown', 0.3, null, true), (11, 'unknown', 'unknown', 0.3, null, false)) as t(id, hint, category, c, relation, noise)""")
def chart_units(spark, root):
    """Categories of units by their names, the relation to their parents, and noise."""
    u = UNITS.df(spark).select("id", graph.category(F.col("label")).alias("c"), graph.category(F.col("parent")).alias("p"), "parent", graph.is_noise(F.col("label"), *(F.col(k) for k in ("x0", "y0", "x1", "y1"))).alias("noise"))
    return u.select("id", "c.hint", "c.category", "c.confidence", F.when(F.col("parent").isNotNull(), graph.relation(F.col("c.category"), F.col("p.category"))).alias("relation"), "noise")


INDENTED = Literal("id int, text string", [(1, "# Units\n- **Board**\n    - Director（隸屬：Board）\n    - Finance (two desks)\n        - Cash\n    - Stores\n# Staff\n- Pool\ntext\n  * Night shift\n- x"), (2, ""), (3, "- 監察人（監督：董事會）")])


@query("select * from (values (1, 'Director', 'Board', 'reports_to'), (1, 'Finance', 'Board', 'reports_to'), (1, 'Cash', 'Finance', 'reports_to'), (1, 'Stores', 'Board', 'reports_to'), (1, 'Night shift', 'Pool', 'reports_to'), (3, '監察人', '董事會', 'oversight')) as t(id, child, parent, relation)")
def indented_edges(spark, root):
    """Edges of charts that are written as lists."""
    from pyspark.sql import types as T

    from pagemill.functions.lines import mapped

    split = mapped(lambda x: ["\x01".join(e) for e in graph.indent_edges(x)], T.ArrayType(T.StringType()))
    e = INDENTED.df(spark).select("id", F.explode(split("text")).alias("e")).select("id", F.split("e", "\x01").alias("e"))
    return e.select("id", *(F.col("e")[k].alias(n) for k, n in enumerate(("child", "parent", "relation"))))


@query("select * from (values ('c', '- Audit' || chr(10) || '- Board' || chr(10) || '  - Finance' || chr(10) || '  - Operations' || chr(10) || '    - Fleet' || chr(10) || '      - Night shift' || chr(10) || '    - Stores'), ('d', '- Alone')) as t(chart, markdown)")
def chart_markdown(spark, root):
    """Charts as indented lists (of two pages: what hangs under no node of its own is a root)."""
    nodes = CHART.df(spark)
    alone = nodes.where("label = 'Audit'").select("chart", "id", F.col("label").alias("path"), F.lit(0).alias("depth"))
    return graph.markdown(chart_paths(spark, root).join(alone.select("chart", "id"), ["chart", "id"], "left_anti").unionByName(alone), ["chart"])


HEADINGS = Literal("doc string, heading string, head string, pages int", [("a", "至球戦略情勢", "全球戰略情勢", 3), ("a", "至球戦略情勢", "戰略季刊", 9), ("a", "年報", "年報", 4), ("b", "Guide to bagdes", "Guide to badges", 2), ("b", "Guide to bagdes", "Guide of the year", 5)])


@query("select * from (values ('b', 'Guide to bagdes', 'Guide to badges')) as t(doc, heading, head)")
def repaired_headings(spark, root):
    """A heading takes the running head that agrees with it in six characters or more and three quarters of its own; of several the one on most pages."""
    from pyspark.sql import types as T

    from pagemill.functions.lines import matched, mapped

    m = HEADINGS.df(spark).withColumn("n", mapped(matched, T.IntegerType())("heading", "head")).withColumn("share", F.col("n") / F.length("heading"))
    good = m.where("n >= 6 and share >= 0.75 and heading <> head")
    return good.groupBy("doc", "heading").agg(F.max_by("head", F.struct("pages", "share", F.length("head"))).alias("head"))


_DUMP = "".join(f"cell {k} holds the number {k * 7} and " for k in range(6))
TABLES = Literal("doc string, page_idx int, body string, notes string", [("a", 1, f"<table><tr><td>{_DUMP}</td></tr><tr><td>Pen box</td></tr></table>", "Source: the store of the office, 2025"), ("b", 5, "<td>x</td>", None)])
ASKED = Literal("doc string, fragment_id string, page_idx int, text string", [
    ("a", "t1", 1, "Pen  box"), ("a", "t2", 2, "the store of the office"), ("a", "t3", 4, "Pen box"), ("a", "t4", 0, _DUMP[:150] + "zz"), ("a", "t5", 1, "Pen"), ("a", "t6", 1, "Source: the shop of the office, 2024"), ("a", "t7", 1, "q" * 120), ("b", "t8", 5, "not in it"), ("a", "t9", 1, None),
])


@query("select * from (values ('a', 't1'), ('a', 't2'), ('a', 't4')) as t(doc, fragment_id)")
def fragments_in_tables(spark, root):
    """Fragments that a table or its notes hold."""
    return lo.in_tables(ASKED.df(spark), TABLES.df(spark))


NOTED = Literal("doc string, block_id string, reading_order int, type string, text string, origin string", [
    ("a", "k0", 0, "text", "備註 before", None), ("a", "k1", 1, "table", None, None), ("a", "k2", 2, "text", "a line", None), ("a", "k3", 3, "text", "註：first  note", None), ("a", "k4", 4, "text", "goes on", None), ("a", "k5", 5, "text", "7", lo.FURNITURE), ("a", "k6", 6, "text", "2. second", None), ("a", "k7", 7, "image", None, None),
    ("a", "k8", 8, "table", None, None), ("a", "k9", 9, "text", "註： first note goes on", None), ("a", "k10", 10, "text", "2.second", None), ("a", "k11", 11, "table", None, None), ("a", "k12", 12, "text", "no note", None), ("b", "k0", 0, "table", None, None), ("b", "k1", 1, "text", "一、x", None),
])


@query("select * from (values ('a', 'k1', '註：first note goes on' || chr(10) || '2. second'), ('b', 'k0', '一、x')) as t(doc, block_id, note)")
def adjacent_notes(spark, root):
    """Notes that follow tables, each once."""
    return lo.table_notes(NOTED.df(spark))
