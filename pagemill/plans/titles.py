"""Queries of titles over all documents, and of the block model over literal items."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import render
from pagemill.operators import titles as ti
from pagemill.plans.literal import Literal
from pagemill.plans.queries import LINES, _lines
from pagemill.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_SPACE = r"[ \t\n\r\f\x0B\x{A0}\x{3000}]+"
CLEAN = "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({}, '^[ ]*(?:#{{1,6}}[ ]+|[-*][ ]+)?(?:TABLE:)?', ''), '[*_`]+', '', 'g'), '[ \\t\\r\\x{{A0}}\\x{{3000}}]+', ' ', 'g'), ' '), '^[#:： ]+|[#:： ]+$', '', 'g')"
FORM = f"regexp_replace(title, '{_SPACE}', '', 'g')"
_ENGLISH = "(?:^|[^a-z])(?:" + "|".join(ti.ENGLISH) + ")s?(?:[^a-z]|$)"
MEANS = f"(not regexp_matches(title, '{ti.HAN}') and len(regexp_extract_all(title, '[A-Za-z]{{3,}}')) >= 3 and regexp_matches(lower(title), '{_ENGLISH}'))"
_BAD = " or ".join(f"regexp_matches({FORM}, '{p}')" for p in ti.BAD)
UNRELIABLE = f"({FORM} = '' or lower({FORM}) in {ti.GENERIC} or {_BAD} or contains(title, ' > ') or (not regexp_matches({FORM}, '{ti.HAN}') and len(regexp_extract_all({FORM}, '[0-9]')) >= 3 and not {MEANS}) or (length({FORM}) > 45 and regexp_matches({FORM}, '[，,]')))"
ORG = f"(not regexp_matches({FORM}, '{ti.NAMES}') and regexp_matches({FORM}, '{ti.ORGANISATIONS}'))"
STEP = f"regexp_matches(title, '{ti.STEP}')"
CONTENTS = f"regexp_matches(title, '{ti.CONTENTS}')"
_TERMS = " + ".join(f"contains({FORM}, '{t}')::int" for t in ti.TERMS)
_HITS = " + ".join(f"regexp_matches(lower(title), '(?:^|[^a-z]){t}s?(?:[^a-z]|$)')::int" for t in ti.ENGLISH)
SCORE = f"""(({_TERMS}) * {ti.TERM} + starts_with({FORM}, '如何')::int * {ti.HOW_TO} + least({_HITS}, 3) * {ti.ENGLISH_TERM} + regexp_matches(lower(title), '{ti.PAIRS}')::int * {ti.PAIR} + regexp_matches(lower(title), '{ti.RETURNS}')::int * {ti.SENDER}
 + (length({FORM}) between 10 and 45)::int * {ti.LENGTH} + {ORG}::int * {ti.ORGANISATION} + regexp_matches({FORM}, '^(?:附件|附表)[一二三四五六七八九十0-9-]*$')::int * {ti.ANNEX})"""
CANDIDATES = f"{LINES}, t as (select doc_id, k, {CLEAN.format('line')} as title from lines where k < 180), c as (select doc_id, k, title, {SCORE} as score from t where length({FORM}) between 6 and 80 and not {STEP} and not {UNRELIABLE} and not {CONTENTS})"


@query(f"with {LINES}, t as (select distinct {CLEAN.format('line')} as title from lines where regexp_matches(line, '^[ ]*#{{1,6}} ')) select title, {STEP} as step, {ORG} as organisation, {MEANS} as english, {UNRELIABLE} as unreliable, ({SCORE})::int as score from t")
def heading_titles(spark, root):
    """All headings of the corpus as titles: what each is, and its score."""
    heads = _lines(spark, root).where(F.col("line").rlike("^[ ]*#{1,6} ")).select(ti.cleaned("line").alias("title")).distinct()
    t = F.col("title")
    return heads.select("title", ti.is_step(t).alias("step"), ti.is_organisation(tx.compact(t)).alias("organisation"), ti.is_meaningful_english(t).alias("english"), ti.is_unreliable(t).alias("unreliable"), ti.score(t).alias("score"))


@query(f"with {CANDIDATES} select doc_id, k::int as reading_order, title, score::int as score from c where score >= 20")
def title_candidates(spark, root):
    return ti.candidates(_lines(spark, root), ["doc_id"])


@query(f"""with {CANDIDATES}, b as (select doc_id, arg_max(title, (score, -k)) as best from c where score >= 20 group by 1), h as (select doc_id, k, {CLEAN.format('line')} as title from lines where regexp_matches(line, '^[ ]*#{{1,6}} ')),
g as (select doc_id, arg_min(title, k) as head from h where not {STEP} and not {UNRELIABLE} and not {CONTENTS} group by 1)
select d.doc_id, left(coalesce(best, head, nullif(replace(coalesce(d.doc_kind, ''), '_', ' '), ''), 'untitled'), 120) as title, case when best is not null then 'line' when head is not null then 'heading' when coalesce(d.doc_kind, '') <> '' then 'path' else 'none' end as origin from documents d left join b on b.doc_id = d.doc_id left join g on g.doc_id = d.doc_id""")
def inferred_titles(spark, root):
    """The title of every document: the best line, the first heading that may stand, or a name (here the kind takes the place of the path)."""
    d = table(spark, root, "documents").select("doc_id", F.coalesce("doc_kind", F.lit("")).alias("path"))
    return ti.inferred(d, _lines(spark, root), ["doc_id"], "path")


@query(f"""with {CANDIDATES}, b as (select doc_id, regexp_replace(arg_max(title, (score, -k)), '{_SPACE}', '', 'g') as best from c where score >= 20 group by 1)
select l.doc_id, count(*) as n_kept from lines l left join b on b.doc_id = l.doc_id where not coalesce(l.k <= 2 and regexp_replace({CLEAN.format('l.line')}, '{_SPACE}', '', 'g') = b.best and b.best <> '', false) group by 1""")
def body_lines(spark, root):
    """Lines without the title among the first three."""
    lines = _lines(spark, root)
    best = ti.candidates(lines, ["doc_id"]).groupBy("doc_id").agg(F.max_by("title", F.struct("score", -F.col("reading_order"))).alias("title"))
    return ti.without_title_lines(lines, best, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n_kept"))


ITEMS = Literal("doc string, page_idx int, reading_order int, type string, text string, text_level int, img_path string, img_caption array<string>, table_body string, code_body string, list_items array<string>, latex string", [
    ("a", 0, 0, "text", "Rules of use", 1, None, None, None, None, None, None), ("a", 0, 1, "text", " body ", 0, None, None, None, None, None, None), ("a", 0, 2, "list", None, None, None, None, None, None, ["one", "two"], None), ("a", 0, 3, "code", "x", None, None, None, None, "print(1)", None, None),
    ("a", 0, 4, "table", None, None, "t.png", None, "<table></table>", None, None, None), ("a", 1, 5, "table", None, None, "t.png", ["A", "", "chart"], None, None, None, None), ("a", 1, 6, "table", None, None, None, None, " ", None, None, None), ("a", 1, 7, "chart", None, None, "c.png", None, None, None, None, None),
    ("a", 1, 8, "equation", "E", None, None, None, None, None, None, "E=mc"), ("a", 1, 9, "header", "running", None, None, None, None, None, None, None), ("b", 0, 0, "hologram", "?", None, None, None, None, None, None, None), ("b", 0, 1, None, None, None, None, None, None, None, None, None),
])


@query("""select * from (values ('a', 0, 'text', null, 1, 'Rules of use'), ('a', 1, 'text', null, null, 'body'), ('a', 2, 'text', null, null, '- one' || chr(10) || '- two'), ('a', 3, 'text', null, null, 'print(1)'), ('a', 4, 'table', null, null, '<table></table>'), ('a', 5, 'image', null, null, 'A chart'), ('a', 6, 'unknown', null, null, ''), ('a', 7, 'image', null, null, ''), ('a', 8, 'equation', null, null, 'E=mc'), ('a', 9, 'text', 'page_furniture', null, 'running'), ('b', 0, 'unknown', null, null, '?'), ('b', 1, 'unknown', null, null, '')) as t(doc, reading_order, block_type, origin, level, body)""")
def block_payloads(spark, root):
    """Types, origins, heading levels and texts of layout items."""
    return render.payload(ITEMS.df(spark)).select("doc", "reading_order", "block_type", "origin", "level", "body")


@query("""select * from (values ('a', 0, 1), ('a', 1, 1), ('a', 2, 1), ('a', 3, 1), ('a', 4, 1)) as t(doc, reading_order, n)""")
def blocks_of_page(spark, root):
    """Blocks of a page; a block by its id and blocks by type are the same filter on other columns."""
    b = render.payload(ITEMS.df(spark))
    return b.where("doc = 'a' and page_idx = 0").groupBy("doc", "reading_order").agg(F.count("*").cast("int").alias("n"))


@query("""select * from (values ('a', '# Rules of use' || chr(10) || chr(10) || 'body' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || 'print(1)' || chr(10) || chr(10) || '<table></table>' || chr(10) || chr(10) || 'A chart' || chr(10) || chr(10) || '$$E=mc$$'), ('b', '?')) as t(doc, markdown)""")
def document_markdown(spark, root):
    """Documents as Markdown, furniture left out."""
    b = render.payload(ITEMS.df(spark)).where("origin is null")
    text = render.chunk_text(F.col("block_type"), F.col("body"), F.col("level"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return render.document_text(b.withColumn("t", text), "doc", ["page_idx", "reading_order"], "t")


@query(r"""with c as (select distinct run_id, chunk_id, metadata.heading as heading, metadata.heading_path as path, metadata.table_html as tables from chunks)
select run_id, chunk_id, regexp_replace(heading, '[0-9]', '#', 'g') as heading, array_to_string(list_transform(path, lambda x: regexp_replace(x, '[0-9]', '#', 'g')), '>') as path, regexp_replace(array_to_string(tables, ''), '[0-9]', '#', 'g') as tables from c where heading is not null""")
def scrubbed_metadata(spark, root):
    """A function over the heading, path and tables of every chunk's metadata: here all digits are hidden."""
    c = table(spark, root, "chunks").where("metadata.heading is not null").select("run_id", "chunk_id", render.scrubbed(F.col("metadata"), lambda x: F.regexp_replace(x, "[0-9]", "#")).alias("m"))
    return c.select("run_id", "chunk_id", "m.heading", F.array_join("m.heading_path", ">").alias("path"), F.array_join("m.table_html", "").alias("tables")).distinct()


ASSETS = Literal("doc string, asset_id string, page_idx int, kind string, retrieval_text string, caption string, decorative boolean, scanned boolean, form boolean, gate string", [
    ("a", "f1", 0, "image", "A chart of the badges of a year", "chart", False, False, False, None), ("a", "f2", 0, "image", "A chart of the  badges of a year", "chart", False, False, False, None), ("a", "f3", 0, "image", "", "A small icon", None, False, False, None), ("a", "f4", 0, "image", "short", None, False, False, False, None),
    ("a", "f5", 1, "table", "x", None, None, False, True, "accept"), ("a", "f6", 1, "table", "y", None, True, False, False, "truncate"), ("b", "f7", 0, "image", "page", "blurry", False, True, False, None), ("b", "f8", 0, "table", None, None, None, False, False, "layout_table"),
])


@query("select * from (values ('a', 'f1'), ('a', 'f5'), ('b', 'f7')) as t(doc, asset_id)")
def exported_assets(spark, root):
    return render.exported(ASSETS.df(spark)).select("doc", "asset_id")


@query("select * from (values ('f1', 'figure_caption', false), ('f2', 'figure_caption', false), ('f3', 'figure_caption', true), ('f4', 'figure_caption', false), ('f5', 'form_asset', false), ('f6', 'table_summary', false), ('f7', 'page_form', false), ('f8', null, false)) as t(asset_id, kind, icon)")
def enrichment_kinds(spark, root):
    """Which enrichment a block asks for, and whether it is an icon of no value."""
    a = ASSETS.df(spark)
    return a.select("asset_id", render.needs(F.col("kind"), F.col("form"), F.col("scanned"), F.col("gate")).alias("need"), render.is_low_value_icon(F.col("retrieval_text"), F.col("caption")).alias("icon")).withColumnRenamed("need", "kind")
