"""Queries of whole passes over literal documents, and of form marks over all texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import forms as fo
from pagemill.operators import delivery, records
from pagemill.operators.chunking import chunk_documents
from pagemill.plans.literal import Literal
from pagemill.plans.phrases import DELIVERED, LEDGER, coverage_ledger
from pagemill.plans.queries import CHUNKS, _chunks
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


_ITEM = "doc string, block_id string, page_idx int, reading_order int, type string, text string, text_level int, img_path string, img_caption array<string>, table_body string, code_body string, list_items array<string>, latex string, x0 int, y0 int, x1 int, y1 int"


def _items() -> list[tuple]:
    out = []

    def add(page: int, kind: str, text: str | None, y: int, level: int = 0, body: str | None = None) -> None:
        out.append(("a", f"a{len(out)}", page, len(out) % 7, kind, text, level, None, None, body, None, None, None, 100, y, 400, y + 40))

    for page in range(3):
        add(page, "text", "Quarterly of the store", 30)
        add(page, "text", f"Chapter {page}" if page < 2 else "12:30", 150, 1)
        add(page, "text", f"The office keeps badge number {page} until the evening of the day.", 300)
        add(page, "page_number", str(page), 960)
        add(page, "text", "See the notice on the wall.", 500)
    add(2, "header", "A line on one page only", 20)
    add(2, "table", None, 700, body="<table><tr><td>1</td></tr></table>")
    return out


ITEMS = Literal(_ITEM, _items())
MORE = Literal("doc string, block_id string, page_idx int, text string, x0 int, y0 int, x1 int, y1 int", [("a", "s1", 1, "A sentence that the reader of pages missed.", 100, 400, 400, 440), ("a", "s2", 1, "badge number 2 until the evening", 100, 600, 400, 640), ("a", "s3", 0, "Top line of page zero", 100, 5, 400, 20)])


@query("""select * from (values ('a', 0, 's3', 'text', null, null), ('a', 1, 'a0', 'text', null, null), ('a', 2, 'a1', 'text', null, 1), ('a', 3, 'a2', 'text', null, null), ('a', 4, 'a3', 'text', 'page_furniture', null), ('a', 5, 'a4', 'text', null, null),
('a', 6, 'a7', 'text', null, null), ('a', 7, 'a8', 'text', 'page_furniture', null), ('a', 8, 'a6', 'text', null, 1), ('a', 9, 's1', 'text', null, null), ('a', 10, 'a15', 'text', null, null), ('a', 11, 'a16', 'table', null, null), ('a', 12, 'a11', 'text', null, null), ('a', 13, 'a12', 'text', null, null), ('a', 14, 'a13', 'text', 'page_furniture', null)) as t(doc, reading_order, block_id, type, origin, level)""")
def normalised_blocks(spark, root):
    """All passes from layout items to blocks, in their order."""
    return delivery.normalised(ITEMS.df(spark), MORE.df(spark)).select("doc", "reading_order", "block_id", "type", "origin", "level")


CHUNKED = Literal("doc string, chunk_id string, text string", [("a", "c1", "the OFFICE keeps the form until Friday; tiny"), ("a", "c1", "It costs 12 euro and 5 cents in all. gone. A paragraph that is in no delivery at all."), ("c", "c9", "alone and long enough")])


@query("""select doc, expected::int as expected, md::int as missing_documents, mc::int as missing_chunks, n::int as n_issues, s::double as score, status, ready from (values ('a', 6, 2, 0, 2, 0.5, 'needs_review', false), ('b', 1, 1, 1, 3, 0.25, 'needs_review', false), ('c', 1, 1, 0, 2, 0.5, 'needs_review', false)) as t(doc, expected, md, mc, n, s, status, ready)""")
def finalised_delivery(spark, root):
    """What a delivery lacks of its source, and whether it may go out."""
    blocks = LEDGER.df(spark).select("doc", F.col("block").alias("block_id"), "text", F.lit(None).cast("string").alias("origin"))
    return delivery.finalised(blocks, DELIVERED.df(spark), CHUNKED.df(spark))


@query("select * from (values ('a', 'c1', 'x'), ('a', 'preserved_b5', 'gone'), ('a', 'preserved_b6', 'A paragraph that is in no delivery at all.'), ('b', 'preserved_b1', 'The office keeps the form until Friday.'), ('c', 'preserved_b1', 'alone and long enough')) as t(doc, chunk_id, content)")
def residual_chunks(spark, root):
    """Structured chunks with a chunk for each block that they don't cover."""
    structured = spark.createDataFrame([("a", "c1", "x")], "doc string, chunk_id string, content string")
    return records.with_residual(structured, LEDGER.df(spark), coverage_ledger(spark, root))


_LABELS = "list_filter(list_transform(regexp_extract_all(regexp_replace(content, '[:：]//', 'XX', 'g'), '(?:^|[\\n|])[ ]*([^\\n|:：]{1,32})[:：]', 1), lambda t: trim(t, ' ')), lambda t: t <> '' and len(string_split_regex(t, ' +')) <= 6 and lower(t) not in ('http', 'https', 'ftp', 'mailto'))"


@query(f"""with {CHUNKS} select run_id, chunk_id, regexp_matches(content, '{fo.MARKERS}') as markers, (len(regexp_extract_all(content, '[□☐☑]')) * 2 + least(len({_LABELS}), 12) + least(len(regexp_extract_all(content, '{fo.SIGNING}')), 6))::int as score from c where content <> ''""")
def form_marks(spark, root):
    """Marks of forms in all chunks, and how much speaks for one."""
    return _chunks(spark, root).where("content <> ''").select("run_id", "chunk_id", fo.has_markers("content").alias("markers"), fo.form_score("content").alias("score"))


NOTES = Literal("id int, text string, rows array<string>", [(1, "Notes 1. keep the form 2. sign it 3.5 euro are due", ["一、申請人資料", "姓名", "二、用途 ", "一、申請人資料", "※ 請勿摺疊", "備註：可複印"]), (2, "plain", []), (3, "1) one 2) two", None), (4, "", ["Note: x", "壹、總則"])])


@query("""select * from (values (1, ['Notes', '1. keep the form', '2. sign it 3.5 euro are due'], ['一、申請人資料', '二、用途'], ['※ 請勿摺疊', '備註：可複印']), (2, ['plain'], [], []), (3, ['1) one', '2) two'], null, null), (4, [], ['壹、總則'], ['Note: x'])) as t(id, items, sections, notes)""")
def note_parts(spark, root):
    """Numbered notes as items, and sections and notes among rows."""
    return NOTES.df(spark).select("id", fo.note_items("text").alias("items"), fo.sections("rows").alias("sections"), fo.notes("rows").alias("notes"))


@query(r"""select doc_id, regexp_matches(lower(regexp_extract(source_path, '([^/]+)$', 1)), '表單|申請書|申請表|申請單|報名表|(?:^|[^a-z])(?:form|application|worksheet|formular|antrag|formulaire)s?(?:[^a-z]|$)') as form from docs""")
def form_files(spark, root):
    """Files whose name says form."""
    return table(spark, root, "docs").select("doc_id", fo.is_form_path("source_path").alias("form"))


TEXTS = Literal("id int, text string", [
    (1, "# A\n## B\n" + "word " * 20 + "\nlast line"), (2, "# A\ntext\n\n# B"), (3, "x" * 30 + " " + "y" * 60), (4, "intro\n# H\none two\nthree four five six\nseven eight nine ten"), (5, ""), (6, None), (7, "申請人應於月底前送交。" * 4),
])


# Worked out by hand from the rules: a bare heading takes in its follower, blocks fill ten tokens and three overlap, a continued chunk repeats its path,
# and what is still too long is cut at the last break past its half, each part with a quarter of the one before.
CHUNKED_TEXTS = Literal("id int, chunk_id string, parent string, path string, content string, first_block int, last_block int, tokens int", [
    (1, "c000000", None, "A>B", "# A\n\n## B", 0, 1, 3), (1, "c000001_part1", "c000001", "A>B", "A > B（續）\n\n# A\n\n## B\n\nword word ", 0, 2, 9), (1, "c000001_part2", "c000001", "A>B", "d " + "word " * 7, 0, 2, 10), (1, "c000001_part3", "c000001", "A>B", "ord " + "word " * 7, 0, 2, 10), (1, "c000001_part4", "c000001", "A>B", "ord " + "word " * 7, 0, 2, 10),
    (1, "c000002", None, "A>B", "A > B（續）\n\nlast line", 3, 3, 6), (2, "c000000", None, "A", "# A\n\ntext\n\n# B", 0, 3, 4), (3, "c000000_part1", "c000000", "", "x" * 30 + " ", 0, 0, 8), (3, "c000000_part2", "c000000", "", "xxxxxx " + "y" * 33, 0, 0, 10), (3, "c000000_part3", "c000000", "", "y" * 37, 0, 0, 10),
    (4, "c000000", None, "", "intro", 0, 0, 2), (4, "c000001", None, "H", "# H\n\none two\n\nthree four five six", 1, 3, 9), (4, "c000002", None, "H", "H（續）\n\nseven eight nine ten", 4, 4, 8),
    (7, "c000000_part1", "c000000", "", "申請人應於月底前送交。", 0, 0, 8), (7, "c000000_part2", "c000000", "", "交。申請人應於月底前送交。", 0, 0, 9), (7, "c000000_part3", "c000000", "", "送交。申請人應於月底前送交。", 0, 0, 10), (7, "c000000_part4", "c000000", "", "送交。申請人應於月底前送交。", 0, 0, 10),
])


@query(f"with {CHUNKED_TEXTS.cte('c')} select * from c")
def literal_chunks(spark, root):
    """Chunks of literal documents under ten tokens with an overlap of three."""
    c = chunk_documents(TEXTS.df(spark), "id", "text", 10, 3)
    return c.select("id", "chunk_id", F.col("parent_chunk_id").alias("parent"), F.array_join("heading_path", ">").alias("path"), "content", "first_block", "last_block", "tokens")
