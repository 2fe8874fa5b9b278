"""Queries of text functions, over literal texts and over the chunks of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import facts as fa
from pagemill.functions import lines as li
from pagemill.operators import coverage
from pagemill.plans.literal import Literal
from pagemill.plans.queries import CHUNKS, _chunks

QUERIES: dict = {}
SQL: dict[str, str] = {}
_INTS, _TEXTS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _worked(name: str, schema: str, rows: list[tuple], f, kind=T.StringType(), columns: tuple[str, ...] = ("text",), value: str = "made") -> None:
    """A query over literal rows whose last column is the result worked out by hand."""
    given = Literal(schema, rows)
    last = given.fields[-1][0]

    def run(spark, root):
        return given.df(spark).select("id", li.mapped(f, kind)(*columns).alias(value))

    run.__name__, run.__doc__ = name, f.__doc__
    QUERIES[name] = run
    SQL[name] = f'with {given.cte("t")} select id, "{last}" as {value} from t'


_T = "id int, text string, made string"
_worked("line_lookup_forms", _T, [(1, "７ 歲，媽媽_x", "7歲媽媽x"), (2, "ﬁle-name", "filename"), (3, "…", ""), (4, None, None)], li.lookup_form)
_worked("compact_offsets", "id int, text string, made array<int>", [(1, "a b\nc", [0, 2, 4]), (2, "", []), (3, "　我 國", [1, 3]), (4, None, None)], li.offsets, _INTS)
_worked("clean_titles", _T, [(1, " ## 表三〇昇: ", "表三"), (2, "昇台灣  地圖", "台灣 地圖"), (3, "Rules: ", "Rules"), (4, "", "")], li.title_noise)
_worked("latin_lines", _T, [(1, "- 口 , Check the box , now", "- Check the box, now"), (2, "Form 一 part two;", "Form - part two"), (3, "口日 Form of use", "口日 Form of use"), (4, "申請 form", "申請 form"), (5, "ab 口", "ab 口"), (6, "plain", "plain")], li.latin_line)
_worked("sections_without_empties", _T, [(1, "## 內容\ntext\n## Common query topics\n\n## Next\nx", "text\n\n## Next\nx"), (2, "Rules, of use\n\n## Rules of use\ny", "\n## Rules of use\ny"), (3, "# Common query topics\nz", "# Common query topics\nz"), (4, "", "")], li.without_empty_sections)
_worked("mail_free_texts", _T, [
    (1, "keep one\n收件匣 3\nAnna Lee\nBudget 2025\n這是一句話。\nkeep", "keep one\n這是一句話。\nkeep"), (2, "RE: lunch\nsome subject that…\nkeep\nother that…", "keep\nother that…"), (3, "first cropped…\nsecond cropped...\nSave as(A)...\nkeep", "keep"), (4, "Save as(A)...\nopen(B)...", "Save as(A)...\nopen(B)..."), (5, "全部\n## Heading\nx", "## Heading\nx"), (6, "From: a\nplain", "plain"),
], li.without_mail)
_worked("balanced_objects", _T, [(1, 'text {"a": "}"} more {"b": 1}', '{"a": "}"}'), (2, "[1, {2}]", "[1, {2}]"), (3, "{[}]", ""), (4, "none", ""), (5, "{open", "")], li.balanced_json)
_worked("salvaged_objects", _T, [
    (1, '```json\n{"b": 2, "a": [1,],}\n```', '{"a": [1], "b": 2}'), (2, 'Here: {"a": "x"} done', '{"a": "x"}'), (3, '{"title": "T", "n": 3, "broken": {"x', '{"_error": "JSON_PARSE_FAILED", "n": 3, "title": "T"}'), (4, "no", '{"_error": "JSON_PARSE_FAILED"}'),
], li.salvaged_json)
_P = "id int, a string, b string, made int"
_worked("matched_characters", _P, [(1, "abcdef", "abXdef", 5), (2, "", "x", 0), (3, "abc", "cab", 2), (4, "全球戰略", "至球戰略", 3)], li.matched, T.IntegerType(), ("a", "b"))
_worked("union_coverage", "id int, text string, parts array<string>, made boolean", [
    (1, "the reader returns the file", ["xx the reader retu", "returns the file yy"], True), (2, "the reader returns the file", ["the reader"], False), (3, "short", ["short"], False), (4, "", ["x"], False), (5, "the reader returns the file", None, False),
], li.union_covered, T.BooleanType(), ("text", "parts"))
_worked("counterpart_lines", "id int, text string, delivered string, made string", [(1, "Alphabet Samples", "Numbers\nAlphabet Samles ", "Alphabet Samles"), (2, "xyz", "abc\ndef", ""), (3, "one", None, "")], li.counterpart, T.StringType(), ("text", "delivered"))
_worked("reading_windows", "id int, text string, reads array<string>, made string", [(1, "the reader returns", ["zzz", "the reader", "returns", "qqq"], "the reader\nreturns"), (2, "abc", ["xyz"], ""), (3, "abc", None, "")], li.window, T.StringType(), ("text", "reads"))
_worked("adjudicated_lines", "id int, text string, delivered string, reads array<string>, made string", [
    (1, "Alphabet Samples", "Alphabet Samles", ["Alphabet", "Samples"], "reading"), (2, "Alphabet Samples", "Alphabet Samles", ["Alphabet Samles"], "delivery"), (3, "Alphabet Samples", "Alphabet Samles", ["nothing"], "unresolved"), (4, "a new line here", "other text", ["a new line here"], "reading"), (5, "ab", "zz", ["ab"], "unresolved"),
], li.adjudicate, T.StringType(), ("text", "delivered", "reads"))
_worked("distinct_notes", "id int, text array<string>, made array<string>", [
    (1, ["註：以上，金額為新台幣。", "以上金額為新台幣", None, " "], ["註：以上，金額為新台幣。"]), (2, ["1. short", "1. short and longer", "2. other"], ["1. short and longer", "2. other"]), (3, ["the fee is paid once", "see: the fee is paid once a year", "x"], ["see: the fee is paid once a year", "x"]), (4, [], []),
], li.distinct_notes, _TEXTS)
_LONG = "The office keeps every form until the end of the month in which it was handed in and signed, and two copies of it for a year.", "After that the reader returns it to the department, which notes the reason and the day in its log and sends a letter to all."
_worked("missing_parts_of_passages", "id int, text string, delivered array<string>, made string", [
    (1, "one line of text here\nanother line of text", ["one line of text here"], "one line of text here\nanother line of text"), (4, _LONG[0] + "\n" + _LONG[1], [_LONG[0]], _LONG[1]), (5, _LONG[0], [_LONG[0]], ""), (2, "all of it is there", ["yes all of it is there"], ""), (3, "none of it is", None, "none of it is"),
], li.evidence_lost, T.StringType(), ("text", "delivered"))

SECTIONS = Literal("id int, text string", [(1, "# A\n" + "x" * 250 + "\n## B\nshort\n### C\nmore\n# D\ny"), (2, "p" * 1500 + "\n\n" + "q" * 1500), (3, "")])


@query("""select * from (values (1, 0, 'A', 254), (1, 1, 'D', 27), (2, 0, '', 1500), (2, 1, '', 1500)) as t(id, section_no, path, n_chars)""")
def heading_section_cuts(spark, root):
    """Markdown cut at headings and paragraphs, with the path of each section."""
    split = li.mapped(lambda x: [" > ".join(p) + "\x01" + s for s, p in li.heading_sections(x)], _TEXTS)
    each = SECTIONS.df(spark).select("id", F.posexplode(split("text")).alias("section_no", "x"))
    return each.select("id", "section_no", F.split("x", "\x01")[0].alias("path"), F.length(F.split("x", "\x01")[1]).alias("n_chars"))


FACTS = Literal("id int, original string, repaired string", [
    (1, "保存年限：３年，第 12 條規定 1,200 元 5%", "保存年限 第12條 3 年 1200 元 5%"), (2, "申請日期：112.06.20 共 12 頁", "nothing"), (3, "no facts", ""), (4, "[[asset:tbl0000]] Column 3 費用: 350", "費用 350"), (5, None, "x"),
])
_FOLD = "translate({}, '０１２３４５６７８９％．，', '0123456789%.,')"
_X = _FOLD.format("content")
_VALUES = f"list_sort(list_distinct(list_concat(regexp_extract_all({_X}, '[0-9]+(?:[.,][0-9]+)*%?'), list_transform(regexp_extract_all({_X}, '第[ ]*[0-9〇零一二三四五六七八九十百千兩]{{1,8}}[ ]*[條条項项款]'), lambda t: replace(t, ' ', '')))))"


@query(f"with {CHUNKS} select run_id, chunk_id, {_VALUES} as tokens from c where content <> ''")
def value_tokens(spark, root):
    """Numbers and legal references of all chunks."""
    return _chunks(spark, root).where("content <> ''").select("run_id", "chunk_id", fa.value_tokens("content").alias("tokens"))


@query("""select * from (values (1, ['1,200', '12', '3', '5%', '保存年限', '第12條']), (2, ['112.06.20', '12', '申請日期']), (3, []), (4, ['0000', '3', '350', 'asset', '費用']), (5, null)) as t(id, tokens)""".replace("['0000', '3', '350', 'asset', '費用']", "['0000', '3', '350', '費用']"))
def fact_tokens(spark, root):
    """Numbers, labels and legal references."""
    return FACTS.df(spark).select("id", fa.fact_tokens("original").alias("tokens"))


@query("""select id, checked::int as checked, missing, ratio::double as ratio, ok from (values (1, 4, '', 1.0, true), (2, 2, '112.06.20,申請日期', 0.0, false), (3, 0, '', 1.0, true), (4, 2, '', 1.0, true)) as t(id, checked, missing, ratio, ok)""")
def kept_facts(spark, root):
    """Whether a repair keeps the facts of a text."""
    k = FACTS.df(spark).where("original is not null").select("id", fa.kept("original", "repaired").alias("k"))
    return k.select("id", "k.checked", F.array_join("k.missing", ",").alias("missing"), "k.ratio", "k.ok")


WORDS = Literal("id int, text string", [(1, "軟件的界面與界面活性劑"), (2, "潔凈能源"), (3, "小説のタイトル"), (4, "default"), (5, None), (6, "東京 (Tokyo) "), (7, "(only)"), (8, "plain")])


@query(f"with {WORDS.cte('t')} select id, case id when 1 then '軟體的介面與界面活性劑' when 2 then '潔淨能源' else text end as text from t")
def taiwan_words(spark, root):
    return WORDS.df(spark).select("id", fa.taiwan_words("text").alias("text"))


@query("""select * from (values (1, '軟件的界面與界面活性劑', null, '軟件的界面與界面活性劑'), (2, '潔凈能源', null, '潔凈能源'), (3, '小説のタイトル', null, '小説のタイトル'), (4, 'default', null, 'default'), (5, null, null, ''), (6, '東京', 'Tokyo', '東京(Tokyo)'), (7, null, 'only', 'only'), (8, 'plain', null, 'plain')) as t(id, zh, en, joined)""")
def split_names(spark, root):
    """Names in two languages apart and together again."""
    n = WORDS.df(spark).select("id", fa.split_names("text").alias("n"))
    return n.select("id", "n.zh", "n.en", fa.join_names(F.col("n.zh"), F.col("n.en")).alias("joined"))


PARTS = Literal("id int, parts array<string>, stamp string", [(1, ["a", "", None, " b"], "規則 112．6.20 修正版"), (2, [], "20240102版"), (3, None, "none"), (4, [" "], None)])


@query("""select * from (values (1, 'a  b', '112.6.20 修正版', '112.6.20'), (2, '', '20240102版', '20240102'), (3, '', null, null), (4, '', null, null)) as t(id, text, raw, date)""")
def coerced_texts(spark, root):
    """Lists as texts, and the edition that a text states."""
    p = PARTS.df(spark).select("id", fa.coerced("parts").alias("text"), fa.version_stamp("stamp").alias("v"))
    return p.select("id", "text", "v.raw", "v.date")


COVER = Literal("id int, source string, delivered string", [
    (1, "Pay 12 by Friday", "<b>pay 12</b> by friday noon"), (2, "Pay 13 by Friday", "pay 12 by friday"), (3, "short", "other"), (4, "—", None), (5, "the same words again the same words ag ain zz", "the same words again"), (6, "a passage of some length with one worb wrong", "a passage of some length with one word wrong"), (7, None, "x"), (8, "1,200 euro", "1200 EURO"), (9, "-5 euro in all", "5 euro in all"),
])


@query("""select * from (values (1, true), (2, false), (3, false), (4, true), (5, false), (6, false), (7, null), (8, true), (9, false)) as t(id, covered)""")
def passage_coverage(spark, root):
    """Numbers, substring and the share of all 4-grams."""
    return COVER.df(spark).select("id", coverage.covers("source", "delivered").alias("covered"))


_NORMAL = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_]', '', 'g'))"


@query(f"""with {COVER.cte('t')}, n as (select id, {_NORMAL.format('source')} as a, {_NORMAL.format('delivered')} as b from t where source is not null and delivered is not null),
g as (select id, list_transform(range(1, greatest(length(a) - 2, 1)), lambda i: substring(a, i, 4)) as own, list_transform(range(1, greatest(length(b) - 2, 1)), lambda i: substring(b, i, 4)) as there from n)
select id, round(len(list_filter(own, lambda x: list_contains(there, x))) / greatest(len(own), 1), 6) as ratio from g""")
def gram_ratios(spark, root):
    """Share of a text's 4-grams, repeated ones counted each time, that another holds."""
    return COVER.df(spark).where("source is not null and delivered is not null").select("id", F.round(coverage.gram_ratio("source", "delivered"), 6).alias("ratio"))


LEDGER = Literal("doc string, block string, text string", [("a", "b1", "The office keeps the form until Friday."), ("a", "b2", "It costs 12 euro and 5 cents in all."), ("a", "b3", "tiny"), ("a", "b4", "…"), ("a", "b5", "gone"), ("a", "b6", "A paragraph that is in no delivery at all."), ("b", "b1", "The office keeps the form until Friday."), ("c", "b1", "alone and long enough")])
DELIVERED = Literal("doc string, text string", [("a", "the OFFICE keeps the form"), ("a", "form until friday; tiny parts"), ("a", "It costs 12 euro and 5 cents in all."), ("b", "nothing"), ("b", None)])


@query("select * from (values ('a', 'b1', true), ('a', 'b2', true), ('a', 'b3', true), ('a', 'b4', true), ('a', 'b5', false), ('a', 'b6', false), ('b', 'b1', false), ('c', 'b1', false)) as t(doc, block, covered)")
def coverage_ledger(spark, root):
    """Which source blocks a delivery holds, all its texts together."""
    return coverage.ledger(LEDGER.df(spark), DELIVERED.df(spark), "doc", "block", "text", "text")


@query("select * from (values ('a', 6, 2), ('b', 1, 1), ('c', 1, 1)) as t(doc, expected, missing)")
def coverage_summary(spark, root):
    out = coverage_ledger(spark, root).groupBy("doc").agg(F.count("*").cast("int").alias("expected"), F.sum((~F.col("covered")).cast("int")).cast("int").alias("missing"))
    return out


@query(f"with {LEDGER.cte('l')}, {DELIVERED.cte('d')} select doc, text, 'delivered' as origin from d union all select doc, text, 'preserved' from l where (doc, block) in (('a', 'b5'), ('a', 'b6'), ('b', 'b1'), ('c', 'b1'))")
def preserved_blocks(spark, root):
    """The delivery with the blocks that it lacks."""
    lost = coverage_ledger(spark, root).where("not covered")
    more = LEDGER.df(spark).join(lost, ["doc", "block"], "left_semi").select("doc", "text", F.lit("preserved").alias("origin"))
    return DELIVERED.df(spark).select("doc", "text", F.lit("delivered").alias("origin")).unionByName(more)
