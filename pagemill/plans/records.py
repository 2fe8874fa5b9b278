"""Queries over literal records, and over the runs and issues of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.operators import quality, records
from pagemill.plans.literal import Literal
from pagemill.plans.queries import _chunks
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


BLOCKS = Literal("block_id string, page_idx int, type string, text string", [("b1", 0, "text", "one"), ("b2", 0, "image", None), ("b3", 1, "image", "alt"), ("b4", 1, "image", "logo"), ("b5", 2, "text", "five")])
ASSETS = Literal("block_id string, retrieval_text string, decorative boolean", [("b2", "A chart of badges", None), ("b3", "  ", False), ("b4", "A logo", True), ("b9", "gone", False)])
LINES = Literal("line_no int, block_id string, kind string, needs_review boolean, page_idx int, _read_error string", [(0, "b2", "caption", True, 0, None), (1, "b2", "caption", False, 0, None), (2, None, None, None, None, "{broken"), (3, "b3", "table", None, 1, None), (4, "b5", "caption", True, 2, None), (5, "b4", "caption", False, 1, None)])


@query(f"with {BLOCKS.cte('b')}, {ASSETS.cte('a')} select b.block_id, coalesce(nullif(trim(a.retrieval_text), ''), b.text) as text from b left join a on a.block_id = b.block_id where not coalesce(a.decorative, false)")
def blocks_with_assets(spark, root):
    """Image blocks take the text of their asset; decorative ones drop out."""
    return records.with_assets(BLOCKS.df(spark), ASSETS.df(spark)).select("block_id", "text")


_LATEST = f"with {LINES.cte('l')}, e as (select block_id, kind, needs_review, page_idx from l where _read_error is null and block_id is not null qualify row_number() over (partition by block_id order by line_no desc) = 1)"


@query(f"{_LATEST} select * from e")
def latest_enrichments(spark, root):
    return records.latest_enrichments(LINES.df(spark))


@query(f"{_LATEST} select block_id from e where kind = 'caption' and coalesce(needs_review, false) = false")
def filtered_enrichments(spark, root):
    return records.filtered(records.latest_enrichments(LINES.df(spark)), kind="caption", needs_review=False, block_id=None).select("block_id")


@query(f"{_LATEST} select block_id from e where block_id <> 'b2' and page_idx <> 2")
def kept_enrichments(spark, root):
    """Enrichments of neither a replaced block nor a replaced page."""
    e = records.latest_enrichments(LINES.df(spark))
    return records.without_replaced(e, e.where("block_id = 'b2'"), e.where("page_idx = 2")).select("block_id")


FINDINGS = Literal("finding_id int, page_idx int, block_id string, status string, context_complete boolean, provider string", [(1, 0, "b1", "open", None, "ocr"), (2, 1, "b3", "verified", True, "vlm"), (3, 1, "b4", "verified", False, "ocr"), (4, 1, None, "open", True, None), (5, 9, "b5", "verified", None, "ocr")])
PAGES = Literal("page_idx int, status string", [(0, "verified"), (1, "pending"), (2, None)])


@query(f"with {FINDINGS.cte('f')}, {PAGES.cte('p')} select finding_id from f left join p on p.page_idx = f.page_idx where coalesce(p.status = 'verified', false) or (f.status = 'verified' and coalesce(context_complete, false))")
def usable_findings(spark, root):
    return records.usable(FINDINGS.df(spark), PAGES.df(spark)).select("finding_id")


TARGETS = Literal("target_id int, page_idx int, block_id string, provider string", [(1, 1, None, None), (2, 1, "b3", None), (3, 1, None, "ocr"), (4, 0, "b1", "vlm")])


@query(f"with {FINDINGS.cte('f')}, {TARGETS.cte('t')} select t.target_id, f.finding_id as evidence_id from t join f on f.page_idx = t.page_idx and (t.block_id is null or t.block_id = f.block_id) and (t.provider is null or t.provider = f.provider)")
def target_evidence(spark, root):
    return records.evidence_for(TARGETS.df(spark), FINDINGS.df(spark).withColumnRenamed("finding_id", "evidence_id"))


@query("""with b as (select distinct run_id, chunk_id, unnest(block_ids) as b from chunks), i as (select distinct run_id, block_id as b from quality_gate where block_id is not null)
select b.run_id || '/' || b.chunk_id as chunk_id, i.run_id || '/' || i.b as item_id from b join i on i.run_id = b.run_id and i.b = b.b""")
def issue_chunks(spark, root):
    """Chunks that share a block with an issue of their run."""
    c = table(spark, root, "chunks").select(F.concat_ws("/", "run_id", "chunk_id").alias("chunk_id"), F.transform("block_ids", lambda b: F.concat(F.col("run_id"), F.lit("/"), b)).alias("block_ids"))
    g = table(spark, root, "quality_gate").where("block_id is not null").select(F.concat_ws("/", "run_id", "block_id").alias("item_id")).distinct()
    return records.in_groups(c, g.withColumn("block_ids", F.array("item_id")))


@query("""with d as (select doc_id, case when meta_json is null then [] else json_keys(meta_json) end as names from docs) select doc_id, list_sort(list_filter(['author', 'language', 'title'], lambda x: not list_contains(names, x))) as missing from d""")
def missing_meta(spark, root):
    """Required keys that a document's metadata lacks."""
    names = F.json_object_keys("meta_json")
    return table(spark, root, "docs").select("doc_id", F.array_sort(records.missing_fields(["author", "language", "title"], names)).alias("missing"))


FIELDS = Literal("form string, page int, seq int, name string, type string, required boolean, aliases array<string>, evidence string, section string, field_order int", [
    ("f", 1, 1, "Full name", "text", False, ["Name"], "", "person", 2), ("f", 1, 2, "full  NAME", "", True, ["name", "Name"], "line 3", "person", 1), ("f", 1, 3, "Date", "date", None, None, None, "other", 1), ("f", 2, 4, "Full name", "choice", False, [" "], "box", "sign", 1), ("f", 2, 5, " ", "text", True, ["x"], None, "sign", 2), ("g", 1, 1, "Sum", None, False, [], "s", "amount", 7), ("g", 1, 2, "Tax", "text", False, [], None, "amount", 3),
])


@query("""select * from (values ('f', 'Full name', 'text', true, ['Name', 'name'], 'line 3', 1), ('f', 'Date', 'date', false, [], null, 3), ('f', 'Full name', 'choice', false, [], 'box', 4), ('g', 'Sum', 'text', false, [], 's', 1), ('g', 'Tax', 'text', false, [], null, 2)) as t(form, name, type, required, aliases, evidence, seq)""")
def merged_fields(spark, root):
    """Fields of one name and type as one."""
    return records.merged_fields(FIELDS.df(spark), ["form"])


@query(f"with {FIELDS.cte('f')} select form, section, list(name order by field_order, name) as names, (row_number() over (partition by form order by case section when 'person' then 1 when 'amount' then 2 when 'sign' then 3 else 4 end, section))::int as place from f group by form, section")
def fields_by_section(spark, root):
    return records.by_section(FIELDS.df(spark), ["form"], ["person", "amount", "sign"])


@query(f"with {FIELDS.cte('f')} select form, section, list(name order by seq) as members, (row_number() over (partition by form order by min(seq)))::int as place from f group by form, section")
def record_groups(spark, root):
    """Groups in the order in which they are first seen."""
    return records.groups_in_order(FIELDS.df(spark), ["form"], "section", "seq", "name")


@query(f"with {FIELDS.cte('f')} select form, page, seq from f qualify row_number() over (partition by form, page order by coalesce(required, false)::int desc, length(name) desc, seq) = 1")
def best_per_page(spark, root):
    """The best record of each page; ties keep the first."""
    scores = [F.coalesce("required", F.lit(False)).cast("int"), F.length("name")]
    return records.best_of(FIELDS.df(spark), ["form", "page"], scores, "seq").select("form", "page", "seq")


CARRY = Literal("tbl string, row int, region string, country string, place string", [
    ("a", 0, "Asia", "", ""), ("a", 1, "", "Japan", "Tokyo"), ("a", 2, "", "", "Osaka"), ("a", 3, "", "Korea", ""), ("a", 4, "Europe", "", ""), ("a", 5, "", "", "Paris"), ("a", 6, "", "France", "Lyon"), ("a", 7, None, None, None), ("b", 0, "", "Peru", "Lima"), ("b", 1, "America", "", "Cusco"),
])


@query("""select * from (values ('a', 0, 'Asia', null, null), ('a', 1, 'Asia', 'Japan', 'Tokyo'), ('a', 2, 'Asia', 'Japan', 'Osaka'), ('a', 3, 'Asia', 'Korea', null), ('a', 4, 'Europe', null, null), ('a', 5, 'Europe', null, 'Paris'), ('a', 6, 'Europe', 'France', 'Lyon'), ('a', 7, 'Europe', 'France', 'Lyon'), ('b', 0, null, 'Peru', 'Lima'), ('b', 1, 'America', null, 'Cusco')) as t(tbl, row, region, country, place)""")
def carried_context(spark, root):
    """Region, country and place carried down the rows; a new outer value clears the inner ones."""
    return records.carried(CARRY.df(spark), ["tbl"], "row", ["region", "country", "place"])


RANGES = Literal("doc string, start int, end int", [("a", 0, 10), ("a", 5, 8), ("a", 10, 12), ("a", 20, 30), ("a", 25, 26), ("b", 3, 3), ("b", 3, 3)])


@query("select * from (values ('a', 0, 12), ('a', 20, 30), ('b', 3, 3)) as t(doc, start, \"end\")")
def merged_ranges(spark, root):
    """Interval merge."""
    return records.merged_ranges(RANGES.df(spark), ["doc"])


COLLECTED = Literal("doc string, table_id string, page_idx int, title string", [("a", f"t{k:02d}", k // 4, ("Prices", "pri ces", "Stock", "Staff list")[k % 4]) for k in range(32)] + [("b", "t1", 0, "Prices")])


@query(f"""with {COLLECTED.cte('t')}, m as (select *, lower(replace(title, ' ', '')) as form from t where doc in (select doc from t group by 1 having count(*) >= 30)), g as (select doc, form, arg_min(title, (page_idx, table_id)) as title, min(page_idx) as p, list(table_id order by page_idx, table_id) as members from m group by 1, 2)
select doc, title, (row_number() over (partition by doc order by p, form))::int as place, members from g""")
def table_collections(spark, root):
    return records.collections(COLLECTED.df(spark))


TERMS = Literal("doc string, item string, kind string, text string", [("a", "i1", "caption", "圖 Router 與 Gatway 連線"), ("a", "i2", "keyword", "Gatway"), ("a", "i3", "keyword", "router x1"), ("a", "i4", "caption", "no Latin beyond ok"), ("b", "i5", "caption", "Router")])
VISIBLE = Literal("doc string, text string", [("a", "the ROUTER and the Switch"), ("a", "no latin beyond"), ("c", "Router")])


@query("select * from (values ('a', 'i1', '圖 Router 與 連線'), ('a', 'i3', 'router x1'), ('a', 'i4', 'no Latin beyond ok'), ('b', 'i5', '')) as t(doc, item, text)")
def grounded_terms(spark, root):
    """Latin terms of captions and keywords that nothing in the document shows go."""
    return records.grounded(TERMS.df(spark), VISIBLE.df(spark))


RULES = rules.Ruleset.of({
    "text_fixes": [{"pattern": "(\\w+) {2,}(\\w+)", "replacement": "\\1 \\2"}, {"pattern": "colou?r", "replacement": "hue$", "flags": "IGNORECASE"}], "label_fixes": [{"pattern": "[:：]+$"}], "label_overrides": [{"pattern": "^sign", "replacement": "Signature"}],
    "label_map": {"approv|核准": "approval", "app": "application"}, "markers": {"watermarks": ["DRAFT", "內部使用"]}, "keywords": {"form": ["name", "date", "sign"]},
})
LABELS = Literal("id int, text string", [(1, "Colour  of the badge"), (2, "sign here:"), (3, "approver"), (4, "apply\nDRAFT copy\nkeep"), (5, "name and date："), (6, None)])


@query("""select * from (values (1, 'hue$ of the badge', 'Colour  of the badge', 'Colour  of the badge', 'Colour  of the badge', 0), (2, 'sign here:', 'Signature', 'sign here:', 'sign here:', 1), (3, 'approver', 'approver', 'approval', 'approver', 0), (4, 'apply' || chr(10) || 'DRAFT copy' || chr(10) || 'keep', 'apply' || chr(10) || 'DRAFT copy' || chr(10) || 'keep', 'application', 'apply' || chr(10) || 'keep', 0), (5, 'name and date：', 'name and date', 'name and date：', 'name and date：', 2), (6, null, null, null, null, null)) as t(id, fixed, label, mapped, unmarked, hits)""")
def ruled_texts(spark, root):
    """A ruleset's fixes, labels, maps, markers and keywords as columns."""
    t = F.col("text")
    return LABELS.df(spark).select("id", RULES.fixed_text(t).alias("fixed"), RULES.fixed_label(t).alias("label"), RULES.mapped_label(t).alias("mapped"), RULES.without_marked_lines(t, "watermarks").alias("unmarked"), RULES.keyword_hits(t, "form").alias("hits"))


# catalogue -----------------------------------------------------------------------------------------------------------


@query("select doc_id, run_id, (row_number() over (partition by doc_id order by created_at desc, run_id desc))::int as place from runs qualify row_number() over (partition by doc_id order by created_at desc, run_id desc) <= 2")
def runs_of_doc(spark, root):
    """The last two runs of each document (the page of a list)."""
    w = Window.partitionBy("doc_id").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    return table(spark, root, "runs").select("doc_id", "run_id", F.row_number().over(w).alias("place"), "created_at").where("place <= 2").drop("created_at")


@query("select count(*) as total, count(*) filter (n > 0) as with_chunks from (select r.run_id, count(c.chunk_id) as n from runs r left join chunks c on c.run_id = r.run_id group by 1)")
def outputs_total(spark, root):
    """Runs, and those with output, whatever page is shown."""
    n = table(spark, root, "chunks").groupBy("run_id").agg(F.count("chunk_id").alias("n"))
    joined = table(spark, root, "runs").select("run_id").join(n, "run_id", "left")
    return joined.agg(F.count("*").alias("total"), F.count(F.when(F.col("n") > 0, 1)).alias("with_chunks"))


@query("""with c as (select run_id, count(distinct chunk_id) as n, sum(len(regexp_extract_all(coalesce(content, ''), '\\[\\[asset:[^\\]]*\\]\\]'))) as a from chunks group by 1), e as (select run_id, count(*) as n from (select distinct id, run_id, error_json from run_stages) where error_json is not null group by 1)
select r.profile, count(*) as n_runs, count(*) filter (r.status = 'succeeded') as n_succeeded, sum(coalesce(c.n, 0))::bigint as n_chunks, sum(coalesce(c.a, 0))::bigint as n_assets, sum(coalesce(e.n, 0))::bigint as n_errors from runs r left join c on c.run_id = r.run_id left join e on e.run_id = r.run_id group by 1""")
def workspace_baseline(spark, root):
    """Counts of all runs of a profile, errors and successes among them."""
    c = table(spark, root, "chunks").groupBy("run_id").agg(F.countDistinct("chunk_id").alias("n"), F.sum(F.regexp_count(F.coalesce("content", F.lit("")), F.lit("\\[\\[asset:[^\\]]*\\]\\]"))).alias("a"))
    e = table(spark, root, "run_stages").select("id", "run_id", "error_json").distinct().where("error_json is not null").groupBy("run_id").agg(F.count("*").alias("e"))
    joined = table(spark, root, "runs").select("run_id", "profile", "status").join(c, "run_id", "left").join(e, "run_id", "left")
    total = lambda x, name: F.sum(F.coalesce(x, F.lit(0))).cast("bigint").alias(name)
    return joined.groupBy("profile").agg(F.count("*").alias("n_runs"), F.count(F.when(F.col("status") == "succeeded", 1)).alias("n_succeeded"), total("n", "n_chunks"), total("a", "n_assets"), total("e", "n_errors"))


# quality -------------------------------------------------------------------------------------------------------------

_HAN, _LATIN = r"[\x{4E00}-\x{9FFF}]", "[A-Za-z]"
_LABEL_SQL = "case when replace(lower(trim(stats.semantic_output_language)), '_', '-') in ('zh', 'zh-tw', 'zh-hant', 'zh-hant-tw', 'chi', 'zho', 'chinese', 'traditional-chinese') then 'zh-TW' when replace(lower(trim(stats.semantic_output_language)), '_', '-') in ('en', 'en-us', 'en-gb', 'eng', 'english') then 'en' end"


@query(rf"""with c as (select distinct run_id, chunk_id, content from chunks where content is not null), l as (select run_id, max({_LABEL_SQL}) as lang from quality_gate group by 1),
s as (select run_id, count(*) as n, sum(len(regexp_extract_all(content, '{_HAN}'))) as han, sum(len(regexp_extract_all(content, '{_LATIN}'))) as latin, sum(length(content)) as chars, sum(len(regexp_extract_all(content, '!\[[^\]]*\]\([^)]*\)|\[\[asset:[^\]]*\]\]'))) as embeds,
 count(*) filter (regexp_matches(content, '(?:\.\.\.|…)[ \n]*$')) as ellipsis, count(*) filter (regexp_matches(content, '</?(?:table|tr|td|div|span)[ >]')) as residue, count(*) filter (contains(content, chr(65533))) as broken, count(*) filter (trim(content, ' ') = '') as blank from c group by 1),
j as (select s.*, l.lang from s left join l on l.run_id = s.run_id),
i as (select run_id, 'broken_embed' as code, 'high' as severity, embeds as n from j where embeds > 0 union all select run_id, 'ellipsis_end', 'low', ellipsis from j where ellipsis > 0 union all select run_id, 'residue', 'low', residue from j where residue > 0 union all select run_id, 'replacement_character', 'medium', broken from j where broken > 0
 union all select run_id, 'no_text', 'low', blank from j where blank > 0 union all select run_id, 'english_noise_high', 'medium', latin from j where lang = 'zh-TW' and han >= 40 and latin > han * 0.6 union all select run_id, 'target_language_mismatch', 'medium', han from j where lang = 'en' and han >= 4 union all select run_id, 'zh_noise_in_english', 'medium', han from j where lang = 'en' and han >= chars * 0.15)
select run_id, code, severity, n::bigint as n from i""")
def text_issues(spark, root):
    """Issues of the texts of each run as rows, with their gravity and count."""
    lang = quality.label_of(F.col("stats.semantic_output_language"))
    labels = table(spark, root, "quality_gate").groupBy("run_id").agg(F.max(lang).alias("lang"))
    return quality.text_issues(_chunks(spark, root), labels, "run_id", "content")


@query(r"""with g as (select distinct run_id, issue_no, evidence.checked_count as checked, evidence.missing_count as missing from quality_gate where evidence.checked_count >= 3), r as (select run_id, issue_no, (checked - missing) / checked as s, checked, missing from g)
select run_id, issue_no, round(s, 4) as survival, case when s < 0.6 then 'high' else 'medium' end as severity from r where s < 0.85""")
def survival_issues(spark, root):
    """Runs of which too much authored text was lost: at least three passages checked, under 0.85 kept."""
    g = table(spark, root, "quality_gate").select("run_id", "issue_no", F.col("evidence.checked_count").alias("checked"), F.col("evidence.missing_count").alias("missing")).distinct()
    return quality.survival_issues(g).select("run_id", "issue_no", "survival", "severity")


CODES = Literal("run_id string, issue_no int, code string, severity string", [("a", 1, "residue", "low"), ("a", 2, "ocr_title_noise", "medium"), ("a", 3, "target_language_mismatch", "high"), ("a", 4, "unknown_code", "high"), ("b", 1, "source_preview_missing", "low"), ("c", 0, None, None), ("d", 1, "structured_output_empty", "high"), ("d", 2, "structured_output_empty", "high"), ("d", 3, "english_noise_high", "medium"), *(("e", k, "target_language_mismatch", "high") for k in range(1, 8))])


@query("""select run_id, correctness::double as correctness, readiness::double as readiness, repairs, needed from (values ('a', 0.8, 0.62, ['clean_titles', 'rewrite_language', 'rewrite_tables'], true), ('b', 0.96, 1.0, [], false), ('c', 1.0, 1.0, [], false), ('d', 0.48, 1.0, ['build_records'], true), ('e', 0.0, 0.0, ['rewrite_language'], true)) as t(run_id, correctness, readiness, repairs, needed)""")
def semantic_quality(spark, root):
    """Two scores by the class of the issues, the repairs that they ask for, and whether one is needed."""
    return quality.semantic(CODES.df(spark), "run_id")


OUTPUTS = Literal("block_id string, page_idx int, output string", [("b1", 0, '{"_error": "JSON_PARSE_FAILED: x", "title": "t"}'), ("b2", 0, '{"_error": "  "}'), ("b3", 1, '{"title": "ok"}'), ("b4", 1, None), ("b5", 2, "no json")])


@query("select * from (values ('b1', 0, 'JSON_PARSE_FAILED: x')) as t(block_id, page_idx, error)")
def enrichment_failures(spark, root):
    return OUTPUTS.df(spark).select("block_id", "page_idx", F.trim(F.get_json_object("output", "$._error")).alias("error")).where("error <> ''")


WOVEN = Literal("doc string, pos int, cell string", [("a", k, c) for k, c in enumerate(["Item", "Pen box", "●", "x", "12 pieces", "Ink", "30 pieces"])] + [("b", 0, "Item"), ("b", 1, "Pen")] + [("c", k, f"cell {k}") for k in range(50)] + [("d", k, c) for k, c in enumerate(["one", "two", "three"])])
BODY = Literal("doc string, text string", [("a", "Item: Penbox, 12 pieces. Ink: 30 pieces"), ("b", "Item Pen"), ("c", " ".join(f"cell{k}" for k in range(36))), ("d", "one two")])


@query(f"""with {WOVEN.cte('w')}, {BODY.cte('b')}, s as (select doc, left(replace(cell, ' ', ''), 60) as form, row_number() over (partition by doc order by pos) as k from w where length(replace(cell, ' ', '')) >= 2), h as (select s.doc, count(*) as n, avg(contains(replace(b.text, ' ', ''), s.form)::int) as share from s join b on b.doc = s.doc where k <= 40 group by 1)
select doc, n >= 3 and share >= 0.9 as woven from h""")
def woven_tables(spark, root):
    """Whether the cells of a document's tables stand in its text (of at most forty, the rule's sample)."""
    return quality.woven(WOVEN.df(spark), BODY.df(spark))
