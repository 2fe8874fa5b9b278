"""Queries over the pipeline tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions.tokens import token_estimate
from pagemill.operators import blocks as bl
from pagemill.operators import catalog, coverage, quality, retrieval
from pagemill.operators import tables as tb
from pagemill.plans.literal import Literal
from pagemill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


WIDE = r"[^\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]"
SPACES = r"[ \t\n\r\f\x0B\x{A0}\x{3000}]"


def estimate_sql(x: str) -> str:
    w = f"length(regexp_replace({x}, '{WIDE}', '', 'g'))"
    return f"coalesce((2 * {w} + 2) // 3 + (length({x}) - {w} + 3) // 4, 0)"


#: Lines of all documents, and of each chunk once.
LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as k from documents where text is not null)"
CHUNKS = "c as (select distinct run_id, chunk_id, content from chunks where content is not null)"
CHUNK_LINES = CHUNKS + ", lines as (select run_id, chunk_id, unnest(string_split(content, chr(10))) as line, unnest(range(len(string_split(content, chr(10))))) as k from c)"
TYPE = r"""case when trim(line) = '' then 'blank' when regexp_matches(line, '^#{1,6} ') then 'heading' when line like '|%' then 'table' when line like '>%' then 'quote'
 when regexp_matches(line, '^[ ]*(?:[-*•]|[0-9]{1,3}[.)]) ') then 'list' else 'text' end"""


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return bl.blocks(table(spark, root, "documents"), ["doc_id"], "text")


def _placed(spark: SparkSession, root: str) -> DataFrame:
    return bl.placed_blocks(table(spark, root, "documents"), ["doc_id"], "text")


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    """Each delivery once. The content is part of the key: a hash aggregate combines equal rows before the shuffle, where keeping a first content beside a hash would sort all of them."""
    return table(spark, root, "chunks").where("content is not null").select("run_id", "chunk_id", "content").distinct()


def _chunk_lines(spark: SparkSession, root: str) -> DataFrame:
    return bl.blocks(_chunks(spark, root), ["run_id", "chunk_id"], "content")


def _placed_chunks(spark: SparkSession, root: str) -> DataFrame:
    return bl.placed_blocks(_chunks(spark, root), ["run_id", "chunk_id"], "content")


#: Shapes that the chunks of the tables lack: accounts with numbers, notes after tables, repeated cells.
EXTRA = Literal("run_id string, chunk_id string, content string", [
    ("x", "1", "write to d23456@host.example or ab1234@b.example, not name@host.example"), ("x", "2", "text before\n| Item | Unit | Item | Item |\n| Pen | box | Pen |  |\n\nNote: of the store\nsecond note\n| a | a |\nafter it"), ("x", "3", "|lonely|"), ("x", "4", "no table\nat all"),
])
MORE_CHUNKS = EXTRA.cte("extra") + ", c as (select distinct run_id, chunk_id, content from chunks where content is not null union all select run_id, chunk_id, content from extra)"


def _more_chunks(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root).unionByName(EXTRA.df(spark))


# texts and blocks ---------------------------------------------------------------------------------------------------


@query(f"with {LINES} select doc_id, count(*) as n_lines, max({estimate_sql('line')})::bigint as max_tokens, sum({estimate_sql('line')})::bigint as sum_tokens from lines group by doc_id")
def chunk_token_stats(spark, root):
    lines = _lines(spark, root).withColumn("e", token_estimate("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("e").alias("max_tokens"), F.sum("e").alias("sum_tokens"))


@query(f"with {LINES} select {TYPE} as block_type, count(*) as n, sum(length(line))::bigint as n_chars from lines group by 1")
def block_type_counts(spark, root):
    lines = _lines(spark, root).withColumn("block_type", bl.block_type(F.col("line")))
    return lines.groupBy("block_type").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("n_chars"))


@query(f"with {CHUNK_LINES} select run_id, chunk_id, k::int as reading_order, length(regexp_extract(line, '^(#+)', 1))::int as level, regexp_replace(line, '^#+ ', '') as title from lines where regexp_matches(line, '^#{{1,6}} ')")
def heading_blocks(spark, root):
    lines = _chunk_lines(spark, root)
    return lines.withColumn("level", bl.heading_level(F.col("line"))).where("level is not null").select("run_id", "chunk_id", "reading_order", "level", F.regexp_replace("line", "^#+ ", "").alias("title"))


@query(f"""with {CHUNK_LINES}, s as (select *, sum(case when regexp_matches(line, '^#{{1,6}} ') then 1 else 0 end) over (partition by run_id, chunk_id order by k) as section_id from lines)
select run_id, chunk_id, section_id::bigint as section_id, count(*) as n_lines, bool_and(regexp_matches(line, '^#{{1,6}} ') or trim(line) = '') as heading_only from s group by 1, 2, 3""")
def section_ids(spark, root):
    s = _placed_chunks(spark, root)
    empty = bl.block_type(F.col("line")).isin("heading", "blank")
    return s.groupBy("run_id", "chunk_id", "section_id").agg(F.count("*").alias("n_lines"), F.bool_and(empty).alias("heading_only"))


@query(f"""with {LINES}, o as (select doc_id, k, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as a from lines)
select doc_id, k::int as reading_order, a::bigint as range_start, (a + length(line))::bigint as range_end from o""")
def anchor_offsets(spark, root):
    return _placed(spark, root).select("doc_id", "reading_order", "range_start", "range_end")


@query("""with h as (select distinct run_id, chunk_id as seq, metadata.heading_level as level, metadata.heading as title from chunks where metadata.heading_level is not null and metadata.heading is not null),
n as (select *, row_number() over (partition by run_id order by seq, level, title) as at from h),
p as (select a.run_id, a.at, b.level, max(b.at) as best from n a join n b on a.run_id = b.run_id and b.at <= a.at and b.level <= a.level group by 1, 2, 3),
o as (select x.* from p x where not exists (select 1 from n y where y.run_id = x.run_id and y.at <= x.at and y.at > x.best and y.level < x.level))
select o.run_id, o.at::bigint as at, string_agg(n.title, ' > ' order by o.level) as path from o join n on n.run_id = o.run_id and n.at = o.best group by 1, 2""")
def heading_path(spark, root):
    h = (
        table(spark, root, "chunks")
        .select("run_id", F.col("chunk_id").alias("seq"), F.col("metadata.heading_level").alias("level"), F.col("metadata.heading").alias("title"))
        .where("level is not null and title is not null")
        .distinct()
    )
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "level", "title")).cast("bigint")
    paths = bl.heading_paths(h.withColumn("at", at).drop("seq").withColumn("seq", F.col("at")), ["run_id"])
    return paths.select("run_id", "at", F.array_join("path", " > ").alias("path"))


@query(f"with {LINES}, d as (select distinct doc_id, trim(line, ' ') as line from lines) select line, count(*) as n from d where length(line) >= 4 group by line having count(*) >= 3")
def repeat_lines_3plus(spark, root):
    return bl.repeated_lines(_lines(spark, root), "doc_id", 3)


@query(f"""with {LINES}, r as (select *, count(*) over (partition by doc_id, line) as n, row_number() over (partition by doc_id, line order by k) as i from lines)
select doc_id, count(*) as n_lines, count(*) filter (length(trim(line, ' ')) < 4 or n < 3 or i = 1) as n_kept from r group by doc_id""")
def first_occurrence_dedup(spark, root):
    kept = bl.first_occurrences(_placed(spark, root), 3).groupBy("doc_id").agg(F.count("*").alias("n_kept"))
    lines = _lines(spark, root).groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return lines.join(kept, "doc_id")


@query("select sha256(text) as text_hash, count(*) as n, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1")
def exact_copy_groups(spark, root):
    d = table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return d.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(r"""select doc_id, length(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B\x{A0}\x{3000}]+', ' ', 'g'), ' '))::int as n_plain, length(regexp_replace(text, '[ \t\n\r\f\x0B\x{A0}\x{3000}]+', '', 'g'))::int as n_compact,
lower(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) = '' as no_letters from documents where text is not null""")
def text_forms(spark, root):
    """Plain, compact and normalised forms. The SQL knows neither entities nor comments, of which the test tables have none: those are covered by tests."""
    d = table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", F.length(tx.plain_text("text")).alias("n_plain"), F.length(tx.compact("text")).alias("n_compact"), (tx.normalized_text("text") == "").alias("no_letters"))


@query(r"""select doc_id, len(list_distinct(regexp_extract_all(translate(text, '０１２３４５６７８９％．，', '0123456789%.,'), '[0-9]+(?:[.,/:-][0-9]+)*')))::bigint as n_numbers from documents where text is not null""")
def fact_number_tokens(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.size(tx.numbers("text")).cast("bigint").alias("n_numbers"))


@query(r"""with t as (select doc_id, len(regexp_extract_all(text, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')) as han, len(regexp_extract_all(text, '[A-Za-z]')) as latin from documents where text is not null)
select case when han >= 12 and han >= latin * 0.08 then 'zh' else 'en' end as language, count(*) as n from t group by 1""")
def language_of_counts(spark, root):
    return table(spark, root, "documents").where("text is not null").groupBy(tx.language_of("text").alias("language")).agg(F.count("*").alias("n"))


@query(f"""with {MORE_CHUNKS} select run_id, chunk_id, sha256(regexp_replace(content, '(^|[^A-Za-z0-9.])([A-Za-z]{{1,3}})[0-9]{{4,6}}@', '\\1\\2*****@', 'g')) as masked from c where regexp_matches(content, '(^|[^A-Za-z0-9.])([A-Za-z]{{1,3}})[0-9]{{4,6}}@')""")
def email_id_mask(spark, root):
    c = _more_chunks(spark, root).where(F.col("content").rlike(tx.EMAIL_ID))
    return c.select("run_id", "chunk_id", F.sha2(tx.mask_email_id("content"), 256).alias("masked"))


@query(f"""with {CHUNKS} select run_id, chunk_id, sha256(regexp_replace(content, '([A-Za-z]{{2,}}\\\\[A-Za-z])[0-9]{{4,6}}([^0-9]|$)', '\\1*****\\2', 'g')) as masked from c where regexp_matches(content, '[A-Za-z]{{2,}}\\\\[A-Za-z][0-9]{{4,6}}([^0-9]|$)')""")
def domain_mask(spark, root):
    c = _chunks(spark, root).where(F.col("content").rlike("[A-Za-z]{2,}\\\\[A-Za-z][0-9]{4,6}([^0-9]|$)"))
    return c.select("run_id", "chunk_id", F.sha2(tx.mask_domain_account("content"), 256).alias("masked"))


@query(r"""select doc_id, trim(replace(regexp_replace(regexp_replace(regexp_extract(source_path, '([^/]+?)(?:\.[A-Za-z0-9]+)?$', 1), '^[0-9]+[._ -]+', ''), '[ _-]*(?:[vV][0-9]+(?:\.[0-9]+)*|[0-9]{8})$', ''), '_', ' '), ' ') as title,
regexp_extract(source_path, '^/data/inbox/([^/]+)/', 1) as source from docs""")
def source_titles(spark, root):
    return table(spark, root, "docs").select("doc_id", tx.source_title("source_path").alias("title"), F.regexp_extract("source_path", "^/data/inbox/([^/]+)/", 1).alias("source"))


@query(r"""with h as (select distinct run_id, chunk_id, metadata.heading as heading from chunks where metadata.heading is not null)
select lower(regexp_replace(regexp_replace(heading, '^#+[ ]*(?:§[ ]*[0-9]+)?', ''), '[^\p{L}\p{N}]+', '', 'g')) as heading_key, count(*) as n, count(distinct run_id) as n_runs from h group by 1""")
def heading_keys(spark, root):
    h = table(spark, root, "chunks").where("metadata.heading is not null").select("run_id", "chunk_id", F.col("metadata.heading").alias("heading")).distinct()
    return h.groupBy(tx.heading_key("heading").alias("heading_key")).agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("n_runs"))


# tables -------------------------------------------------------------------------------------------------------------

CELLS = f"""{CHUNK_LINES}, rows as (select run_id, chunk_id, k, string_split(regexp_replace(trim(line, ' '), '^\\||\\|$', '', 'g'), '|') as parts from lines where line like '|%'),
cells as (select run_id, chunk_id, k, unnest(range(len(parts))) as col, trim(unnest(parts), ' ') as cell from rows)"""
NUM = "^[-+]?[0-9][0-9,. %/:-]*$"


def _cells(spark: SparkSession, root: str) -> DataFrame:
    return tb.pipe_cells(_chunk_lines(spark, root), ["run_id", "chunk_id"])


@query(f"""with {CELLS} select run_id, chunk_id, count(distinct k) as n_rows, (max(col) + 1)::bigint as n_columns, count(*) as n_cells, count(*) filter (cell <> '') as n_filled, sum(length(cell))::bigint as n_chars,
round(count(*) filter (cell <> '') / count(*), 4) as fill_ratio, round(count(*) filter (regexp_matches(cell, '{NUM}')) / count(*), 4) as numeric_ratio from cells group by 1, 2""")
def table_stats(spark, root):
    return tb.table_stats(_cells(spark, root), ["run_id", "chunk_id"], "reading_order")


@query(f"""with {CELLS}, r as (select run_id, chunk_id, k, count(*) filter (cell <> '') as filled, bool_or(regexp_matches(cell, '{NUM}')) as num from cells group by 1, 2, 3)
select run_id, chunk_id, min(k)::int as header_row from r where filled >= 2 and not num group by 1, 2""")
def table_header_rows(spark, root):
    return tb.header_rows(_cells(spark, root), ["run_id", "chunk_id"], "reading_order")


FILLED = """f as (select *, max(case when col = 0 then cell = '' end) over (partition by run_id, chunk_id, k) as goes_on, last_value(nullif(cell, '') ignore nulls) over (partition by run_id, chunk_id, col order by k rows between unbounded preceding and current row) as carried from {}),
filled as (select *, case when col < 2 and coalesce(goes_on, true) then coalesce(nullif(cell, ''), carried, '') else cell end as value from f)"""


@query(f"with {CELLS}, {FILLED.format('cells')} select run_id, chunk_id, k::int as reading_order, col::int as \"column\", value as filled from filled where col < 2")
def table_forward_fill(spark, root):
    return tb.forward_fill(_cells(spark, root), ["run_id", "chunk_id"], "reading_order").where("column < 2").select("run_id", "chunk_id", "reading_order", "column", "filled")


@query(f"""with {CELLS}, r as (select run_id, chunk_id, k, count(*) filter (cell <> '') as filled, bool_or(regexp_matches(cell, '{NUM}')) as num from cells group by 1, 2, 3),
h as (select run_id, chunk_id, min(k) as hk from r where filled >= 2 and not num group by 1, 2),
n as (select c.run_id, c.chunk_id, col, case when row_number() over (partition by c.run_id, c.chunk_id, cell order by col) > 1 then cell || '(' || row_number() over (partition by c.run_id, c.chunk_id, cell order by col) || ')' else cell end as name
 from cells c join h on c.run_id = h.run_id and c.chunk_id = h.chunk_id and c.k = hk where cell <> ''),
d as (select c.* from cells c join h on c.run_id = h.run_id and c.chunk_id = h.chunk_id and c.k > hk), {FILLED.format('d')},
a as (select *, max(cell <> '') over (partition by run_id, chunk_id, k) as any_cell from filled)
select a.run_id, a.chunk_id, a.k::int as reading_order, string_agg(coalesce(name, 'column ' || (a.col + 1)) || ': ' || value, '; ' order by a.col) as record
from a left join n on n.run_id = a.run_id and n.chunk_id = a.chunk_id and n.col = a.col where any_cell and value <> '' group by 1, 2, 3""")
def table_records(spark, root):
    return tb.to_records(_cells(spark, root), ["run_id", "chunk_id"], "reading_order")


@query()
def html_table_cells(spark, root):
    """Cells of the stored HTML tables (parser with span handling)."""
    c = table(spark, root, "chunks").select("run_id", "chunk_id", F.posexplode("metadata.table_html").alias("table_no", "html")).distinct()
    return tb.html_cells(c, ["run_id", "chunk_id", "table_no"], "html")


@query(r"""with t as (select distinct run_id, chunk_id, unnest(metadata.table_html) as html, unnest(range(len(metadata.table_html)))::int as table_no from chunks)
select run_id, chunk_id, table_no, len(regexp_extract_all(html, '<tr>'))::bigint as n_rows, len(regexp_extract_all(html, '<td>'))::bigint as n_cells from t""")
def html_table_sizes(spark, root):
    return html_table_cells(spark, root).groupBy("run_id", "chunk_id", "table_no").agg(F.countDistinct("row").alias("n_rows"), F.count("*").alias("n_cells"))


@query()
def html_table_markdown(spark, root):
    return tb.to_markdown(html_table_cells(spark, root), ["run_id", "chunk_id", "table_no"], "row")


# catalogue ----------------------------------------------------------------------------------------------------------


@query("select status, count(*) as n, count(distinct doc_id) as n_docs from runs group by status")
def run_stats(spark, root):
    return table(spark, root, "runs").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("select doc_id, max(run_id) as run_id from runs group by doc_id")
def latest_run_per_doc(spark, root):
    return catalog.latest(table(spark, root, "runs").select("doc_id", "run_id", F.col("run_id").alias("key")), ["doc_id"], "key").select("doc_id", "run_id")


@query("""with r as (select run_id, chunk_id, content, epoch_us(written_at) as t, row_number() over (partition by run_id, chunk_id order by written_at desc) as i from chunks)
select run_id, chunk_id, t as written_us, length(content)::int as n_chars from r where i = 1""")
def latest_chunks(spark, root):
    c = table(spark, root, "chunks").select("run_id", "chunk_id", F.unix_micros("written_at").alias("written_us"), F.length("content").alias("n_chars"))
    return catalog.latest(c.withColumn("o", F.col("written_us")), ["run_id", "chunk_id"], "o").drop("o")


@query("select run_id, doc_id, status from runs order by created_at desc, run_id desc limit 50 offset 100")
def paged_runs(spark, root):
    r = table(spark, root, "runs")
    return catalog.page(r, [F.col("created_at").desc(), F.col("run_id").desc()], 100, 50).select("run_id", "doc_id", "status")


@query("select r.run_id, r.doc_id from runs r where not exists (select 1 from docs d where d.doc_id = r.doc_id and d.meta_json is null)")
def anti_hidden(spark, root):
    hidden = table(spark, root, "docs").where("meta_json is null").select("doc_id")
    return catalog.invalidate(table(spark, root, "runs").select("run_id", "doc_id"), hidden, ["doc_id"])


@query("""with s as (select distinct id, run_id, stage, status from run_stages),
r as (select *, row_number() over (partition by run_id order by case status when 'running' then 3 when 'failed' then 2 when 'canceled' then 2 when 'succeeded' then 1 else 0 end desc, id desc) as i from s)
select run_id, stage, status from r where i = 1""")
def stage_progress(spark, root):
    return catalog.current_stage(table(spark, root, "run_stages").select("id", "run_id", "stage", "status").distinct())


@query("""with s as (select distinct id, stage, status, cast(json_extract_string(stats_json, '$.seconds') as bigint) as sec from run_stages)
select stage, count(*) as n, count(sec) as n_timed, sum(sec)::bigint as seconds from s group by stage""")
def timing_summary(spark, root):
    s = table(spark, root, "run_stages").select("id", "stage", "status", F.get_json_object("stats_json", "$.seconds").cast("bigint").alias("sec")).distinct()
    return s.groupBy("stage").agg(F.count("*").alias("n"), F.count("sec").alias("n_timed"), F.sum("sec").alias("seconds"))


@query("""select regexp_extract(d.source_path, '^/data/inbox/([^/]+)/', 1) as source, d.ext, count(*) as n_runs, count(*) filter (r.status = 'succeeded') as n_succeeded
from runs r left join docs d on r.doc_id = d.doc_id group by 1, 2""")
def runs_by_source(spark, root):
    d = table(spark, root, "docs").select("doc_id", "ext", F.regexp_extract("source_path", "^/data/inbox/([^/]+)/", 1).alias("source"))
    joined = table(spark, root, "runs").select("doc_id", "status").join(d, "doc_id", "left")
    return joined.groupBy("source", "ext").agg(F.count("*").alias("n_runs"), F.sum((F.col("status") == "succeeded").cast("bigint")).alias("n_succeeded"))


@query("select config_hash, count(*) as n, count(distinct config_json) as n_configs, min(run_id) as first_run from runs group by config_hash")
def config_groups(spark, root):
    return table(spark, root, "runs").groupBy("config_hash").agg(F.count("*").alias("n"), F.countDistinct("config_json").alias("n_configs"), F.min("run_id").alias("first_run"))


@query("""with r as (select run_id, config_hash, doc_id, row_number() over (partition by doc_id, config_hash order by run_id) as i from runs)
select a.run_id, case when a.i > 1 then b.run_id end as cached_run, a.i > 1 as hit from r a join r b on a.doc_id = b.doc_id and a.config_hash = b.config_hash and b.i = 1""")
def cache_lookup(spark, root):
    runs = table(spark, root, "runs").select("run_id", "doc_id", "config_hash")
    cache = runs.groupBy("doc_id", "config_hash").agg(F.min("run_id").alias("cached_run"))
    found = catalog.lookup(runs, cache, ["doc_id", "config_hash"], "cached_run")
    own = F.col("cached_run") == F.col("run_id")
    return found.select("run_id", F.when(~own, F.col("cached_run")).alias("cached_run"), (F.col("hit") & ~own).alias("hit"))


@query("""with p as (select distinct run_id, regexp_replace(chunk_id, '_part[0-9]+$', '') as whole, metadata.part_index as i, metadata.part_count as n from chunks where metadata.part_index is not null)
select run_id, whole, count(distinct i) as n_parts, max(i)::int as last_part, max(n)::int as part_count, coalesce(count(distinct i) = max(n) and max(i) = max(n), false) as whole_set from p group by 1, 2""")
def part_sets(spark, root):
    p = table(spark, root, "chunks").where("metadata.part_index is not null").select("run_id", F.regexp_replace("chunk_id", "_part[0-9]+$", "").alias("whole"), F.col("metadata.part_index").alias("i"), F.col("metadata.part_count").alias("n")).distinct()
    sets = p.groupBy("run_id", "whole").agg(F.countDistinct("i").alias("n_parts"), F.max("i").alias("last_part"), F.max("n").alias("part_count"))
    return sets.withColumn("whole_set", F.coalesce((F.col("n_parts") == F.col("part_count")) & (F.col("last_part") == F.col("part_count")), F.lit(False)))


@query(f"""with c as (select distinct run_id, chunk_id, content, metadata.heading_path is not null as has_path from chunks)
select run_id, count(*) as n_chunks, max({estimate_sql('content')})::bigint as max_tokens, round_even(sum({estimate_sql('content')}) / count(*), 1) as mean_tokens, count(*) filter (has_path) as n_with_path, count(*) filter ({estimate_sql('content')} > 512) as n_over from c group by run_id""")
def chunk_stats(spark, root):
    c = table(spark, root, "chunks").select("run_id", "chunk_id", "content", F.col("metadata.heading_path").isNotNull().alias("has_path")).distinct().withColumn("e", token_estimate("content"))
    return c.groupBy("run_id").agg(
        F.count("*").alias("n_chunks"), F.max("e").alias("max_tokens"), F.bround(F.sum("e") / F.count("*"), 1).alias("mean_tokens"), F.sum(F.col("has_path").cast("bigint")).alias("n_with_path"), F.sum((F.col("e") > 512).cast("bigint")).alias("n_over")
    )


@query(f"select run_id, chunk_id, {estimate_sql('content')}::bigint as tokens from (select distinct run_id, chunk_id, content from chunks)")
def chunk_estimates(spark, root):
    return table(spark, root, "chunks").select("run_id", "chunk_id", "content").distinct().select("run_id", "chunk_id", token_estimate("content").alias("tokens"))


# coverage, quality, retrieval ---------------------------------------------------------------------------------------

SAMPLES = "s as (select distinct run_id, unnest(evidence.missing_samples) as sample from quality_gate)"
FORM = r"regexp_replace({}, '[ \t\n\r\f\x0B\x{{A0}}\x{{3000}}\\]+', '', 'g')"


def _samples(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "quality_gate").select("run_id", F.explode("evidence.missing_samples").alias("sample")).distinct()


@query(f"""with {SAMPLES}, p as (select distinct run_id, {FORM.format('sample')} as f from s where sample is not null), t as (select run_id, {FORM.format('content')} as x from chunks where content is not null),
h as (select p.run_id, p.f, bool_or(contains(t.x, p.f)) as ok from p join t on p.run_id = t.run_id group by 1, 2)
select run_id, count(*) as n_checked, count(*) filter (ok) as n_survived, round(count(*) filter (ok) / count(*), 4) as survival from h group by run_id""")
def authored_survival(spark, root):
    return coverage.survival(_samples(spark, root).where("sample is not null"), table(spark, root, "chunks").where("content is not null"), "run_id", "sample", "content")


@query(r"""with s as (select distinct run_id, unnest(evidence.missing_samples) as sample from quality_gate), a as (select distinct run_id, unnest(regexp_extract_all(translate(sample, '０１２３４５６７８９％．，', '0123456789%.,'), '[0-9]+(?:[.,/:-][0-9]+)*')) as number from s),
b as (select distinct run_id, unnest(regexp_extract_all(translate(content, '０１２３４５６７８９％．，', '0123456789%.,'), '[0-9]+(?:[.,/:-][0-9]+)*')) as number from chunks) select run_id, number from a except select run_id, number from b""")
def coverage_number_gaps(spark, root):
    return coverage.number_gaps(_samples(spark, root), table(spark, root, "chunks"), "run_id", "sample", "content")


@query("select code, severity, count(*) as n, count(distinct run_id) as n_runs from (select distinct run_id, issue_no, code, severity from quality_gate where issue_no > 0) group by 1, 2")
def quality_issue_counts(spark, root):
    g = table(spark, root, "quality_gate").where("issue_no > 0").select("run_id", "issue_no", "code", "severity").distinct()
    return g.groupBy("code", "severity").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("n_runs"))


@query("""with q as (select distinct run_id, issue_no, severity from quality_gate)
select run_id, count(*) filter (issue_no > 0) as n_issues, round_even(greatest(0.0, 1.0 - round(sum(case when issue_no > 0 then case severity when 'high' then 0.25::double when 'medium' then 0.12::double when 'low' then 0.05::double else 0::double end else 0::double end), 6)), 3)::double as score,
case when bool_or(issue_no > 0 and severity = 'high') then 'needs_review' when bool_or(issue_no > 0 and severity = 'medium') then 'warning' else 'pass' end as status from q group by run_id""")
def quality_status_score(spark, root):
    return quality.score(table(spark, root, "quality_gate").select("run_id", "issue_no", "severity").distinct(), "run_id")


@query(r"""with r as (select 'broken_embed' as code, regexp_matches(content, '!\[[^\]]*\]\([^)]*\)|\[\[asset:[^\]]*\]\]') as x from chunks union all select 'ellipsis_end', regexp_matches(content, '(?:\.\.\.|…)[ \n]*$') from chunks
union all select 'residue', regexp_matches(content, '</?(?:table|tr|td|div|span)[ >]') from chunks union all select 'replacement_character', contains(content, chr(65533)) from chunks
union all select 'mixed_language', len(regexp_extract_all(content, '[\x{4E00}-\x{9FFF}]')) >= 4 and len(regexp_extract_all(content, '[A-Za-z]')) > len(regexp_extract_all(content, '[\x{4E00}-\x{9FFF}]')) * 0.6 from chunks
union all select 'no_text', length(trim(content, ' ')) = 0 from chunks) select code, count(*) filter (x) as n from r group by code""")
def quality_text_rules(spark, root):
    return quality.gate(table(spark, root, "chunks").select("content"), "content")


_EXPANSIONS_SQL = "map {" + ", ".join(f"'{k}': {v.split()}" for k, v in retrieval.EXPANSIONS.items()) + "}"
_SPACES_SQL = r"[ \t\n\r\f\x0B\x{A0}\x{3000}]+"
TERMS_SQL = f"""terms as (select item_id, list_concat(regexp_extract_all(lower(query), '[a-z0-9_]+'), list_filter(string_split_regex(lower(query), '{_SPACES_SQL}'), lambda t: length(t) >= 2)) as own from eval_items),
asked as (select item_id, list_distinct(list_concat(own, flatten(list_transform(own, lambda t: coalesce(({_EXPANSIONS_SQL})[t], []))))) as terms from terms)"""


@query(f"""with {TERMS_SQL}, e as (select item_id, unnest(terms) as term from asked), s as (select e.item_id, d.doc_id, count(*) as score from e join documents d on contains(lower(d.text), e.term) group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id desc) as place from s) select item_id, doc_id, 'document' as kind, score, place from r where place <= 3""")
def retrieval_topk(spark, root):
    """The three documents that hold most terms of each query, of all documents."""
    d = table(spark, root, "documents").where("text is not null").select("doc_id", F.lit("document").alias("kind"), "text")
    return retrieval.top_k(table(spark, root, "eval_items"), d, "query", "text", "item_id", "doc_id", 3).select("item_id", "doc_id", "kind", "score", "place")


@query("""with t as (select item_id, lang, unnest(list_distinct(expected_terms)) as term from eval_items), f as (select t.item_id, t.term, coalesce(bool_or(contains(lower(d.text), lower(t.term))), false) as ok from t left join documents d on d.lang = t.lang group by 1, 2)
select item_id, count(*) as n_expected, count(*) filter (ok) as n_found, round(count(*) filter (ok) / count(*), 4) as recall from f group by item_id""")
def golden_fact_recall(spark, root):
    """Expected terms of each item that a document labelled with the item's language holds (no sample of the items is among the documents)."""
    return retrieval.fact_recall(table(spark, root, "eval_items"), table(spark, root, "documents"), "lang", "expected_terms", "text", "item_id")


@query(f"with {TERMS_SQL} select item_id, list_sort(terms) as terms from asked")
def query_terms(spark, root):
    return table(spark, root, "eval_items").select("item_id", retrieval.query_terms("query").alias("terms"))


@query("""select source, count(*) as n, count(text) as n_texts, count(distinct lang) as n_langs, sum(length(text))::bigint as n_chars, count(*) filter (n_chars is distinct from length(text)) as n_stale from documents group by source""")
def source_summary(spark, root):
    d = table(spark, root, "documents")
    return d.groupBy("source").agg(
        F.count("*").alias("n"), F.count("text").alias("n_texts"), F.countDistinct("lang").alias("n_langs"), F.sum(F.length("text")).alias("n_chars"), F.sum((~F.col("n_chars").eqNullSafe(F.length("text"))).cast("bigint")).alias("n_stale")
    )
