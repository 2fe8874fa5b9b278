"""Further queries: line sequences, pages, notes, titles, cells, run metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import catalog, sequence
from pagemill.operators import tables as tb
from pagemill.operators.blocks import blocks, placed_blocks
from pagemill.plans.queries import CELLS, CHUNK_LINES, CHUNKS, LINES, MORE_CHUNKS, NUM, _more_chunks, _cells, _chunk_lines, _chunks, _lines, _placed_chunks
from pagemill.sources.files import SUPPORTED
from pagemill.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
MORE_LINES = CHUNK_LINES.replace(CHUNKS, MORE_CHUNKS)
PROSE = r"regexp_matches(line, '[。！？；]|[.!?;](?: |$)') or regexp_matches(line, '^[ ]*(?:[-*•]|[0-9]{1,3}[.)]) ')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"select ext, count(*) as n, sum(size_bytes)::bigint as n_bytes, count(distinct sha256) as n_contents from docs where lower(ext) in {SUPPORTED} group by ext")
def supported_files(spark, root):
    return table(spark, root, "docs").where(F.lower("ext").isin(*SUPPORTED)).groupBy("ext").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("n_bytes"), F.countDistinct("sha256").alias("n_contents"))


@query("select doc_id, source_path from docs order by created_at desc, doc_id desc limit 20 offset 40")
def paged_docs(spark, root):
    return catalog.page(table(spark, root, "docs"), [F.col("created_at").desc(), F.col("doc_id").desc()], 40, 20).select("doc_id", "source_path")


@query(f"with {LINES}, d as (select distinct line from lines where length(line) > 0) select ({PROSE}) as prose, regexp_matches(trim(line, ' '), '^[0-9]{{1,4}}$|^[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}$|^[A-Z]{{2,4}}-[0-9]{{3,6}}$') as watermark, count(*) as n from d group by 1, 2")
def line_classes(spark, root):
    d = _lines(spark, root).where("length(line) > 0").select("line").distinct()
    return d.groupBy(tx.looks_like_prose("line").alias("prose"), tx.is_watermark("line").alias("watermark")).agg(F.count("*").alias("n"))


@query(f"""with {LINES}, f as (select doc_id, k, not ({PROSE}) and length(trim(line, ' ')) > 0 as bare from lines), g as (select *, sum(case when bare then 0 else 1 end) over (partition by doc_id order by k rows between unbounded preceding and current row) as i from f)
select doc_id, min(k)::int as first, max(k)::int as last, count(*) as n from g where bare group by doc_id, i""")
def bare_line_runs(spark, root):
    lines = _lines(spark, root).withColumn("bare", ~tx.looks_like_prose("line") & (F.length(F.trim("line")) > 0))
    return sequence.islands(lines, ["doc_id"], "reading_order", "bare")


@query(f"""with {CHUNK_LINES}, t as (select *, line like '|%' as tab from lines), s as (select *, tab and not coalesce(lag(tab) over (partition by run_id, chunk_id order by k), false) as begins,
 last_value(case when not tab and trim(line, ' ') <> '' then line end ignore nulls) over (partition by run_id, chunk_id order by k rows between unbounded preceding and 1 preceding) as above from t)
select run_id, chunk_id, k::int as reading_order, above as caption from s where begins""")
def table_captions(spark, root):
    """The nearest line above each table."""
    return _placed_chunks(spark, root).where("begins").select("run_id", "chunk_id", "reading_order", F.col("above").alias("caption"))


@query(f"""with {MORE_LINES}, t as (select *, line like '|%' as tab from lines), b as (select *, tab and not coalesce(lag(tab) over (partition by run_id, chunk_id order by k), false) as begins from t),
n as (select *, sum(case when begins then 1 else 0 end) over (partition by run_id, chunk_id order by k rows between unbounded preceding and current row) as table_no from b),
x as (select *, row_number() over (partition by run_id, chunk_id, table_no order by k) as i from n where table_no > 0 and not tab and trim(line, ' ') <> '')
select run_id, chunk_id, table_no::bigint as table_no, k::int as reading_order from x where i <= 40""")
def notes_after_tables(spark, root):
    placed = placed_blocks(_more_chunks(spark, root), ["run_id", "chunk_id"], "content")
    return placed.where("table_no > 0 and text and text_no <= 40").select("run_id", "chunk_id", "table_no", "reading_order")


@query("""with i as (select run_id, issue_no, min(message) as message from quality_gate where message is not null group by 1, 2), k as (select *, regexp_replace(message, '[ \\t\\n\\r\\x{3000}]+', '', 'g') as f from i)
select run_id, min(issue_no)::int as issue_no, arg_min(message, issue_no) as message from k group by run_id, f""")
def message_dedup(spark, root):
    i = table(spark, root, "quality_gate").where("message is not null").groupBy("run_id", "issue_no").agg(F.min("message").alias("message"))
    return sequence.notes(i, ["run_id"], "issue_no", "message")


@query(rf"""with {CHUNK_LINES}, h as (select *, regexp_matches(line, '^[ ]*(?:From|To|Cc|Subject|Sent|RE|FW|Fwd|Betreff|Von|An|Objet|De|寄件者|收件者|主旨|差出人|件名)[ ]?[:：]') as head from lines),
d as (select *, head or (coalesce(lag(head) over (partition by run_id, chunk_id order by k), false) and regexp_matches(line, '^[ \t]+[^ ]')) as gone from h)
select run_id, chunk_id, count(*) filter (not gone) as n_kept, count(*) filter (gone) as n_dropped from d group by 1, 2 having count(*) filter (gone) > 0""")
def mail_lines(spark, root):
    keys = ["run_id", "chunk_id"]
    lines = _chunk_lines(spark, root)
    kept = sequence.drop_mail_lines(lines, keys, "reading_order", "line").groupBy(*keys).agg(F.count("*").alias("n_kept"))
    every = lines.groupBy(*keys).agg(F.count("*").alias("n")).join(kept, keys, "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    return every.where("n > n_kept").select(*keys, "n_kept", (F.col("n") - F.col("n_kept")).alias("n_dropped"))


@query("""with p as (select run_id, list_sort(list_distinct(flatten(list(page_indices)))) as p from chunks where page_indices is not null group by run_id)
select run_id, case when len(p) = 0 then '' when len(p) = 1 then p[1]::varchar when list_max(p) - list_min(p) + 1 = len(p) then list_min(p) || '-' || list_max(p) else array_to_string(p, ',') end as pages from p""")
def page_ranges(spark, root):
    p = table(spark, root, "chunks").where("page_indices is not null").select("run_id", F.explode("page_indices").alias("p")).distinct().groupBy("run_id").agg(F.collect_list("p").alias("p"))
    empty = table(spark, root, "chunks").where("page_indices is not null").select("run_id").distinct().join(p, "run_id", "left")
    return empty.select("run_id", tx.page_range(F.coalesce("p", F.array().cast("array<int>"))).alias("pages"))


@query("""with c as (select distinct run_id, chunk_id, metadata.heading as h, unnest(page_indices) as page from chunks where metadata.heading is not null)
select run_id, regexp_replace(h, '[ \\t\\n\\r\\f\\x0B\\x{A0}\\x{3000}]+', '', 'g') as heading, count(distinct page) as n_pages from c group by 1, 2 having count(distinct page) >= 2""")
def cross_page_headings(spark, root):
    c = table(spark, root, "chunks").where("metadata.heading is not null").select("run_id", "chunk_id", F.col("metadata.heading").alias("h"), F.explode("page_indices").alias("page")).distinct()
    return c.groupBy("run_id", tx.compact("h").alias("heading")).agg(F.countDistinct("page").alias("n_pages")).where("n_pages >= 2")


@query("""with c as (select distinct run_id, chunk_id, chunk_view, metadata.has_table as t, metadata.has_image as i, len(attachments) as a from chunks)
select run_id, count(*) as n_chunks, count(*) filter (chunk_view = 'rag') as n_rag, count(*) filter (t) as n_tables, count(*) filter (i) as n_images, sum(a)::bigint as n_attachments from c group by run_id""")
def run_metrics(spark, root):
    c = table(spark, root, "chunks").select("run_id", "chunk_id", "chunk_view", F.col("metadata.has_table").alias("t"), F.col("metadata.has_image").alias("i"), F.when(F.col("attachments").isNotNull(), F.size("attachments")).alias("a")).distinct()
    count = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("bigint"))
    return c.groupBy("run_id").agg(F.count("*").alias("n_chunks"), count(F.col("chunk_view") == "rag").alias("n_rag"), count(F.col("t")).alias("n_tables"), count(F.col("i")).alias("n_images"), F.sum("a").cast("bigint").alias("n_attachments"))


@query("""with c as (select run_id, count(distinct chunk_id) as n from chunks group by 1), o as (select r.doc_id, r.run_id, coalesce(c.n, 0) as n, lag(coalesce(c.n, 0)) over (partition by r.doc_id order by r.run_id) as p from runs r left join c on c.run_id = r.run_id)
select doc_id, run_id, n as n_chunks, (n - p)::bigint as delta from o where p is not null""")
def run_delta(spark, root):
    c = table(spark, root, "chunks").groupBy("run_id").agg(F.countDistinct("chunk_id").alias("n"))
    r = table(spark, root, "runs").select("doc_id", "run_id").join(c, "run_id", "left").withColumn("n_chunks", F.coalesce("n", F.lit(0)))
    before = F.lag("n_chunks").over(Window.partitionBy("doc_id").orderBy("run_id"))
    return r.withColumn("delta", F.col("n_chunks") - before).where("delta is not null").select("doc_id", "run_id", "n_chunks", "delta")


@query("""with i as (select distinct run_id, issue_no, code, severity, page_idx from quality_gate where issue_no > 0),
r as (select *, row_number() over (partition by run_id order by case severity when 'high' then 3 when 'medium' then 2 else 1 end desc, issue_no) as k from i) select run_id, issue_no, code, severity from r where k = 1""")
def gravest_issue(spark, root):
    i = table(spark, root, "quality_gate").where("issue_no > 0").select("run_id", "issue_no", "code", "severity").distinct()
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    return i.groupBy("run_id").agg(F.max_by(F.struct("issue_no", "code", "severity"), F.struct(rank, -F.col("issue_no"))).alias("x")).select("run_id", "x.*")


@query("select run_id, max(stats.issue_count)::int as stated, count(distinct issue_no) filter (issue_no > 0) as counted, max(stats.issue_count) is distinct from count(distinct issue_no) filter (issue_no > 0) as differs from quality_gate group by run_id")
def issue_count_mismatch(spark, root):
    g = table(spark, root, "quality_gate").groupBy("run_id").agg(F.max("stats.issue_count").alias("stated"), F.countDistinct(F.when(F.col("issue_no") > 0, F.col("issue_no"))).alias("counted"))
    return g.withColumn("differs", ~F.col("stated").eqNullSafe(F.col("counted")))


@query(f"""with {CELLS.replace(CHUNK_LINES, MORE_LINES)}, x as (select run_id, chunk_id, k, col, cell, row_number() over (partition by run_id, chunk_id, k, cell order by col) as i from cells where cell <> '')
select run_id, chunk_id, k::int as reading_order, col::int as "column", case when i > 1 then cell || '(' || i || ')' else cell end as numbered from x where i > 1""")
def repeated_cells(spark, root):
    cells = tb.pipe_cells(blocks(_more_chunks(spark, root), ["run_id", "chunk_id"], "content"), ["run_id", "chunk_id"]).where("text <> ''")
    made = tb.number_repeats(cells, ["run_id", "chunk_id", "reading_order"], "column", "text")
    return made.where("numbered <> text").select("run_id", "chunk_id", "reading_order", "column", "numbered")


@query(f"""with {CELLS}, t as (select run_id, chunk_id, count(distinct k) as n_rows, max(col) + 1 as n_columns, sum(length(cell)) / count(*) as per_cell, count(*) filter (cell <> '') / count(*) as fill, count(*) filter (regexp_matches(cell, '{NUM}')) / count(*) as num from cells group by 1, 2)
select case when n_rows <= 1 or n_columns <= 1 or fill < 0.3 or per_cell < 2 then 'layout' when n_rows < 3 then 'small' when n_rows > 40 then 'truncate' else 'accept' end as gate, count(*) as n from t group by 1""")
def table_gates(spark, root):
    s = tb.table_stats(_cells(spark, root), ["run_id", "chunk_id"], "reading_order")
    layout = (F.col("n_rows") <= 1) | (F.col("n_columns") <= 1) | (F.col("n_filled") / F.col("n_cells") < 0.3) | (F.col("n_chars") / F.col("n_cells") < 2)
    return s.groupBy(F.when(layout, "layout").when(F.col("n_rows") < 3, "small").when(F.col("n_rows") > 40, "truncate").otherwise("accept").alias("gate")).agg(F.count("*").alias("n"))


@query(f"""with {CHUNKS}, v as (select run_id, chunk_id, regexp_extract(content, '((?:[vV]|Ver\\.? ?|Rev\\.? ?)[0-9]+(?:\\.[0-9]+)+)', 1) as version from c) select version, count(*) as n from v where version <> '' group by version""")
def version_stamps(spark, root):
    return _chunks(spark, root).select(tx.version_text("content").alias("version")).where("version <> ''").groupBy("version").agg(F.count("*").alias("n"))


@query("""with t as (select doc_id, json_extract_string(meta_json, '$.title') as title, source_path from docs where meta_json is not null)
select doc_id, coalesce(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '', 'g') = regexp_replace(lower(regexp_extract(source_path, '([^/]+?)(?:\\.[A-Za-z0-9]+)?$', 1)), '[^\\p{L}\\p{N}]+', '', 'g'), false) as same_title, coalesce(length(title), 0)::int as n_title from t""")
def title_check(spark, root):
    t = table(spark, root, "docs").where("meta_json is not null").select("doc_id", F.get_json_object("meta_json", "$.title").alias("title"), F.regexp_extract("source_path", "([^/]+?)(?:\\.[A-Za-z0-9]+)?$", 1).alias("stem"))
    key = lambda x: F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]+", "")
    return t.select("doc_id", F.coalesce(key("title") == key("stem"), F.lit(False)).alias("same_title"), F.coalesce(F.length("title"), F.lit(0)).alias("n_title"))


@query("""select e.item_id, count(distinct d.doc_id) as n_documents, case when count(distinct d.doc_id) > 0 then 'evaluated' else 'missing_sample' end as status from eval_items e left join documents d on d.sample_id = e.sample_id group by e.item_id""")
def queries_with_samples(spark, root):
    """Every query with the documents of its sample; a query whose sample isn't there says so."""
    e = table(spark, root, "eval_items").select("item_id", "sample_id")
    n = e.join(table(spark, root, "documents").select("sample_id", "doc_id"), "sample_id", "left").groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))
    return n.withColumn("status", F.when(F.col("n_documents") > 0, "evaluated").otherwise("missing_sample"))


@query("""with a as (select source, lang, doc_kind, count(*) as n from documents group by grouping sets ((source), (lang), (doc_kind), ())) select source, lang, doc_kind, n from a""")
def document_rollup(spark, root):
    d = table(spark, root, "documents")
    return d.groupingSets([[d.source], [d.lang], [d.doc_kind], []], d.source, d.lang, d.doc_kind).agg(F.count("*").alias("n"))


@query("""with p as (select distinct run_id, regexp_replace(chunk_id, '_part[0-9]+$', '') as whole, metadata.part_index as i from chunks where metadata.part_index is not null), m as (select run_id, whole, max(i) as m from p group by 1, 2)
select m.run_id, m.whole, k::int as missing_part from m, unnest(range(1, m.m + 1)) as u(k) where not exists (select 1 from p where p.run_id = m.run_id and p.whole = m.whole and p.i = k)""")
def missing_parts(spark, root):
    p = table(spark, root, "chunks").where("metadata.part_index is not null").select("run_id", F.regexp_replace("chunk_id", "_part[0-9]+$", "").alias("whole"), F.col("metadata.part_index").alias("missing_part")).distinct()
    wanted = p.groupBy("run_id", "whole").agg(F.max("missing_part").alias("m")).select("run_id", "whole", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("missing_part"))
    return wanted.join(p, ["run_id", "whole", "missing_part"], "left_anti")


