"""Document-level pipelines: chunks of whole documents, layout and graph operators over derived boxes, stream ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions.arrow import slices
from pagemill.operators import geometry, graph
from pagemill.operators.chunking import chunk_documents, chunks_of
from pagemill.sources.tables import shared_folder, table
from pagemill.streaming.ingest import event_windows, ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def document_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of all documents under 512 tokens with 50 of overlap."""
    return chunk_documents(table(spark, root, "documents"), "doc_id", "text")


@query("""select doc_id, true as bounded, true as whole, true as numbered from documents where length(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B\\x{A0}\\x{3000}]+', '', 'g')) > 0""")
def document_chunk_invariants(spark, root):
    """Every chunk is within the limit; every block stands whole in a chunk, or its parts laid together without their overlaps give it back; parts are numbered from 1 to their count."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [_held(x, chunks_of(x)) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows]) for k in range(3))], names=["doc_id", "bounded", "whole", "numbered"])

    documents = table(spark, root, "documents").select("doc_id", "text").where(F.length(tx.compact("text")) > 0)
    return documents.mapInArrow(check, "doc_id bigint, bounded boolean, whole boolean, numbered boolean")


def _held(text: str, chunks: list[tuple]) -> tuple[bool, bool, bool]:
    """What ``document_chunk_invariants`` states of one text: chunks are laid together again, oversized ones from their parts."""
    whole: list[tuple[int, int, str]] = []
    numbered, k = True, 0
    while k < len(chunks):
        _, parent, index, count, _, _, content, first, last, _ = chunks[k]
        parts = [content] if parent is None else [c[6] for c in chunks[k : k + count]]
        numbered &= parent is None or [(c[1], c[2], c[3]) for c in chunks[k : k + count]] == [(parent, i, count) for i in range(1, count + 1)]
        made = parts[0]
        for before, part in zip(parts, parts[1:]):
            # a part begins with the stated share of the end of the one before
            over = min(32, len(before) // 4)
            over = over if over and before.endswith(part[:over]) else 0
            made += part[over:]
        whole.append((first, last, made))
        k += len(parts)
    blocks = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
    at, held = 0, True
    for i, x in blocks:
        while at < len(whole) and whole[at][1] < i:
            at += 1
        held &= any(x in made for first, last, made in whole[at : at + 2] if first <= i <= last)
    return all(c[9] <= 512 for c in chunks), held, numbered


@query("""with b as (select run_id, chunk_id, unnest(block_ids) as block_id, unnest(range(len(block_ids))) as k from (select distinct run_id, chunk_id, block_ids from chunks)) select run_id, chunk_id, count(*) as n_blocks, count(distinct block_id) as n_distinct, min(block_id) as first_block, max(block_id) as last_block from b group by 1, 2""")
def block_spans(spark, root):
    c = table(spark, root, "chunks").select("run_id", "chunk_id", "block_ids").distinct().select("run_id", "chunk_id", F.explode("block_ids").alias("block_id"))
    return c.groupBy("run_id", "chunk_id").agg(F.count("*").alias("n_blocks"), F.countDistinct("block_id").alias("n_distinct"), F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"))


_BOXES_SQL = """boxes as (select run_id, row_number() over (partition by run_id order by chunk_id)::int as pos, (length(chunk_id) * 37 + row_number() over (partition by run_id order by chunk_id) * 53) % 7 * 100 as x0,
 (row_number() over (partition by run_id order by chunk_id) * 29) % 9 * 90 as y0 from (select distinct run_id, chunk_id from chunks))"""


def _boxes(spark: SparkSession, root: str) -> DataFrame:
    """Boxes on a page for each run, derived from chunk numbers (the tables hold no layout)."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("run_id").orderBy("chunk_id"))
    c = table(spark, root, "chunks").select("run_id", "chunk_id").distinct().withColumn("at", at)
    x0, y0 = (F.length("chunk_id") * 37 + F.col("at") * 53) % 7 * 100, F.col("at") * 29 % 9 * 90
    return c.select("run_id", "at", x0.cast("bigint").alias("x0"), y0.cast("bigint").alias("y0"), (x0 + 200).cast("bigint").alias("x1"), (y0 + 60).cast("bigint").alias("y1"))


@query(f"""with {_BOXES_SQL}, p as (select a.run_id, a.pos as first, b.pos as second, greatest(0, least(a.x0, b.x0) + 200 - greatest(a.x0, b.x0)) * greatest(0, least(a.y0, b.y0) + 60 - greatest(a.y0, b.y0)) as shared from boxes a join boxes b on a.run_id = b.run_id and a.pos < b.pos)
select run_id, first, second, round(shared::double / (24000 - shared), 6) as iou from p where shared::double / (24000 - shared) > 0.9""")
def overlapping_regions(spark, root):
    return geometry.overlapping(_boxes(spark, root), ["run_id"], "at").withColumn("iou", F.round("iou", 6))


@query()
def region_dedup(spark, root):
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("text", "table", "image", "unknown"))), F.col("at") % 4 + 1)
    return geometry.dedup_regions(_boxes(spark, root).withColumn("type", kinds), ["run_id"], "at").groupBy("run_id").agg(F.count("*").alias("n_kept"))


@query(f"""with {_BOXES_SQL}, l as (select run_id, pos as id, x0, y0, x0 + 200 as x1, y0 + 60 as y1, (y0 // 90)::int as level from boxes), pg as (select run_id, max(x1) as width, max(y1) as height from l group by run_id),
s as (select a.run_id, a.id as child, b.id as parent, round((case when least(a.x1, b.x1) <= greatest(a.x0, b.x0) then 0::double else (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / 200::double end * 0.4::double + (1::double - abs((a.y0 + a.y1) / 2::double - (b.y0 + b.y1) / 2::double) / height) * 0.3::double
 + (1::double - least(1::double, abs((a.x0 + a.x1) / 2::double - (b.x0 + b.x1) / 2::double) / (width * 0.3::double))) * 0.3::double) / (a.level - b.level), 6) as score
from l a join pg on pg.run_id = a.run_id join l b on a.run_id = b.run_id and b.level < a.level and a.level - b.level <= 3),
r as (select *, row_number() over (partition by run_id, child order by score desc, parent) as place from s) select run_id, child, parent, place::int as place from r where place <= 5""")
def org_parent_topk(spark, root):
    nodes = _boxes(spark, root).select("run_id", F.col("at").alias("id"), "x0", "y0", "x1", "y1", F.floor(F.col("y0") / 90).cast("int").alias("level"))
    return graph.parents(nodes, ["run_id"]).select("run_id", "child", "parent", "place")


@query()
def org_paths(spark, root):
    nodes = _boxes(spark, root).select("run_id", F.col("at").alias("id"), "x0", "y0", "x1", "y1", F.floor(F.col("y0") / 90).cast("int").alias("level"))
    best = graph.parents(nodes, ["run_id"], 1)
    return graph.paths(best.select("run_id", "child", "parent"), nodes.select("run_id", "id", F.col("id").cast("string").alias("name")), ["run_id"])


@query("select epoch_us(time_bucket(interval 1 hour, ts)) as window_us, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def event_hours(spark, root):
    return event_windows(table(spark, root, "events"))


@query("select count(distinct doc_id) as n_docs from docs")
def stream_ingest(spark, root):
    """New documents by a stream that takes what is there and stops; a second call takes nothing twice."""
    import uuid

    source = table(spark, root, "docs")
    place = f"{shared_folder(spark)}/pagemill/ingest-{uuid.uuid4().hex}"
    source.write.parquet(f"{place}/source")
    for _ in range(2):
        ingest(spark, f"{place}/source", source.schema, "doc_id", f"{place}/target", f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/target").agg(F.count("*").alias("n_docs"))


@query(r"""with c as (select distinct run_id, chunk_id, content from chunks where content is not null), q as (select run_id, count(distinct issue_no) filter (issue_no > 0) as n_issues from quality_gate group by run_id),
m as (select run_id, count(*) as n_chunks, sum(length(content))::bigint as n_chars, count(*) filter (regexp_matches(content, '(^|[^A-Za-z0-9.])([A-Za-z]{1,3})[0-9]{4,6}@|[A-Za-z]{2,}\\[A-Za-z][0-9]{4,6}([^0-9]|$)')) as n_masked from c group by run_id)
select r.doc_id, count(*) as n_runs, sum(coalesce(m.n_chunks, 0))::bigint as n_chunks, sum(coalesce(m.n_chars, 0))::bigint as n_chars, sum(coalesce(m.n_masked, 0))::bigint as n_masked, sum(coalesce(q.n_issues, 0))::bigint as n_issues
from runs r left join m on m.run_id = r.run_id left join q on q.run_id = r.run_id group by r.doc_id""")
def document_report(spark, root):
    """One row for each document: its runs, chunks, masked chunks and issues."""
    c = table(spark, root, "chunks").where("content is not null").select("run_id", "chunk_id", "content").distinct()
    hidden = F.col("content").rlike(tx.EMAIL_ID) | F.col("content").rlike(tx.DOMAIN_ACCOUNT)
    m = c.groupBy("run_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"), F.sum(hidden.cast("bigint")).alias("n_masked"))
    q = table(spark, root, "quality_gate").groupBy("run_id").agg(F.countDistinct(F.when(F.col("issue_no") > 0, F.col("issue_no"))).alias("n_issues"))
    joined = table(spark, root, "runs").select("run_id", "doc_id").join(m, "run_id", "left").join(q, "run_id", "left")
    total = lambda x: F.sum(F.coalesce(x, F.lit(0))).cast("bigint").alias(x)
    return joined.groupBy("doc_id").agg(F.count("*").alias("n_runs"), total("n_chunks"), total("n_chars"), total("n_masked"), total("n_issues"))
