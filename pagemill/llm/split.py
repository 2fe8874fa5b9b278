"""Problem 6: cut oversized items into pieces within a token limit, at natural boundaries, with an overlap.

The text starts as atomic segments (sentences, lines, paragraphs; a segment that can't fit is broken further at
clauses, words and last of all characters). Adjacent pairs wait in a heap ordered by the strength of the boundary
between them, then by position; the weakest boundary is merged first, as long as the merged size plus the overlap
stays within the limit. A boundary that can't be merged stays a cut. Each piece after the first begins with the end of the text
before it: the longest run of whole words (of characters, in scripts without spaces) within the overlap.

Defined results: null and empty texts and texts within the limit give no pieces; an overlap of half the limit or
more is lowered to half the limit; a limit below 8 or null takes the default; a text without any boundary is cut at
characters; repeated rows of a key give one set of pieces, of the latest ``written_at`` (none, where that is within the limit); a
null key stays null, and rows with one are told apart by their content.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.tokens import estimate, is_wide, token_estimate
from pagemill.llm.arrow import slices
from pagemill.sources.tables import table

DEFAULT_LIMIT, DEFAULT_OVERLAP = 512, 50

# Boundaries by strength; a match ends where the next segment starts.
_BOUNDARIES = (
    (6, re.compile(r"\n+(?=#{1,6} )")),
    (5, re.compile(r"\n[ \t]*\n+")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[。！？]+[」』）]*|[.!?]+[\"'”»)]*\s+")),
)
_FINER = (
    (2, re.compile(r"[，；、：]|[,;:]\s+")),
    (1, re.compile(r"\s+|(?<=[぀-ヿ㐀-鿿])")),
    (0, re.compile(r"")),
)


class _Sizes:
    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.wide = np.concatenate([[0], np.cumsum(is_wide(points))]).tolist()

    def of(self, a: int, b: int) -> int:
        wide = self.wide[b] - self.wide[a]
        return estimate(wide, b - a - wide)


def _cuts(text: str, sizes: _Sizes, room: int) -> tuple[list[int], list[int]]:
    """Starts of the atomic segments, and the strength of the boundary before each of them."""
    strength: dict[int, int] = {}
    for s, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                strength.setdefault(m.end(), s)
    for s, pattern in _FINER:
        bounds = [0, *sorted(strength), len(text)]
        for a, b in zip(bounds, bounds[1:]):
            if sizes.of(a, b) > room:
                for m in pattern.finditer(text, a, b):
                    if a < m.end() < b:
                        strength.setdefault(m.end(), s)
    starts = [0, *sorted(strength)]
    return starts, [9, *(strength[x] for x in starts[1:])]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start of the overlap, start, end) of each piece, in code points."""
    sizes = _Sizes(text)
    if sizes.of(0, len(text)) <= limit:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap, limit // 2))
    room = limit - overlap
    starts, strength = _cuts(text, sizes, room)
    n = len(starts)
    ends = [*starts[1:], len(text)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def fits(i: int, j: int) -> bool:
        return sizes.of(starts[i], ends[j]) <= (limit if i == 0 else room)

    # sizes only grow, so a pair that doesn't fit now never will and isn't kept
    heap = [(strength[j], j) for j in range(1, n) if fits(j - 1, j)]
    heapq.heapify(heap)
    while heap:
        _, j = heapq.heappop(heap)
        i = before[j]
        if not fits(i, j):
            continue
        ends[i], alive[j], after[i] = ends[j], False, after[j]
        if after[i] < n:
            before[after[i]] = i
    out: list[tuple[int, int, int]] = []
    for i in range(n):
        if alive[i]:
            a = starts[i]
            out.append((_tail(text, sizes, out[-1][0], a, overlap) if out and overlap else a, a, ends[i]))
    return out


def _tail(text: str, sizes: _Sizes, low: int, end: int, overlap: int) -> int:
    """Where the longest ending of text[low:end] within ``overlap`` starts, moved on to the next word."""
    a, b = low, end
    while a < b:
        mid = (a + b) // 2
        if sizes.of(mid, end) <= overlap:
            b = mid
        else:
            a = mid + 1
    if a > low and text[a - 1].isalnum() and text[a].isalnum() and text[a - 1] < "぀":
        m = re.compile(r"[^\W_]*\W*").match(text, a, end)
        if m and m.end() < end:
            return m.end()
    return a


def with_limits(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunks above the token limit of their run, with ``limit_tokens`` and ``overlap_tokens``.

    Estimates are taken while scanning; only chunks above the smallest limit of all runs go into the join.
    """
    key = "$.package.chunk_{}_tokens"
    value = lambda what, least, default: F.expr(
        f"coalesce(if(v_{what} >= {least}, v_{what}, null), {default})"
    )
    limits = (
        runs.where("run_id is not null")
        .select("run_id", *(F.get_json_object("config_json", key.format(k)).cast("int").alias(f"v_{k}") for k in ("max", "overlap")))
        .select("run_id", value("max", 8, DEFAULT_LIMIT).alias("limit_tokens"), value("overlap", 0, DEFAULT_OVERLAP).alias("overlap_tokens"))
        .groupBy("run_id")
        .agg(F.min("limit_tokens").alias("limit_tokens"), F.min("overlap_tokens").alias("overlap_tokens"))
    )
    least = limits.agg(F.min("limit_tokens")).first()[0]
    least = DEFAULT_LIMIT if least is None else min(least, DEFAULT_LIMIT)
    large = chunks.withColumn("estimate", token_estimate("content")).where(F.col("estimate") > least)
    return (
        large.join(limits, "run_id", "left")
        .withColumn("limit_tokens", F.coalesce("limit_tokens", F.lit(DEFAULT_LIMIT)))
        .withColumn("overlap_tokens", F.coalesce("overlap_tokens", F.lit(DEFAULT_OVERLAP)))
        .where("estimate > limit_tokens")
    )


PIECE = "run_id string, parent_chunk_id string, chunk_id string, part_index int, part_count int, content string, overlap_chars int, estimate bigint"


def split_oversized(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Pieces of all chunks above their run's limit (columns of ``PIECE``)."""
    large = with_limits(chunks.select("run_id", "chunk_id", "content", "written_at"), runs)
    unknown = F.when(F.col("run_id").isNull() | F.col("chunk_id").isNull(), F.xxhash64("content"))
    latest = large.groupBy("run_id", "chunk_id", unknown.alias("unknown")).agg(
        F.max_by(F.struct("content", "limit_tokens", "overlap_tokens"), F.struct("written_at", "content")).alias("x"), F.max("written_at").alias("at")
    )
    # a later delivery within the limit takes the place of an oversized one; only times of keys with several are compared
    newest = chunks.groupBy("run_id", "chunk_id").agg(F.max("written_at").alias("newest"), F.min("written_at").alias("oldest")).where("newest > oldest").drop("oldest")
    latest = (
        latest.join(newest, ["run_id", "chunk_id"], "left")
        .where("unknown is not null or newest is null or at >= newest")
        .select("run_id", "chunk_id", "x.content", "x.limit_tokens", "x.overlap_tokens")
    )

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            out: list[list] = [[] for _ in range(8)]
            for run, chunk, text, limit, overlap in zip(*(b.column(k).to_pylist() for k in range(5))):
                parts = pieces(text, limit, overlap)
                for k, (o, a, e) in enumerate(parts, 1):
                    piece = text[o:e]
                    row = (run, chunk, None if chunk is None else f"{chunk}_part{k}", k, len(parts), piece, a - o, _Sizes(piece).of(0, len(piece)))
                    for column, x in zip(out, row):
                        column.append(x)
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64())
            names = ["run_id", "parent_chunk_id", "chunk_id", "part_index", "part_count", "content", "overlap_chars", "estimate"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return latest.mapInArrow(cut_up, PIECE)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    made = split_oversized(table(spark, root, "chunks"), table(spark, root, "runs"))
    return made.where("part_index = 1").select("run_id", F.col("parent_chunk_id").alias("chunk_id")).distinct()


def p6_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split_oversized(table(spark, root, "chunks"), table(spark, root, "runs"))


_ESTIMATE_SQL = "((2 * w + 2) // 3 + (n - w + 3) // 4)"
P6_FOUND_SQL = f"""
with limits as (
  select run_id, coalesce(cast(json_extract_string(config_json, '$.package.chunk_max_tokens') as int), 512) as m from runs),
sized as (
  select run_id, chunk_id, length(content) as n,
         length(regexp_replace(content, '[^\\x{{3000}}-\\x{{303F}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{FF00}}-\\x{{FFEF}}]', '', 'g')) as w
  from chunks)
select distinct s.run_id, s.chunk_id from sized s left join limits l on s.run_id = l.run_id
where {_ESTIMATE_SQL} > coalesce(l.m, 512)
"""
