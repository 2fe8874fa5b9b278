"""Lexical retrieval and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pagemill.functions.arrow import slices
from pagemill.functions.text import col


# Terms that a term of a query also asks for.
EXPANSIONS = {
    "組織圖": "組織架構 架構圖 系統圖 流程圖 flowchart hierarchical hierarchy chart diagram structure",
    "架構": "結構 層級 階層 hierarchical hierarchy structure",
    "流程圖": "flowchart chart diagram",
    "系統圖": "架構圖 流程圖 flowchart diagram structure",
}
SPACES = "[ \\t\\n\\r\\f\\x0B\\x{A0}\\x{3000}]+"


def query_terms(query: Column | str) -> Column:
    """Distinct terms of a query, lower case, sorted: runs of ASCII letters, digits and underscores, parts between spaces of two characters or more, and what these expand to; null gives null."""
    q = F.lower(col(query))
    parts = F.filter(F.split(q, SPACES), lambda t: F.length(t) >= 2)
    terms = F.concat(F.regexp_extract_all(q, F.lit("([a-z0-9_]+)"), F.lit(1)), parts)
    known = F.create_map(*(x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))))
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.element_at(known, t), F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.concat(terms, more)))


def match_count(terms: Column, text: Column) -> Column:
    """How many of the terms a text holds."""
    low = F.lower(text)
    return F.aggregate(terms, F.lit(0), lambda n, t: n + F.contains(low, F.lower(t)).cast("int"))


#: Distinct terms of a query set that are sent to all tasks at most.
TERMS = 1_000_000


def scored(queries: DataFrame, candidates: DataFrame, query: str, text: str, query_id: str, candidate_id: str, on: list[str] | None = None) -> DataFrame:
    """(query_id, candidate_id, kind, score): how many terms of a query each candidate holds, of those that hold any; with ``on`` only candidates of the query's key.

    The queries are a stated set: their distinct terms go to all tasks, where one pass of an automaton over a candidate finds
    all that it holds, whatever their number. Terms lead back to queries by a join, so no query is joined with a text.
    """
    on = on or []
    asked = queries.select(query_id, *on, F.explode(query_terms(query)).alias("_term"))
    terms = sorted(r["_term"] for r in asked.select("_term").distinct().limit(TERMS + 1).collect())
    if len(terms) > TERMS:
        raise ValueError(f"more than {TERMS} distinct terms: split the query set")
    shared = queries.sparkSession.sparkContext.broadcast(terms)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = automaton(shared.value)
        for b in slices(batches, text):
            at, found = [], []
            for i, x in enumerate(b.column(text).to_pylist()):
                here = sorted(held(x.lower())) if x else []
                at += [i] * len(here)
                found += here
            keep = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(keep) for k in (*on, candidate_id, "kind")), pa.array(found, pa.string())], names=[*on, candidate_id, "kind", "_term"])

    kinds = ", ".join(f"{k} {candidates.schema[k].dataType.simpleString()}" for k in (*on, candidate_id, "kind"))
    hits = candidates.select(*on, candidate_id, "kind", text).mapInArrow(find, f"{kinds}, _term string")
    return hits.join(asked, [*on, "_term"]).groupBy(query_id, candidate_id, "kind").agg(F.count("*").alias("score"))


def automaton(terms: list[str]) -> Callable[[str], set[str]]:
    """A function from a text to those of ``terms`` that it holds."""
    try:
        import ahocorasick
    except ImportError:
        return lambda x: {t for t in terms if t in x}
    made = ahocorasick.Automaton()
    # short terms occur too often to be met one by one: they are asked for
    short, long = [t for t in terms if 0 < len(t) <= 2], [t for t in terms if len(t) > 2]
    for t in long:
        made.add_word(t, t)
    made.make_automaton()

    def held(x: str) -> set[str]:
        here = {t for t in short if t in x}
        return here | {t for _, t in made.iter(x)} if long else here

    return held


def top_k(queries: DataFrame, candidates: DataFrame, query: str, text: str, query_id: str, candidate_id: str, k: int, on: list[str] | None = None) -> DataFrame:
    """The k candidates (with a ``kind``) that hold most terms of each query; ties go to the greater kind, then the greater id. The top-k report is the feature; a candidate without any term has no place."""
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col("kind").desc(), F.col(candidate_id).desc())
    ranked = scored(queries, candidates, query, text, query_id, candidate_id, on)
    return ranked.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def fact_recall(queries: DataFrame, texts: DataFrame, on: str, terms: str, text: str, query_id: str) -> DataFrame:
    """(query_id, n_expected, n_found, recall): expected terms that some text of the key holds; null terms are none.

    The distinct terms of the query set go to all tasks (in blocks of ``TERMS``, the texts are read once for each); a task looks in a text
    only for terms of its key that it hasn't met yet, and returns each once, so no query is joined with a text.
    """
    each = queries.select(query_id, on, F.explode(F.array_distinct(F.array_compact(F.col(terms)))).alias("term")).withColumn("_low", F.lower("term"))
    asked = each.where(F.col(on).isNotNull()).select(on, "_low").distinct().orderBy(on, "_low").collect()
    read = texts.where(F.col(on).isNotNull() & F.col(text).isNotNull()).select(on, F.lower(F.col(text)).alias("_text"))
    schema = read.select(on).schema.add("_low", "string")
    held = [read.mapInArrow(_first_met([(r[on], r["_low"]) for r in asked[a : a + TERMS]], on, to_arrow_schema(schema)), schema) for a in range(0, len(asked), TERMS)]
    met = reduce(DataFrame.unionByName, held, texts.sparkSession.createDataFrame([], schema)).distinct().withColumn("_met", F.lit(1))
    found = each.join(met, [on, "_low"], "left").groupBy(query_id, "term").agg(F.max(F.coalesce("_met", F.lit(0))).alias("found"))
    return found.groupBy(query_id).agg(F.count("*").alias("n_expected"), F.sum("found").cast("bigint").alias("n_found"), F.round(F.avg("found"), 4).alias("recall"))


def _first_met(asked: list[tuple[object, str]], on: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that gives the pairs (key, term) of ``asked`` whose term some text of the key holds, each once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing: dict[object, set[str]] = {}
        for key, term in asked:
            missing.setdefault(key, set()).add(term)
        search = {key: (automaton(list(left)), len(left)) for key, left in missing.items()}
        for b in slices(batches, "_text"):
            out = []
            for key, x in zip(b.column(on).to_pylist(), b.column("_text").to_pylist()):
                left = missing.get(key)
                if not left:
                    continue
                here = search[key][0](x) & left
                here |= left & {""}
                left -= here
                out += [(key, t) for t in here]
                # what was met isn't looked for again
                if here and 2 * len(left) <= search[key][1]:
                    search[key] = automaton(list(left)), len(left)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return find
