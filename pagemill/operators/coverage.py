"""Coverage of source passages by delivered texts."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import col, coverage_form, normalized_text, numbers


def grams(text: Column | str, n: int = 4) -> Column:
    """All character n-grams of the normalised text, in order (array)."""
    t = normalized_text(text)
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def gram_ratio(source: Column | str, delivered: Column | str) -> Column:
    """Share of the source's n-grams, repeated ones counted each time, that the delivered text holds; 0 without any."""
    own, there = grams(source), F.array_distinct(grams(delivered))
    return F.size(F.filter(own, lambda g: F.array_contains(there, g))) / F.greatest(F.size(own), F.lit(1))


_TAG = re.compile(r"<!--.*?-->|<[^>]*>", re.S)
_NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?")
_OTHER = re.compile(r"[\W]+")


def _plain(text: str) -> str:
    return html.unescape(_TAG.sub(" ", text)) if "<" in text or "&" in text else text


def held(source: str, delivered: list[str], least: float = 0.98) -> bool:
    """Whether texts hold a passage: its numbers (with sign and decimals, commas aside) must all be there; then it is held whole, or from 12 letters on by ``least`` of its 4-grams, each counted as often as it occurs. A passage without letters is held."""
    own = _plain(source)
    wanted = _OTHER.sub("", own).casefold()
    if not wanted:
        return True
    there = [_plain(x) for x in delivered]
    digits = lambda x: set(_NUMBER.findall(x.replace(",", "").replace("，", "")))
    if not digits(own) <= set().union(*map(digits, there)):
        return False
    forms = [_OTHER.sub("", x).casefold() for x in there]
    if any(wanted in x for x in forms):
        return True
    if len(wanted) < 12:
        return False
    known = {x[i : i + 4] for x in forms for i in range(len(x) - 3)}
    return sum(wanted[i : i + 4] in known for i in range(len(wanted) - 3)) >= least * (len(wanted) - 3)


def covers(source: Column | str, delivered: Column | str, least: float = 0.98) -> Column:
    """``held`` of two columns; a null passage gives null, a null delivery holds only what has no letters."""

    @F.arrow_udf(T.BooleanType())
    def judge(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None else held(x, [y or ""], least) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    return judge(col(source), col(delivered))


def ledger(sources: DataFrame, texts: DataFrame, key: str, block: str, passage: str, text: str) -> DataFrame:
    """(key, block, covered): whether the texts of a key, taken together, hold each passage.

    A source passage is judged against all texts of its key: numbers and 4-grams of both sides meet by equi-joins on
    (key, gram), so that no key is gathered in one task; whole occurrences are not needed, since a passage that
    is held whole has all its 4-grams. Passages under 12 letters are looked for as they are.
    """
    form = lambda c: F.lower(F.regexp_replace(c, "[^\\p{L}\\p{N}_]", ""))
    own = sources.select(key, block, F.col(passage).alias("_raw"), form(F.col(passage)).alias("_form"))
    there = texts.select(key, F.col(text).alias("_raw"), form(F.col(text)).alias("_form")).where("_form <> ''")
    numbers_of = lambda df, *k: df.select(*k, F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("_raw", "[,，]", ""), F.lit("([+-]?[0-9]+(?:[.][0-9]+)?)"), F.lit(1)))).alias("_n"))
    lost = numbers_of(own, key, block).join(numbers_of(there, key).distinct(), [key, "_n"], "left_anti").select(key, block).distinct().withColumn("_lost", F.lit(True))
    pieces = lambda df, *k: df.where("length(_form) >= 4").select(*k, F.explode(F.transform(F.sequence(F.lit(1), F.length("_form") - 3), lambda i: F.substring("_form", i, F.lit(4)))).alias("_g"))
    asked = pieces(own.where("length(_form) >= 12"), key, block).groupBy(key, block, "_g").agg(F.count("*").alias("_n"))
    known = pieces(there, key).join(asked.select(key, "_g").distinct(), [key, "_g"], "left_semi").distinct().withColumn("_hit", F.lit(1))
    share = asked.join(known, [key, "_g"], "left").groupBy(key, block).agg((F.sum(F.when(F.col("_hit") == 1, F.col("_n"))) / F.sum("_n")).alias("_share"))
    short = own.where("length(_form) between 1 and 11").select(key, block, "_form")
    lists = short.groupBy(key).agg(F.collect_set("_form").alias("_asked"))
    found = there.join(lists, key).select(key, F.explode(F.filter("_asked", lambda p: F.contains(F.col("_form"), p))).alias("_form")).distinct().withColumn("_found", F.lit(True))
    short = short.join(found, [key, "_form"], "left").select(key, block, F.coalesce("_found", F.lit(False)).alias("_found"))
    out = own.join(lost, [key, block], "left").join(share, [key, block], "left").join(short, [key, block], "left")
    covered = F.when(F.col("_form") == "", F.lit(True)).when(F.coalesce("_lost", F.lit(False)), F.lit(False)).otherwise(F.coalesce("_found", F.col("_share") >= 0.98, F.lit(False)))
    return out.select(key, block, covered.alias("covered"))


#: Passages of a key that stand together in one row at most, on average.
BLOCK = 256


def survival(passages: DataFrame, texts: DataFrame, key: str, passage: str, text: str) -> DataFrame:
    """(key, n_checked, n_survived, survival): passages that some text of their key holds, white space aside.

    The passages of a key travel to its texts in blocks of a bounded size, so that no key's are gathered in one row; a text
    answers for a block in one row, and equal answers are combined before the shuffle. The join is on the key alone, so that AQE
    may split the texts of a key that has many.
    """
    form = passages.select(key, coverage_form(passage).alias("_p")).distinct()
    counts = form.groupBy(key).agg(F.count("*").alias("n_checked"))
    dealt = form.join(counts, key).withColumn("_block", F.pmod(F.xxhash64("_p"), F.ceil(F.col("n_checked") / BLOCK)))
    blocks = dealt.groupBy(key, "_block").agg(F.collect_list("_p").alias("_passages"))
    found = texts.select(key, coverage_form(text).alias("_text")).join(blocks, key)
    hits = found.select(key, F.explode(F.filter("_passages", lambda p: F.contains(F.col("_text"), p))).alias("_hit")).distinct()
    survived = hits.groupBy(key).agg(F.count("*").alias("n_survived"))
    asked = counts.join(texts.select(key).distinct(), key, "left_semi").join(survived, key, "left")
    return asked.select(key, "n_checked", F.coalesce("n_survived", F.lit(0)).alias("n_survived")).withColumn("survival", F.round(F.col("n_survived") / F.col("n_checked"), 4))


def number_gaps(passages: DataFrame, texts: DataFrame, key: str, passage: str, text: str) -> DataFrame:
    """(key, number): numbers of the passages that no text of the key holds."""
    wanted = passages.select(key, F.explode(numbers(col(passage))).alias("number")).distinct()
    # only texts of keys that ask for a number are read for theirs
    asked = texts.join(wanted.select(key).distinct(), key, "left_semi")
    there = asked.select(key, F.explode(numbers(col(text))).alias("number")).distinct()
    return wanted.join(there, [key, "number"], "left_anti")
