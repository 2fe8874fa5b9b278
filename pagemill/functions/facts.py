"""Facts and terms of texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import col, fullwidth_fold

NUMBER = "([0-9]+(?:[.,][0-9]+)*%?)"
LABEL = "([^ \\t\\n\\r\\x{A0}\\x{3000}:：;；,，.。、!！?？…‧·•|()（）【】\\[\\]{}<>\"'「」『』]{1,24})[:：]"
LEGAL = "(第[ ]*[0-9〇零一二三四五六七八九十百千兩]{1,8}[ ]*[條条項项款])"
HAN = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]"


def _all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(1))


def value_tokens(text: Column | str) -> Column:
    """Distinct numbers (percent signs kept) and legal references, sorted; full-width digits folded."""
    x = fullwidth_fold(text)
    legal = F.transform(_all(x, LEGAL), lambda t: F.replace(t, F.lit(" "), F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(_all(x, NUMBER), legal)))


def fact_tokens(text: Column | str) -> Column:
    """``value_tokens`` and the labels before a colon that hold a Han letter."""
    x = fullwidth_fold(text)
    labels = F.transform(_all(x, LABEL), lambda t: F.regexp_replace(t, "^[#*_`>~—–\\x{2d}‧·•]+|[#*_`>~—–\\x{2d}‧·•]+$", ""))
    return F.array_sort(F.array_distinct(F.concat(value_tokens(text), F.filter(labels, lambda t: t.rlike(HAN)))))


def is_noise(token: Column) -> Column:
    """Whole numbers of one or two digits and fallback names of columns."""
    return token.rlike("^[0-9]{1,2}$|^(?:欄位|Column[ ]*)[0-9]+$")


def survives(token: Column, text: Column) -> Column:
    """Whether a text holds a token, as it is or without white space and commas."""
    bare = lambda c: F.regexp_replace(c, "[ \\t\\n\\r\\x{A0}\\x{3000},，]+", "")
    return F.contains(text, token) | (bare(token) != "") & F.contains(bare(text), bare(token))


def kept(original: Column | str, repaired: Column | str, least: float = 0.9) -> Column:
    """(checked, missing, ratio, ok): the facts of a text that a repaired one still has; asset marks and noise don't count, a text without facts is kept."""
    own = F.filter(fact_tokens(F.regexp_replace(col(original), "\\[\\[asset:[^\\]]+\\]\\]", " ")), lambda t: ~is_noise(t))
    there = fullwidth_fold(repaired)
    missing = F.filter(own, lambda t: ~survives(t, there))
    ratio = F.when(F.size(own) == 0, F.lit(1.0)).otherwise((F.size(own) - F.size(missing)) / F.size(own))
    return F.struct(F.size(own).alias("checked"), missing.alias("missing"), F.round(ratio, 4).alias("ratio"), (ratio >= least).alias("ok"))


# Words of the mainland and of Taiwan, and glyphs that Taiwan writes otherwise.
VOCABULARY = (("界面(?!活性)", "介面"), ("默認", "預設"), ("圖標", "圖示"), ("分辨率", "解析度"), ("視頻", "影片"), ("軟件", "軟體"), ("硬盤", "硬碟"), ("鼠標", "滑鼠"))
GLYPHS = ("凈説", "淨說")


def taiwan_words(text: Column | str) -> Column:
    """Words of the mainland in Chinese texts, written as in Taiwan; lines with kana are Japanese and keep their glyphs."""
    x = col(text)
    fixed = F.translate(x, *GLYPHS)
    x = F.when(x.rlike("[\\x{3040}-\\x{30FF}]"), x).otherwise(fixed)
    for pattern, to in VOCABULARY:
        x = F.regexp_replace(x, pattern, to)
    return F.when(col(text).rlike("[\\x{4E00}-\\x{9FFF}]"), x).otherwise(col(text))


def split_names(text: Column | str) -> Column:
    """(zh, en) of ``name(Name)``; without a bracket at the end all of it is zh; empty parts are null."""
    x = F.trim(col(text))
    zh, en = (F.trim(F.regexp_extract(x, "^(.*?)[(](.*?)[)][ ]*$", k)) for k in (1, 2))
    both = x.rlike("^(.*?)[(](.*?)[)][ ]*$")
    none = lambda c: F.nullif(c, F.lit(""))
    return F.struct(F.when(both, none(zh)).otherwise(none(x)).alias("zh"), F.when(both, none(en)).alias("en"))


def join_names(zh: Column | str, en: Column | str) -> Column:
    a, b = F.nullif(col(zh), F.lit("")), F.nullif(col(en), F.lit(""))
    return F.coalesce(F.concat(a, F.lit("("), b, F.lit(")")), a, b, F.lit(""))


def coerced(parts: Column | str) -> Column:
    """The texts of a list that aren't empty with a space between; empty for null."""
    return F.coalesce(F.array_join(F.filter(col(parts), lambda t: F.coalesce(F.trim(t), F.lit("")) != ""), " "), F.lit(""))


def version_stamp(text: Column | str) -> Column:
    """(raw, date) of the first dated edition (``112.06.20修正版``), else of a compact one; null without."""
    x = F.replace(col(text), F.lit("．"), F.lit("."))
    dated, compact = "([0-9]{2,3}[.][0-9]{1,2}[.][0-9]{1,2})[ ]*(?:核定|核准|修正|修訂)?版", "([0-9]{6,8})[ ]*(?:核定|核准|修正|修訂)?版"
    return F.when(x.rlike(dated), F.struct(F.regexp_extract(x, dated, 0).alias("raw"), F.regexp_extract(x, dated, 1).alias("date"))).when(x.rlike(compact), F.struct(F.regexp_extract(x, compact, 0).alias("raw"), F.regexp_extract(x, compact, 1).alias("date")))
