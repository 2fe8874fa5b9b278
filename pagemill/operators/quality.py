"""Quality rules over issues and chunk texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HAN, _EMBED = "[\\x{4E00}-\\x{9FFF}]", "!\\[[^\\]]*\\]\\([^)]*\\)|\\[\\[asset:[^\\]]*\\]\\]"
# Weight of an issue by severity.
WEIGHTS = {"high": 0.25, "medium": 0.12, "low": 0.05}


def severity_weight(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = F.when(severity == name, F.lit(weight)).otherwise(out)
    return out


def score(issues: DataFrame, key: str) -> DataFrame:
    """(key, n_issues, score, status): one minus the weights of the issues, at least 0; status by the gravest."""
    real = F.col("issue_no") > 0
    return issues.groupBy(key).agg(
        F.sum(real.cast("int")).cast("bigint").alias("n_issues"),
        F.bround(F.greatest(F.lit(0.0), F.lit(1.0) - F.round(F.sum(F.when(real, severity_weight(F.col("severity"))).otherwise(0.0)), 6)), 3).alias("score"),
        F.when(F.max((real & (F.col("severity") == "high")).cast("int")) == 1, "needs_review")
        .when(F.max((real & (F.col("severity") == "medium")).cast("int")) == 1, "warning")
        .otherwise("pass")
        .alias("status"),
    )


def text_rules(text: Column) -> dict[str, Column]:
    """Rules on one text, by code."""
    latin, han = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[\\x{4E00}-\\x{9FFF}]"))
    return {
        "broken_embed": text.rlike("!\\[[^\\]]*\\]\\([^)]*\\)|\\[\\[asset:[^\\]]*\\]\\]"),
        "ellipsis_end": text.rlike("(?:\\.\\.\\.|…)[ \\n]*$"),
        "residue": text.rlike("</?(?:table|tr|td|div|span)[ >]"),
        "replacement_character": F.contains(text, F.lit("�")),
        "mixed_language": (han >= 4) & (latin > han * 0.6),
        "no_text": F.length(F.trim(text)) == 0,
    }


def gate(texts: DataFrame, text: str) -> DataFrame:
    """(code, n): texts that break each rule, counted in one pass."""
    rules = text_rules(F.col(text))
    counts = texts.agg(*(F.sum(F.coalesce(rule, F.lit(False)).cast("bigint")).alias(code) for code, rule in rules.items()))
    return counts.select(F.explode(F.create_map(*(x for code in rules for x in (F.lit(code), F.coalesce(F.col(code), F.lit(0))))))).toDF("code", "n")


# Spellings of the labels that the language rules know.
LABELS = {"zh-TW": ("zh", "zh-tw", "zh-hant", "zh-hant-tw", "chi", "zho", "chinese", "traditional-chinese"), "en": ("en", "en-us", "en-gb", "eng", "english")}


def label_of(column: Column) -> Column:
    x = F.replace(F.lower(F.trim(column)), F.lit("_"), F.lit("-"))
    out = F.lit(None).cast("string")
    for code, spelled in LABELS.items():
        out = F.when(x.isin(*spelled), code).otherwise(out)
    return out


def text_issues(texts: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, severity, n): what the texts of each key break, with counts, from one aggregate; the language rules ask for the key's label (``lang``)."""
    t = F.col(text)
    rules = text_rules(t)
    hits = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    counts = texts.groupBy(key).agg(
        F.sum(F.regexp_count(t, F.lit(_HAN))).alias("han"), F.sum(F.regexp_count(t, F.lit("[A-Za-z]"))).alias("latin"), F.sum(F.length(t)).alias("chars"), F.sum(F.regexp_count(t, F.lit(_EMBED))).alias("embeds"),
        *(hits(rules[k]).alias(k) for k in ("ellipsis_end", "residue", "replacement_character", "no_text")),
    ).join(labels, key, "left")
    zh, en = F.col("lang") == "zh-TW", F.col("lang") == "en"
    issues = (
        ("broken_embed", "high", F.col("embeds") > 0, "embeds"), ("ellipsis_end", "low", F.col("ellipsis_end") > 0, "ellipsis_end"), ("residue", "low", F.col("residue") > 0, "residue"),
        ("replacement_character", "medium", F.col("replacement_character") > 0, "replacement_character"), ("no_text", "low", F.col("no_text") > 0, "no_text"),
        ("english_noise_high", "medium", zh & (F.col("han") >= 40) & (F.col("latin") > F.col("han") * 0.6), "latin"), ("target_language_mismatch", "medium", en & (F.col("han") >= 4), "han"),
        ("zh_noise_in_english", "medium", en & (F.col("han") >= F.col("chars") * 0.15), "han"),
    )
    rows = F.filter(F.array(*(F.struct(F.coalesce(hit, F.lit(False)).alias("hit"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(n).cast("bigint").alias("n")) for code, severity, hit, n in issues)), lambda x: x["hit"])
    return counts.select(key, F.explode(rows).alias("x")).select(key, "x.code", "x.severity", "x.n")


def survival_issues(checks: DataFrame, least: int = 3, enough: float = 0.85, grave: float = 0.6) -> DataFrame:
    """``checks`` (checked, missing) of which too little was kept, with ``survival`` and ``severity``."""
    share = (F.col("checked") - F.col("missing")) / F.col("checked")
    found = checks.where(F.col("checked") >= least).withColumn("_s", share).where(F.col("_s") < enough)
    return found.withColumn("survival", F.round("_s", 4)).withColumn("severity", F.when(F.col("_s") < grave, "high").otherwise("medium")).drop("_s")


# Codes that speak against correctness and against readiness, and the repair that a code asks for.
INCORRECT = ("source_preview_missing", "structured_output_empty", "english_noise_high", "zh_noise_in_english", "target_language_mismatch", "enrichment_failed", "table_notes_missing")
UNREADY = ("residue", "ellipsis_end", "ocr_title_noise", "target_language_mismatch", "field_name_too_long", "merged_field_detected", "version_misclassified")
REPAIRS = {"residue": "rewrite_tables", "ocr_title_noise": "clean_titles", "target_language_mismatch": "rewrite_language", "structured_output_empty": "build_records", "ellipsis_end": "complete_sentences", "field_name_too_long": "split_fields", "merged_field_detected": "split_fields"}
PENALTIES = {"high": 0.2, "medium": 0.12, "low": 0.04}


def semantic(issues: DataFrame, key: str, enough: float = 0.92) -> DataFrame:
    """(key, correctness, readiness, repairs, needed): each issue takes its penalty off the scores of its classes (at least 0.06 off readiness); a repair is needed for a high or medium issue that has one, or if one is asked for while a score is under ``enough``."""
    code, severity = F.col("code"), F.col("severity")
    penalty = F.lit(PENALTIES["low"])
    for name, value in PENALTIES.items():
        penalty = F.when(severity == name, F.lit(value)).otherwise(penalty)
    off = lambda codes, p: F.sum(F.when(code.isin(*codes), p).otherwise(0.0))
    repair = F.create_map(*(F.lit(x) for pair in REPAIRS.items() for x in pair))[code]
    score = lambda x: F.greatest(F.lit(0.0), F.round(F.lit(1.0) - x, 3))
    out = issues.groupBy(key).agg(
        score(off(INCORRECT, penalty)).alias("correctness"), score(off(UNREADY, F.greatest(F.lit(0.06), penalty))).alias("readiness"), F.array_sort(F.collect_set(repair)).alias("repairs"),
        F.max(F.coalesce(severity.isin("high", "medium") & repair.isNotNull(), F.lit(False)).cast("int")).alias("_grave"),
    )
    needed = (F.col("_grave") == 1) | (F.size("repairs") > 0) & (F.least("correctness", "readiness") < enough)
    return out.select(key, "correctness", "readiness", "repairs", needed.alias("needed"))


def woven(cells: DataFrame, texts: DataFrame, sample: int = 40, least: int = 3, share: float = 0.9) -> DataFrame:
    """(doc, woven): whether the first ``sample`` telling cells of a document's tables stand in its text."""
    from pyspark.sql import Window

    form = lambda c: F.regexp_replace(c, "[ \\t\\n\\r\\f\\x0B\\x{A0}\\x{3000}]+", "")
    own = cells.withColumn("_form", F.substring(form("cell"), 1, 60)).where(F.length("_form") >= 2)
    own = own.withColumn("_k", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).where(F.col("_k") <= sample)
    met = own.join(texts.select("doc", form("text").alias("_text")), "doc")
    return met.groupBy("doc").agg(((F.count("*") >= least) & (F.avg(F.contains("_text", F.col("_form")).cast("int")) >= share)).alias("woven"))
