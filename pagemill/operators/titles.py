"""Titles of documents: which line is one, how good it is, and what is taken where none is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import col, compact

HAN = "[\\x{4E00}-\\x{9FFF}]"
# Words of titles in Chinese and English, and their scores.
TERMS = ("辦法", "要點", "準則", "規程", "規定", "指引", "手冊", "範本", "懶人包", "作業流程", "流程圖", "區分表", "申請單", "報告書", "核銷", "操作說明", "使用說明", "說明書", "教學")
ENGLISH = ("application", "authorization", "authorisation", "certificate", "consent", "declaration", "form", "guide", "handbook", "instructions", "manual", "notice", "permission", "permit", "report", "request", "release", "return", "statement", "training", "worksheet")
TERM, HOW_TO, ENGLISH_TERM, PAIR, SENDER, LENGTH, ORGANISATION, ANNEX, ENOUGH = 18, 20, 9, 14, -35, 8, -30, -20, 20
#: Lines among which a title is looked for, and its longest form.
LINES, LONGEST = 180, 120
PAIRS = "(?:^|[^a-z])(?:training +guide|application +form|authori[sz]ation +for +release|release +of +information)(?:[^a-z]|$)"
RETURNS = "(?:^|[^a-z])(?:please +return|return +completed +forms?|mail +completed +forms?|where +to +(?:send|return))(?:[^a-z]|$)"
NAMES = "(?:辦法|要點|準則|規程|規定|指引|手冊|範本|懶人包|流程|區分表|申請單|報告書|核銷)"
ORGANISATIONS = "(?:各機關(?:（構）|[(]構[)])?|政府|文化局|智慧財產局|委員會|辦公室|中心|處|部|署|院|局)$"
STEP = "^[0-9]{1,3}[ ]*(?:[、)）]|[.](?:[^0-9]))"
GENERIC = ("內容", "資料列", "content", "rows", "table", "tablename", "tablecontent", "contenttype", "sourcedocument", "sourcefile", "sourcepage", "documenttype", "relatedsource", "tableofcontents", "contents", "toc")
#: Forms of lines that are no titles, on the text without white space.
BAD = (
    "^[【\\[（(][\\x{4E00}-\\x{9FFF}]{1,4}[】\\]）)]$", "^[0-9]+$", "(?i)^(?:[A-Z]*Figure[0-9]*|Table[0-9]*|Form(?:Page)?[0-9]*)$", "^.{0,2}$", "(?:核定|修正|訂定).{0,16}(?:施行|生效)|(?:施行|生效)[）)]?$", "第[0-9]+頁表格[0-9]+",
    "^[（(]?[壹貳參肆伍陸柒捌玖拾一二三四五六七八九十]+[）)]?[、.．]?[\\x{4E00}-\\x{9FFF}]{1,10}[:：]?$", "[。；;]", "(?i)事件編號|表單編號|申請日期|填表日期|xxx|xx[(]|序號",
)
CONTENTS = "[.…·]{3,}[ ]*[0-9]*$"


def cleaned(line: Column | str) -> Column:
    """A line as a title: without heading and list marks, emphasis and marks at its ends, white space collapsed."""
    x = F.regexp_replace(col(line), "^[ ]*(?:#{1,6}[ ]+|[-*][ ]+)?(?:TABLE:)?", "")
    x = F.regexp_replace(x, "[*_`]+", "")
    return F.regexp_replace(F.trim(F.regexp_replace(x, "[ \\t\\r\\x{A0}\\x{3000}]+", " ")), "^[#:： ]+|[#:： ]+$", "")


def is_step(title: Column) -> Column:
    """A numbered step, which is an action and no title."""
    return title.rlike(STEP)


def is_organisation(form: Column) -> Column:
    """The name of an office without the name of a document; ``form`` is without white space."""
    return ~form.rlike(NAMES) & form.rlike(ORGANISATIONS)


def is_meaningful_english(title: Column) -> Column:
    """Three words or more of three letters, one of them a word of titles, and no Han letter."""
    words = F.regexp_count(title, F.lit("[A-Za-z]{3,}"))
    return ~title.rlike(HAN) & (words >= 3) & F.lower(title).rlike("(?:^|[^a-z])(?:" + "|".join(ENGLISH) + ")s?(?:[^a-z]|$)")


def is_unreliable(title: Column) -> Column:
    form = compact(title)
    bad = form.rlike(BAD[0])
    for pattern in BAD[1:]:
        bad = bad | form.rlike(pattern)
    digits = ~form.rlike(HAN) & (F.regexp_count(form, F.lit("[0-9]")) >= 3) & ~is_meaningful_english(title)
    return (form == "") | F.lower(form).isin(*GENERIC) | bad | F.contains(title, F.lit(" > ")) | digits | (F.length(form) > 45) & form.rlike("[，,]")


def score(title: Column) -> Column:
    """How much speaks for a line as the title."""
    form, low = compact(title), F.lower(title)
    terms = sum((F.contains(form, F.lit(t)).cast("int") for t in TERMS), F.lit(0)) * TERM
    english = sum((low.rlike(f"(?:^|[^a-z]){t}s?(?:[^a-z]|$)").cast("int") for t in ENGLISH), F.lit(0))
    points = lambda hit, n: F.when(hit, n).otherwise(0)
    return (
        terms + points(form.startswith("如何"), HOW_TO) + F.least(english, F.lit(3)) * ENGLISH_TERM + points(low.rlike(PAIRS), PAIR) + points(low.rlike(RETURNS), SENDER)
        + points(F.length(form).between(10, 45), LENGTH) + points(is_organisation(form), ORGANISATION) + points(form.rlike("^(?:附件|附表)[一二三四五六七八九十0-9-]*$"), ANNEX)
    )


def candidates(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reading_order, title, score): lines that may be the title, with a score of ``ENOUGH`` or more."""
    t = lines.where(F.col("reading_order") < LINES).withColumn("title", cleaned("line"))
    good = F.length(compact("title")).between(6, 80) & ~is_step(F.col("title")) & ~is_unreliable(F.col("title")) & ~F.col("title").rlike(CONTENTS)
    return t.where(good).select(*keys, "reading_order", "title", score(F.col("title")).alias("score")).where(F.col("score") >= ENOUGH)


def inferred(documents: DataFrame, lines: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys, title, origin): the candidate with the highest score (the earlier of two), else the first heading that may stand, else the file's stem; cut to 120 characters."""
    best = candidates(lines, keys).groupBy(*keys).agg(F.max_by("title", F.struct("score", -F.col("reading_order"))).alias("_best"))
    heads = lines.where(F.col("line").rlike("^[ ]*#{1,6} ")).withColumn("title", cleaned("line"))
    heads = heads.where(~is_step(F.col("title")) & ~is_unreliable(F.col("title")) & ~F.col("title").rlike(CONTENTS)).groupBy(*keys).agg(F.min_by("title", "reading_order").alias("_head"))
    stem = cleaned(F.regexp_replace(F.regexp_extract(path, "([^/]+?)(?:[.][A-Za-z0-9]+)?$", 1), "_", " "))
    joined = documents.join(best, keys, "left").join(heads, keys, "left")
    title = F.coalesce("_best", "_head", F.nullif(stem, F.lit("")), F.lit("untitled"))
    origin = F.when(F.col("_best").isNotNull(), "line").when(F.col("_head").isNotNull(), "heading").when(stem != "", "path").otherwise("none")
    return joined.select(*keys, F.substring(title, 1, LONGEST).alias("title"), origin.alias("origin"))


def without_title_lines(lines: DataFrame, titles: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` without those among the first three that repeat the title."""
    joined = lines.join(titles.select(*keys, compact("title").alias("_t")), keys, "left")
    same = (F.col("reading_order") <= 2) & (compact(cleaned("line")) == F.col("_t")) & (F.col("_t") != "")
    return joined.where(~F.coalesce(same, F.lit(False))).select(*lines.columns)
