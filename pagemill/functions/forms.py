"""Marks of forms, labels and notes in texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import col

# Boxes, blanks, blank dates and words of signing; openings of notes and of sections.
MARKERS = "[□☐☑]|_{3,}|[ ]年[ ]+月[ ]+日|簽章|簽核|簽名|核章|Signature"
SIGNING = "簽章|簽核|簽名|核章|Signature|Unterschrift|signature"
NOTE = "^[ ]*(?:※|註|注意|備註|說明|附註|Notes?[ ]*[:：.])"
SECTION = "^[ ]*(?:[壹貳參肆伍陸柒捌玖拾]|[一二三四五六七八九十]{1,3})[、.．]"
LABEL = "(?:^|[\\n|])[ ]*([^\\n|:：]{1,32})[:：](?!//)"


def has_markers(text: Column | str) -> Column:
    """Boxes, blanks, a blank date or a word of signing."""
    return col(text).rlike(MARKERS)


def colon_labels(text: Column | str, words: int = 6) -> Column:
    """Labels before a colon at the start of a line or cell; schemes of addresses and labels of more words drop out."""
    found = F.regexp_extract_all(col(text), F.lit(LABEL), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: (t != "") & (F.size(F.split(t, " +")) <= words) & ~F.lower(t).isin("http", "https", "ftp", "mailto"))


def form_score(text: Column | str) -> Column:
    """2 for each box, 1 for each colon label (12 at most), 1 for each word of signing (6 at most)."""
    x = col(text)
    return F.regexp_count(x, F.lit("[□☐☑]")) * 2 + F.least(F.size(colon_labels(x)), F.lit(12)) + F.least(F.regexp_count(x, F.lit(SIGNING)), F.lit(6))


def note_items(text: Column | str) -> Column:
    """A note with numbered points as one text for each; what stands before the first number is one as well."""
    parts = F.split(F.regexp_replace(col(text), "(?:^|[ ])(?=[0-9]{1,2}[.、)）][ ]*[^0-9])", "\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def sections(rows: Column | str) -> Column:
    """Texts that open with a Chinese number, cut to 80 characters, each once."""
    return F.array_distinct(F.transform(F.filter(col(rows), lambda t: t.rlike(SECTION)), lambda t: F.substring(F.trim(t), 1, 80)))


def notes(rows: Column | str) -> Column:
    """Texts that open like a note, each once."""
    return F.array_distinct(F.transform(F.filter(col(rows), lambda t: t.rlike(NOTE)), lambda t: F.trim(t)))


def is_form_path(path: Column | str) -> Column:
    """A file name that says form; Latin cues as whole words."""
    x = F.lower(F.regexp_extract(col(path), "([^/]+)$", 1))
    return x.rlike("表單|申請書|申請表|申請單|報名表|(?:^|[^a-z])(?:form|application|worksheet|formular|antrag|formulaire)s?(?:[^a-z]|$)")
