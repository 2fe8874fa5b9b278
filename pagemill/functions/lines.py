"""Text functions that need a loop over lines or characters, as Arrow functions: one call for each batch."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import col


def mapped(f: Callable, kind: T.DataType = T.StringType()) -> Callable[..., Column]:  # noqa: B008
    """``f`` of one or more values as a function of columns; a null in the first gives null."""
    arrow = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64()}
    made = arrow.get(type(kind)) or (pa.list_(pa.int32()) if kind == T.ArrayType(T.IntegerType()) else pa.list_(pa.string()))
    judge = lambda *a: pa.array([None if x[0] is None else f(*x) for x in zip(*(c.to_pylist() for c in a))], made)

    @F.arrow_udf(kind)
    def one(a: pa.Array) -> pa.Array:
        return judge(a)

    @F.arrow_udf(kind)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return judge(a, b)

    @F.arrow_udf(kind)
    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return judge(a, b, c)

    return lambda *columns: (one, two, three)[len(columns) - 1](*map(col, columns))


# forms --------------------------------------------------------------------------------------------------------------


def lookup_form(text: str) -> str:
    """Letters and digits only, in compatibility form: a printed line as it is looked up."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text))


def offsets(text: str) -> list[int]:
    """Places of the characters that stay when white space is taken out."""
    return [i for i, c in enumerate(text) if not c.isspace()]


def title_noise(text: str) -> str:
    """A title without marks at its ends and the signs that a bad reading puts behind a table number or before a place."""
    x = re.sub(r"\s+", " ", text).strip("#:： ")
    x = re.sub(r"(表[一二三四五六七八九十0-9]+)\s*[〇○昇鑑箇]+", r"\1", x)
    return re.sub(r"[昇鑑](?=台灣|臺灣|國內|國外|大台北|大臺北)", "", x).strip("#:： ")


# Signs that a Latin line takes from boxes and rules, and what they stand for.
LATIN_NOISE = {"口": "", "日": "", "出": "", "文": "", "圖": "", "图": "", "一": " - "}


def latin_line(line: str) -> str:
    """A mostly Latin line with at most three Han letters: those that are noise and stand alone go, punctuation is put in order; other lines stay."""
    han = [i for i, c in enumerate(line) if "一" <= c <= "鿿"]
    if not 0 < len(han) <= 3 or sum(c.isascii() and c.isalpha() for c in line) < max(4, 3 * len(han)):
        return line
    alone = {i for i in han if i - 1 not in han and i + 1 not in han}
    x = "".join(LATIN_NOISE.get(c, c) if i in alone else c for i, c in enumerate(line))
    for pattern, to in ((r"^(\s*[-*]\s+)[,;:|\-\s]+", r"\1"), (r"\s+([,.;:])", r"\1"), (r"[|,;:]\s*$", ""), (r"[ \t]{2,}", " "), (r"\s+-\s+", " - ")):
        x = re.sub(pattern, to, x)
    return x.strip() if line[:1].strip() else x.rstrip()


# sections -----------------------------------------------------------------------------------------------------------

# Headings of a template that say nothing, and one that does only with text under it.
EMPTY_HEADINGS = ("內容", "資料列", "content", "rows", "tablecontent")
IDLE_HEADINGS = ("常見查詢主題", "commonquerytopics")
_HEAD = re.compile(r"\s*#{1,6}\s+(.+?)\s*$")


def _key(text: str) -> str:
    return re.sub(r"[、，,。．.：:()（）\[\]【】\-–—_\s]+", "", text.strip("#* ")).lower()


def without_empty_sections(text: str) -> str:
    """Without headings of the template, and without a line that the next heading repeats."""
    lines = text.split("\n")
    following: list[str | None] = [None] * len(lines)
    near = None
    for i in range(len(lines) - 1, -1, -1):
        following[i] = near
        near = lines[i] if lines[i].strip() else near
    out = []
    for line, after in zip(lines, following):
        m = _HEAD.match(line)
        if m:
            key = _key(m[1])
            if key in EMPTY_HEADINGS or key in IDLE_HEADINGS and (after is None or _HEAD.match(after)):
                continue
        elif after is not None and line.strip() and (n := _HEAD.match(after)) and _key(line) == _key(n[1]):
            continue
        out.append(line)
    return "\n".join(out)


def heading_sections(text: str, least: int = 240, most: int = 2400) -> list[tuple[str, list[str]]]:
    """(section, path) of a Markdown text: cut at headings of the first three levels once ``least`` characters are full, longer ones at paragraphs."""
    stack: list[tuple[int, str]] = []
    found: list[tuple[list[str], list[str]]] = [([], [])]
    for line in text.strip().split("\n"):
        m = re.match(r"(#{1,6})\s+(.*)$", line)
        if m and len(m[1]) <= 3 and len("\n".join(found[-1][0])) >= least:
            found.append(([], []))
        if m:
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2].strip()))
            found[-1] = (found[-1][0], [t for _, t in stack])
        found[-1][0].append(line)
    out = []
    for lines, path in found:
        section = "\n".join(lines).strip()
        parts = [section]
        if len(section) > most:
            parts = []
            for paragraph in re.split(r"\n\s*\n", section):
                if parts and len(parts[-1]) + 2 + len(paragraph) <= most:
                    parts[-1] += "\n\n" + paragraph
                else:
                    parts.append(paragraph)
        out += [(p.strip(), path) for p in parts if p.strip()]
    return out


# mail ---------------------------------------------------------------------------------------------------------------

# Lines of a mail program's list.
_SUBJECT = re.compile(r"\s*(?:RE|FW|Fwd|回覆|轉寄)[:：]", re.I)
_HEADER = re.compile(r"\s*(?:From|To|Cc|Subject|Sent|Betreff|Von|An|Objet|De|寄件者|收件者|主旨|差出人|件名)[ ]?[:：]")
_REGION = re.compile(r"(?:全部|未讀取|已讀取|收件匣\s*\d*|日期[:：]\s*(?:今天|昨天|本週|上週|上個月|較舊|更舊))$")
_CROPPED = re.compile(r"(?:\.{2,}|…)\s*$")
_ACCELERATOR = re.compile(r"\([A-Za-z0-9]\)(?:\.{2,}|…)\s*$")


def without_mail(text: str) -> str:
    """Without what a picture of a mail list leaves: headers, the short lines of an inbox region until a sentence or heading, runs of two cropped lines or more, and cropped lines after what was dropped."""
    lines = text.split("\n")
    bare = [x.strip() for x in lines]
    size = [len("".join(x.split())) for x in lines]
    cropped = [bool(_CROPPED.search(x)) and not _ACCELERATOR.search(x) and n <= 30 for x, n in zip(bare, size)]
    out, gone, region = [], False, False
    for i, (line, x) in enumerate(zip(lines, bare)):
        if _REGION.match(x):
            region = gone = True
            continue
        if region:
            if x and size[i] <= 30 and not re.search("[。！？；：]", x) and not x.startswith("#"):
                gone = True
                continue
            region = False
        near = i and cropped[i - 1] or i + 1 < len(lines) and cropped[i + 1]
        if _HEADER.match(x) or _SUBJECT.match(x) or cropped[i] and near:
            gone = True
        elif not (gone and _CROPPED.search(x)):
            gone = False
            out.append(line)
    return "\n".join(out)


# JSON ---------------------------------------------------------------------------------------------------------------


def balanced_json(text: str) -> str:
    """The first object or array of a text that closes what it opens; empty without one."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return ""
    open_: list[str] = []
    quoted = escaped = False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = (escaped or c != '"'), (not escaped and c == "\\")
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if open_.pop() != c:
                return ""
            if not open_:
                return text[start : i + 1]
    return ""


def salvaged_json(text: str) -> str:
    """A JSON object from a reply: the whole, what a fence or prose holds, with commas before a closing bracket taken out; else the fields that can be read, with ``_error``."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for candidate in (text, fenced[1] if fenced else "", balanced_json(text)):
        for x in (candidate, re.sub(r",\s*([}\]])", r"\1", candidate)):
            try:
                found = json.loads(x)
            except ValueError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False, sort_keys=True)
    fields = {}
    for m in re.finditer(r'"([A-Za-z_]\w*)"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|true|false|null|\[[^\[\]{}]*\])', text):
        try:
            fields.setdefault(m[1], json.loads(m[2]))
        except ValueError:
            continue
    return json.dumps(fields | {"_error": "JSON_PARSE_FAILED"}, ensure_ascii=False, sort_keys=True)


# likeness -----------------------------------------------------------------------------------------------------------


def matched(a: str, b: str) -> int:
    """Characters that two texts agree on, in order, by longest common blocks."""
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def union_covered(target: str, texts: list[str] | None, least: int = 8) -> bool:
    """Whether the blocks of ``least`` characters or more that texts share with a target cover all of it, taken together."""
    seen = bytearray(len(target))
    for text in texts or ():
        if text and len(text) >= least:
            for m in difflib.SequenceMatcher(None, target, text, autojunk=False).get_matching_blocks():
                if m.size >= least:
                    seen[m.a : m.a + m.size] = b"\1" * m.size
    return bool(seen) and all(seen)


def _plain(text: str) -> str:
    return re.sub(r"\W", "", text).casefold()


def _likest(target: str, candidates: list[tuple[str, str]], least: float = 0.6) -> tuple[str, str]:
    """The (text, form) that is the likest to ``target``, empty if none is like enough."""
    best, score = ("", ""), 0.0
    for text, form in candidates:
        if form and (ratio := difflib.SequenceMatcher(None, target, form, autojunk=False).ratio()) > score:
            best, score = (text, form), ratio
    return best if score >= least else ("", "")


def _window(form: str, reads: list[str]) -> tuple[str, str]:
    """The one to three neighbouring lines of a reading that are the likest to a text."""
    own = [_plain(x) for x in reads]
    return _likest(form, [("\n".join(reads[a:b]), "".join(own[a:b])) for a in range(len(own)) for b in range(a + 1, min(a + 3, len(own)) + 1)])


def counterpart(line: str, delivered: str | None) -> str:
    """The delivered line that stands for a line; empty if none is like enough."""
    return _likest(_plain(line), [(x.strip(), _plain(x)) for x in (delivered or "").split("\n")])[0]


def window(line: str, reads: list[str] | None) -> str:
    return _window(_plain(line), reads or [])[0]


def adjudicate(line: str, delivered: str | None, reads: list[str] | None, context: int = 3, least: int = 4) -> str:
    """Whether a second reading (``reads``) backs the delivered line, a disputed ``line``, or leaves it ``unresolved``: each place where the two differ votes with its surroundings."""
    own, reads = _plain(line), reads or []
    other = _likest(own, [(x.strip(), _plain(x)) for x in (delivered or "").split("\n")])[1]
    here = _window(own, reads)[1]
    backed = len(own) >= least and own in here
    if other and backed and other not in here and other in _window(other, reads)[1]:
        other = ""  # both are printed: the line was left out, not misread
    if not other:
        return "reading" if backed else "unresolved"
    seen = _window(other, reads)[1]
    votes = set()
    for tag, a, b, c, d in difflib.SequenceMatcher(None, other, own, autojunk=False).get_opcodes():
        if tag != "equal":
            ours, theirs = other[max(0, a - context) : b + context], own[max(0, c - context) : d + context]
            yes, no = (len(x) >= least and x in seen for x in (ours, theirs))
            votes.add("delivery" if yes and not no else "reading" if no and not yes else "unresolved")
    return "reading" if "reading" in votes else "delivery" if votes == {"delivery"} else "unresolved"


# notes --------------------------------------------------------------------------------------------------------------


def _note_key(text: str) -> str:
    x = re.sub(r"^註[:：]?", "", re.sub(r"^[*•-]+", "", "".join(text.split())))
    return re.sub("[，、；。]", "", x)


def distinct_notes(notes: list[str | None]) -> list[str]:
    """Notes without those that say the same: equal without punctuation, under one list mark, or held by another of twelve characters or more; of two the longer stands, at the place of the first."""
    out: list[str] = []
    marks: dict[str, int] = {}
    for note in notes:
        text = " ".join((note or "").split())
        key = _note_key(text)
        if not text or any(key == _note_key(x) for x in out):
            continue
        m = re.match(r"(?:[（(]?(\d{1,2}|[一二三四五六七八九十]+)[)）.、])", text)
        place = marks.get(m[1]) if m else None
        marked = place is not None
        if place is None:
            place = next((i for i, x in enumerate(out) if len(min(key, _note_key(x), key=len)) >= 12 and min(key, _note_key(x), key=len) in max(key, _note_key(x), key=len)), None)
        if place is None:
            place = len(out)
            out.append(text)
        elif len(key) > len(_note_key(out[place])) and (not marked or _note_key(out[place]) in key):
            out[place] = text
        if m:
            marks.setdefault(m[1], place)
    return out


def evidence_lost(text: str, delivered: list[str] | None) -> str:
    """The lines of a passage that a delivery lacks, or the whole passage where those lines alone would leave it short."""
    from pagemill.operators.coverage import held

    there = [x for x in delivered or () if x]
    part = "\n".join(x for x in text.split("\n") if not held(x, there)).strip()
    return part if part and held(text, [*there, part]) else text if part else ""
