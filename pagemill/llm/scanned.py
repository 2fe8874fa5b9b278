"""Problem 3: noise in text from scanned pages.

Counts of words and of pairs of CJK letters are taken over the whole corpus, each under its full 64-bit key, so that
what isn't in the corpus counts nothing. What is sent to the workers are those with at least a share of ``SHARE`` of
all counts, so at most 1 / ``SHARE`` of them whatever the corpus; the others count as that share. Headings are kept as
keys of their whole text: up to ``HEADS`` of them are sent, beyond that they are joined to the lines that ask for them.
A noisy-channel decoder reads a chunk's lines: page numbers and running heads inside the text are taken out, the lines of running text become one character stream, and a dynamic program over its word ends
searches the best segmentation: keep a word, join it over a line end or space, drop the hyphen at a line end, split it, or
replace characters that readers of pages confuse. A reading is only changed where the counts speak clearly for it.
Letter spacing is closed, and misread CJK letters are put right, by rules before and after that.
Paragraph boundaries between the lines are chosen by dynamic programming over line ends, line widths and blank lines.
Headings, list entries, table rows and quotations stay as they are.

Defined results: null stays null and empty stays empty; a chunk without noise comes out with the lines of a paragraph
joined; an empty table gives an empty result; repeated rows give the same text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.arrow import code_points, slices
from pagemill.llm.lookalike import TO_LATIN, fold
from pagemill.sources.tables import cut, table

#: The least share of all counts with which a word or pair is kept by itself: at most 1 / SHARE are, 16 bytes each.
SHARE = 5e-8
#: Headings that are sent to the workers at most (8 bytes each); more are joined.
HEADS = 1 << 21
#: How many times as frequent a reading must be as what stands there, for one change and for each further one.
CLEARLY, FURTHER = 60.0, 4.0
#: Least number of times that a word must occur to be taken as a reading.
KNOWN = 8

# What stands there and what it may have been, in Latin script.
CONFUSED = (
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"),
    ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("ii", "ü"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("nn", "m"), ("ri", "n"), ("li", "h"), ("q", "g"), ("g", "q"), ("v", "y"), ("o", "0"),
)
# Letters of CJK scripts that are confused with each other.
CJK_CONFUSED = (
    "入人 裹表 罩單 諳請 埋理 該核 末未 曰日 ニ二 —一 姑始 瓣辦 斯期 全金 迭送 ロ口 カ力 エ工 タ夕 卜ト 千干 士土 己已 巳已 大太 犬大 夭天 ほは ろる ソン シツ "
    "侍待 徴徵 遣遺 傅傳 陪倍 楝棟 微徵 科料 鳥烏 熟熱 候侯 拆折 壞壤 辨辦 籍藉 帖貼 抹抺 析折 戌戍 刺剌 孑子 幾機 白自 目日 日目 田由 由田 甲申 申甲 母毋 兔免 冶治 拔撥 "
    "わね ねわ ぬめ めぬ はほ るろ さき きさ クワ ワク ノメ ハ八 ヘへ"
)
# Forms of page numbers.
PAGE_FORMS = (
    r"\d{1,4}", r"[ivxlc]{1,7}", r"[-–—] ?\d{1,4} ?[-–—]", r"\[ ?\d{1,4} ?\]", r"\( ?\d{1,4} ?\)", r"\d{1,4} ?[|/] ?\d{1,4}(?: ?ページ)?",
    r"(?:page|p\.|pg\.|seite|s\.|blatt|feuille|sheet) ?\d{1,4}(?: ?(?:of|von|sur|de|/) ?\d{1,4})?", r"第 ?\d{1,4} ?[頁页](?: ?[,、] ?共 ?\d{1,4} ?[頁页])?", r"[頁页]次 ?: ?\d{1,4}", r"\d{1,4} ?(?:ページ|頁)",
)
_PAGE = re.compile("(?:" + "|".join(PAGE_FORMS) + ")", re.I)
_OTHER = re.compile(r"[#|>]|\s*(?:[-*•・·◦‣📎]\s|\d{1,3}[.)、]\s)")
_LABEL = re.compile(r"\s*(?:[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.\- ]{1,14}: ?\S|[\u3400-\u9fff\u3040-\u30ff]{2,6}[:：])")
_TERMINAL = re.compile(r"[.!?:。！？：][\"'”»」』）)]*\s*$")
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
_MIXED = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ015]*[a-zß-öø-ɏ][A-Za-zÀ-ÖØ-öø-ɏ015]*")
_TOKEN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ015]+")
_BREAK = re.compile(rf"({_TOKEN.pattern})(-?\n)(?=({_TOKEN.pattern}))")
_UNDECIDED = re.compile(r"(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f0-9])-\n(?=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])")
_HYPHEN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f0-9])[-\u00ac\u00ad\u2010\u2011] ?$")
_CJK = "぀-ヿ㐀-鿿豈-﫿"
_WIDE = re.compile(f"[{_CJK}　-〿＀-￯—]")
_SPACED = re.compile(r"(?:(?<=^)|(?<=\s))\S(?: {1,3}\S){5,}(?=\s|$)")
_MASK, _BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15
_LAST = 511
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(_LAST + 2)], dtype=np.uint64)
_POWER_LIST = _POWERS.tolist()
_WORD_SALT, _PAIR_SALT, _TITLE_SALT, _SHAPE_SALT = 0x1234567, 0x89ABCDE, 0x55AA55A, 0x3C3C3C3
#: What is left of a letter when all readings of ``CONFUSED`` are one: two words that a chain of them leads to one
#: another have the same shape.
_SHAPE = dict.fromkeys("il1uühb", "") | {"d": "c", "e": "c", "t": "f", "m": "rr", "n": "r", "w": "vv", "y": "v", "g": "q", "0": "o", "5": "s"}
_SHAPE_1, _SHAPE_2 = np.arange(0x250, dtype=np.uint32), np.zeros(0x250, dtype=np.uint32)
for _a, _b in _SHAPE.items():
    _SHAPE_1[ord(_a)], _SHAPE_2[ord(_a)] = ord(_b[0]) if _b else 0, ord(_b[1]) if len(_b) > 1 else 0


def _lower_table() -> np.ndarray:
    """Letter of the Latin script in lower case, 0 elsewhere."""
    out = np.zeros(0x10000, dtype=np.uint32)
    for c in range(0x250):
        if _WORD.fullmatch(chr(c)):
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    for c in range(26):
        out[0xFF21 + c] = out[0xFF41 + c] = 97 + c
    for a, b in TO_LATIN.items():
        out[ord(a)] = ord(b.lower())
    return out


_LOWER = _lower_table()
_CONFUSABLE: dict[str, str] = {}
for _pair in CJK_CONFUSED.split():
    _CONFUSABLE[_pair[0]] = _CONFUSABLE.get(_pair[0], "") + _pair[1]
_CJK_SEEN = re.compile("[" + "".join(_CONFUSABLE) + "]")


def _key(values: np.ndarray | int, salt: int) -> np.ndarray | int:
    """64-bit key of a word, a pair or a heading; one to one for each salt."""
    if isinstance(values, int):
        return ((values ^ salt) * 0xBF58476D1CE4E5B9) & _MASK
    with np.errstate(over="ignore"):
        return (values ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)


class Keyed:
    """Counts by key: the sorted keys and how often each occurs; a key that isn't there counts 0."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def of(self, key: int) -> float:
        i = int(self.keys.searchsorted(np.uint64(key)))
        return float(self.counts[i]) if i < self.keys.size and int(self.keys[i]) == key else 0.0

    def __contains__(self, key: int) -> bool:
        return self.of(key) > 0

    def top(self) -> float:
        return float(self.counts.max(initial=0))


@dataclass
class Lexicon:
    """Counts of words and CJK pairs, the highest count of each shape of words, what an absent word may count, and the longest word."""

    counts: Keyed
    shapes: Keyed
    absent: float
    longest: int
    total: float


def _word_value(word: str) -> int:
    if len(word) > _LAST:
        return (sum(ord(c) * p for c, p in zip(word, _POWER_LIST[:_LAST])) + sum(map(ord, word[_LAST:])) * _POWER_LIST[_LAST]) & _MASK
    return sum(ord(c) * p for c, p in zip(word, _POWER_LIST)) & _MASK


def _shape_key(word: str) -> int:
    return _key(_word_value("".join(_SHAPE.get(c, c) for c in word)), _SHAPE_SALT)


def _shape_keys(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The keys of the shapes of words, given the letters of a text and where each word starts."""
    at = np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum()))
    a, b = _SHAPE_1[low[at]], _SHAPE_2[low[at]]
    ends = np.r_[0, np.cumsum((a > 0).astype(np.int64) + (b > 0))]
    first = np.r_[0, np.cumsum(length)[:-1]]
    k = ends[:-1] - np.repeat(ends[first], length)
    with np.errstate(over="ignore"):
        value = a.astype(np.uint64) * _POWERS[np.minimum(k, _LAST)] + b.astype(np.uint64) * _POWERS[np.minimum(k + 1, _LAST)]
        return _key(np.add.reduceat(value, first), _SHAPE_SALT)


def _is_cjk(p: np.ndarray) -> np.ndarray:
    return (p >= 0x3041) & (p <= 0x30FF) | (p >= 0x3400) & (p <= 0x9FFF) | (p >= 0xF900) & (p <= 0xFAFF)


def title_key(line: str) -> str:
    """A heading or running head without its marks, numbers and case."""
    return " ".join(re.sub(r"^[#\s]*(?:§\s*\d+)?", "", line).lower().split())


def corpus_counts(texts: DataFrame, column: str) -> tuple[Lexicon, DataFrame]:
    """The lexicon of words and pairs of CJK letters, and the keys (``key``) of all headings, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column):
            own = [x for x in b.column(column).to_pylist() if x]
            if not own:
                continue
            flat, _ = code_points([x + "\n" for x in own])
            low = np.where(flat < 0x10000, _LOWER[np.minimum(flat, 0xFFFF)], 0)
            letter = low > 0
            start = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
            if start.size:
                length = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1 - start
                where = np.arange(flat.size) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, flat.size]))
                with np.errstate(over="ignore"):
                    value = np.add.reduceat(np.where(letter, low.astype(np.uint64) * _POWERS[np.minimum(where, _LAST)], np.uint64(0)), start)
                keys, first, n = np.unique(_key(value, _WORD_SALT), return_index=True, return_counts=True)
                yield _counted(0, keys, _shape_keys(low, start[first], length[first]), length[first], n)
            wide = _is_cjk(flat) | (flat == 0x2014)
            pair = wide[:-1] & wide[1:]
            keys, n = np.unique(_key(flat[:-1][pair].astype(np.uint64) << np.uint64(21) | flat[1:][pair], _PAIR_SALT), return_counts=True)
            yield _counted(1, keys, np.zeros_like(keys), np.zeros_like(n), n)
            heads: list[int] = []
            for text in own:
                at = 0 if text.startswith("#") else text.find("\n#") + 1
                while text[at : at + 1] == "#":
                    end = text.find("\n", at)
                    heads.append(_key(_word_value(title_key(fold(text[at : end if end >= 0 else len(text)]))), _TITLE_SALT))
                    at = text.find("\n#", at) + 1 if end >= 0 and text.find("\n#", at) >= 0 else len(text)
            keys, n = np.unique(np.array(heads, dtype=np.uint64), return_counts=True)
            yield _counted(2, keys, np.zeros_like(keys), np.zeros_like(n), n)

    met = texts.select(column).mapInArrow(count, "kind int, key bigint, shape bigint, size int, n bigint")
    summed = cut(met.groupBy("kind", "key").agg(F.min("shape").alias("shape"), F.min("size").alias("size"), F.sum("n").alias("n")), "scanned-counts")
    words = summed.where("kind < 2")
    total = float(words.agg(F.sum("n")).first()[0] or 0)
    least = SHARE * total
    # all words where a single occurrence is above the share, at most 1 / SHARE in any case
    kept = words.where(F.col("n") >= least).select("kind", "key", "shape", "size", "n").toArrow()
    keys, shape, n = (kept.column(k).to_numpy() for k in ("key", "shape", "n"))
    word = kept.column("kind").to_numpy() == 0
    frequent = word & (n >= KNOWN)
    order = np.argsort(n[frequent], kind="stable")[::-1]
    shapes, first = np.unique(shape[frequent][order].view(np.uint64), return_index=True)
    longest = int(kept.column("size").to_numpy()[frequent].max(initial=0))
    lexicon = Lexicon(Keyed(keys.view(np.uint64), n), Keyed(shapes, n[frequent][order][first]), max(0.2, least if least > 1 else 0.0), longest, max(1.0, total))
    return lexicon, summed.where("kind = 2").select("key")


def _counted(kind: int, keys: np.ndarray, shapes: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(keys.size, kind), pa.int32()), pa.array(keys.view(np.int64)), pa.array(shapes.view(np.int64)), pa.array(sizes, pa.int32()), pa.array(n, pa.int64())],
        names=["kind", "key", "shape", "size", "n"],
    )


@dataclass
class Repaired:
    """A repaired text and what was mended."""

    text: str
    broken: int = 0
    confused: int = 0
    furniture: int = 0
    spaced: int = 0
    short: int = 0

    @property
    def noisy(self) -> bool:
        return bool(self.broken or self.confused or self.furniture or self.spaced)


class Decoder:
    def __init__(self, lexicon: Lexicon, titles: Container[int]):
        self.counts, self.shapes, self.absent, self.longest, self.total = lexicon.counts, lexicon.shapes, lexicon.absent, lexicon.longest, lexicon.total
        self.titles = titles
        self.top = self.counts.top()
        # words without a reading of their own; neighbours in a line that aren't one word, by two and by three
        self._settled: set[str] = set()
        self._apart: set[tuple[str, ...]] = set()
        self._levels: dict[str, int] = {}
        self._done: dict[tuple[str, bool], Repaired] = {}
        self._kept = 0
        self._words: dict[str, float] = {}
        self._pairs: dict[str, float] = {}
        self._pieces: dict[str, bool] = {}
        self._readings: dict[str, str | None] = {}

    def n(self, word: str) -> float:
        """How often a word occurs in the corpus."""
        found = self._words.get(word)
        if found is None:
            if len(self._words) > 300_000:
                self._words.clear()
            found = self._words[word] = self.counts.of(_key(_word_value(word), _WORD_SALT))
        return found

    def pair(self, a: str, b: str) -> float:
        found = self._pairs.get(a + b)
        if found is None:
            if len(self._pairs) > 300_000:
                self._pairs.clear()
            found = self._pairs[a + b] = self.counts.of(_key(ord(a) << 21 | ord(b), _PAIR_SALT))
        return found

    # words -----------------------------------------------------------------------------------------------------

    def reading(self, word: str) -> str | None:
        """What ``word`` (lower case) was before it was misread; null where it stands."""
        if word not in self._readings:
            if len(self._readings) > 300_000:
                self._readings.clear()
            self._readings[word] = self._search(word)
        return self._readings[word]

    def _search(self, word: str) -> str | None:
        # each of three changes adds a letter at most
        if len(word) < 2 or len(word) > self.longest + 3:
            return None
        own = self.n(word) if word.isalpha() else 0.0
        needed = max(KNOWN, CLEARLY * max(own, self.absent))
        # no word that a chain of changes can lead to is frequent enough
        if self.shapes.of(_shape_key(word)) < needed:
            return None
        beam, seen = {word}, {word}
        best: tuple[float, str] | None = None
        for edits in range(1, 4):
            grown: dict[str, float] = {}
            for w in beam:
                for a, b in CONFUSED:
                    at = w.find(a)
                    while at >= 0:
                        made = w[:at] + b + w[at + len(a) :]
                        if made not in seen:
                            seen.add(made)
                            grown[made] = self.n(made) if made.isalpha() else 0.0
                        at = w.find(a, at + 1)
            for made, n in grown.items():
                if n >= needed and (best is None or n > best[0]):
                    best = (n, made)
            if best:
                return best[1]
            needed *= FURTHER
            # no word is frequent enough to be a clear reading of this one
            if needed > self.top:
                return None
            beam = set(grown)
        return None

    def _split(self, word: str) -> tuple[float, str] | None:
        """Two words that were run together: how often they would meet by chance speaks for them."""
        if not word.isalpha() or len(word) > 2 * self.longest:
            return None
        needed = CLEARLY * FURTHER * max(self.n(word), self.absent)
        if needed > self.top:
            return None
        n, k = max(((self.n(word[:k]) * self.n(word[k:]) / self.total, k) for k in range(max(1, len(word) - self.longest), min(len(word), self.longest + 1))), default=(0.0, 0))
        return (math.log(n / needed), f"{word[:k]} {word[k:]}") if n >= max(KNOWN, needed) else None

    def _rare(self, word: str) -> bool:
        """Whether some word may be clearly more frequent, so that this one may be a piece of it."""
        return word.isalpha() and CLEARLY * max(self.n(word), self.absent) <= self.top

    def _piece(self, word: str) -> bool:
        """``_rare`` of a word in any case, remembered."""
        found = self._pieces.get(word)
        if found is None:
            if len(self._pieces) > 300_000:
                self._pieces.clear()
            found = self._pieces[word] = self._rare(word.lower())
        return found

    def _level(self, word: str) -> int:
        """1 for a word that is no piece of one with its neighbours in a line, 2 for one that may be of two, 3 of three."""
        if len(self._levels) > 300_000:
            self._levels.clear()
        n = CLEARLY * FURTHER * max(self.n(word.lower()), self.absent) if word.isalpha() else math.inf
        found = self._levels[word] = 1 + (n <= self.top) + (n * FURTHER**2 <= self.top)
        return found

    def _joined(self, words: list[str], gaps: list[str]) -> float | None:
        """Gain of reading ``words`` (lower case) as one word over the breaks between them; null if it isn't clear."""
        made = "".join(words)
        if len(made) > self.longest + 3:
            return None
        n, least, open_ = self.n(made), min(map(self.n, words)), [g for g in gaps if g != "-\n"]
        if not open_:
            whole = max(n, self.n(self.reading(made) or made))
            if whole >= 1:
                return math.log(whole + 1)
            after = [self.n(w) for w in words[1:]]
            return sum(math.log((KNOWN + 1) / (x + 1)) for x in after) if max(after) < KNOWN else None
        needed = CLEARLY * FURTHER ** (len(gaps) - 1 + gaps.count(" ")) * max(least, self.absent)
        if n >= max(KNOWN, needed):
            return math.log(n / needed) + 1e-6
        if n or " " in gaps or not all(map(self._rare, words)):
            return None
        n, needed = self.n(self.reading(made) or made), needed * FURTHER
        return math.log(n / needed) + 1e-6 if n >= max(KNOWN, needed) else None

    def words(self, text: str, out: Repaired, ended: bool) -> str:
        """``text`` in its best segmentation; line ends without a decision are "\\n", after a hyphen or not. The last word of a text that doesn't end is left alone."""
        hyphens = bool(_UNDECIDED.search(text))
        met = _TOKEN.findall(text)
        # neighbours can be one word only where one of them is seldom enough
        levels = [self._levels.get(w) or self._level(w) for w in met]
        seldom = [i for i, x in enumerate(levels) if x > 1]
        near = [(k, i) for i in sorted({k for i in seldom for k in (i - 1, i)}) if 0 <= i < len(met) - 1 and (k := (met[i], met[i + 1])) not in self._apart]
        near += [(k, i) for i in sorted({k for i in seldom if levels[i] > 2 for k in (i - 2, i - 1, i)}) if 0 <= i < len(met) - 2 and (k := (met[i], met[i + 1], met[i + 2])) not in self._apart]
        # where a line ends between words of which one may be a piece of a word, or after a hyphen
        breaks = [(m.end(1), m[2]) for m in _BREAK.finditer(text) if m[2] != "\n" or self._piece(m[1]) or self._piece(m[3])] if "\n" in text else []
        loose = [i for i, w in enumerate(met) if w not in self._settled]
        if hyphens:
            out.broken += len(_UNDECIDED.findall(text))
        if not breaks and not loose and not near:
            return _rest(text)
        tokens = [(*m.span(), m[0]) for m in _TOKEN.finditer(text)]
        count = len(tokens)

        def gap(i: int) -> str:
            """What stands between word i and the next, if it may be a break inside a word."""
            if not 0 <= i < count - 1:
                return ""
            g, w, x = text[tokens[i][1] : tokens[i + 1][0]], tokens[i][2], tokens[i + 1][2]
            if g == "-\n":
                return g if w[-1].isalpha() and x[0].islower() else ""
            return g if g in (" ", "\n") and w.isalpha() and x.isalpha() and (x.islower() or x.isupper() and w.isupper()) else ""

        def stands(a: int, b: int) -> bool:
            """Whether what begins at ``a`` and ends at ``b`` is part of something else than running text, or not whole."""
            before, after = text[a - 1 : a], text[b : b + 1]
            if before == "\n":
                before = text[a - 2 : a - 1] if text[a - 2 : a - 1] == "-" else " "
            w = text[a:b]
            if b == len(text) and not ended or before and before in "@._/\\" or after in ("@", "_", "\\") or before.isdigit() or after.isdigit():
                return True
            return not a and w[:1].islower() and w.replace("\n", "").replace("-", "").replace(" ", "").isalpha() and w.islower() or "-" in (before, after)

        # edges[j]: (first word, gain, what is read, joins, confused, splits) of the readings that end before word j
        edges: dict[int, list[tuple[int, float, str, int, int, int]]] = {}

        def add(i: int, j: int, gain: float, read: str, joins: int = 0, confused: int = 0, splits: int = 0) -> None:
            edges.setdefault(j, []).append((i, gain, read, joins, confused, splits))

        def join(i: int, j: int) -> None:
            a, b = tokens[i][0], tokens[j - 1][1]
            gaps = [gap(k) for k in range(i, j - 1)]
            closed = all(g == "-\n" for g in gaps)
            if not all(gaps) or not closed and stands(a, b):
                return
            # beside a hyphen a word may hold digits; its letters at the break count
            gain = self._joined([_WORD.findall(t[2].lower())[-1 if k == 0 else 0] for k, t in enumerate(tokens[i:j])], gaps)
            if gain is not None:
                whole = "".join(t[2] for t in tokens[i:j])
                plain = whole.isalpha() or whole.islower() or whole[0].isupper() and whole[1:].islower()
                r = self.reading(whole.lower()) if plain and not stands(a, b) else None
                add(i, j, gain, whole if r is None else _cased(r, whole), sum(g != "-\n" for g in gaps), int(r is not None))

        tried: set[tuple[int, int]] = set()

        def around(i: int, shortest: int) -> None:
            """Tries the words from ``shortest`` on that hold word i and its next: pieces that are rare, and one neighbour on either side."""
            first = last = i
            while gap(first - 1) and self._rare(tokens[first][2].lower()) and tokens[i][1] - tokens[first][0] <= 2 * self.longest:
                first -= 1
            while gap(last) and (last == i or self._rare(tokens[last][2].lower())) and tokens[last][1] - tokens[i][0] <= 2 * self.longest:
                last += 1
            for x in range(first, i + 1):
                spaces, least = 0, self.n(tokens[x][2].lower())
                for y in range(x + 1, last + 1):
                    spaces += gap(y - 1) == " "
                    least = min(least, self.n(tokens[y][2].lower()))
                    # no word is frequent enough to be a clear reading of so many pieces
                    if y > i and y + 1 - x >= shortest and CLEARLY * FURTHER ** (y - x - 1 + spaces) * max(least, self.absent) <= self.top:
                        tried.add((x, y + 1))

        if breaks:
            at = {e: i for i, (_, e, _) in enumerate(tokens)}
            for end, mark in breaks:
                i = at[end]
                if gap(i) == mark:
                    around(i, 2)
                j = i + 1
                while gap(j - 1) == "-\n":
                    j += 1
                    tried.add((i, j))
        if near and len(self._apart) > 600_000:
            self._apart.clear()
        for those, i in near:
            low = [w.lower() for w in those]
            if not all(map(str.isalpha, low)) or len(low) > 2 and not self._rare(low[1]) or self._joined(low, [" "] * (len(low) - 1)) is None:
                self._apart.add(those)
            else:
                tried.add((i, i + len(low)))
        for i in loose:
            a, b, w = tokens[i]
            low = w.lower()
            r, parts = self.reading(low) if _MIXED.fullmatch(w) else None, self._split(low)
            # four pieces in a line
            scarce = w.isalpha() and CLEARLY * FURTHER**5 * max(self.n(low), self.absent) <= self.top
            if not scarce and r is None and parts is None:
                if len(self._settled) > 300_000:
                    self._settled.clear()
                self._settled.add(w)
                continue
            if (r or parts) and not stands(a, b):
                plain = w.isalpha() or (w.islower() or w[0].isupper() and w[1:].islower()) and not re.match(r"[.,/-]\d", text[b:])
                if r and plain:
                    add(i, i + 1, math.log(max(self.n(r), 1.0) / (CLEARLY * max(self.n(low) if low.isalpha() else 0.0, self.absent))) + 1e-3, _cased(r, w), confused=1)
                if parts:
                    add(i, i + 1, parts[0] + 1e-6, _cased(parts[1], w), splits=1)
            if scarce:
                around(i, 4)
                around(i - 1, 4)
        for i, j in tried:
            join(i, j)
        if not edges:
            return _rest(text)
        # best[j]: highest gain of the words before j; a word that no edge takes is kept
        best, back = [0.0] * (count + 1), [None] * (count + 1)
        for j in range(1, count + 1):
            best[j] = best[j - 1]
            for e in edges.get(j, ()):
                if best[e[0]] + e[1] > best[j]:
                    best[j], back[j] = best[e[0]] + e[1], e
        made, j, end = [], count, len(text)
        while j:
            e = back[j]
            if e is None:
                j -= 1
                continue
            made += [_rest(text[tokens[j - 1][1] : end]), e[2]]
            end = tokens[e[0]][0]
            out.broken, out.confused, out.spaced = out.broken + e[3], out.confused + e[4], out.spaced + e[5]
            out.short += e[4] and len(text[end : tokens[j - 1][1]]) < 4
            j = e[0]
        return "".join([*made, _rest(text[:end])][::-1])

    def letters(self, text: str, out: Repaired) -> str:
        """``text`` with misread CJK letters put right by the pairs they form with their neighbours."""
        if not _CJK_SEEN.search(text):
            return text
        chars = list(text)
        for m in _CJK_SEEN.finditer(text):
            i = m.start()
            c = chars[i]
            before = chars[i - 1] if i and _is_letter(chars[i - 1]) else None
            after = chars[i + 1] if i + 1 < len(chars) and _is_letter(chars[i + 1]) else None
            if before is None and after is None:
                continue
            score = lambda x: (math.log(self.pair(before, x) + 0.5) if before else 0.0) + (math.log(self.pair(x, after) + 0.5) if after else 0.0)  # noqa: B023, E731
            own = score(c)
            best = max((score(x), x) for x in _CONFUSABLE[c])
            if best[0] - own > math.log(CLEARLY) and best[0] > math.log(KNOWN):
                chars[i] = best[1]
                out.confused += 1
        return "".join(chars)

    # lines -----------------------------------------------------------------------------------------------------

    def _furniture(self, line: str) -> bool:
        plain = " ".join(fold(line).split())
        if not plain or len(plain) > 120:
            return False
        if _PAGE.fullmatch(plain):
            return True
        parts = [x for x in re.split(r"\s{2,}|\t", fold(line).strip()) if x]
        if len(parts) == 2 and (_PAGE.fullmatch(parts[1]) or _PAGE.fullmatch(parts[0])):
            rest = parts[0] if _PAGE.fullmatch(parts[1]) else parts[1]
            return self._is_title(rest) or len(rest) < 60 and not _TERMINAL.search(rest)
        return self._is_title(plain)

    def _is_title(self, line: str) -> bool:
        return len(line) >= 4 and not _TERMINAL.search(line) and _key(_word_value(title_key(line)), _TITLE_SALT) in self.titles

    def _lines(self, text: str) -> tuple[list[str], list[bool], list[int]]:
        """The lines, which of them are running text, and which of those may be page numbers or running heads."""
        lines = text.split("\n")
        body = [bool(x.strip()) and (not _OTHER.match(x) or bool(_PAGE.fullmatch(x.strip()))) for x in lines]
        return lines, body, [i for i, x in enumerate(lines) if body[i] and self._furniture(x)]

    def repair(self, text: str) -> Repaired:
        out = Repaired(text)
        lines, body, numbers = self._lines(text)
        for i in set(range(len(lines))).difference(numbers):
            body[i] = body[i] and not _LABEL.match(lines[i])
        running = [i for i in range(len(lines)) if body[i] and i not in set(numbers)]
        taken = {i for i in numbers if running and (i > running[0] or i < running[-1])}
        if running and len(running) == 1 and len(lines[running[0]].strip()) < 12:
            taken = set()
        out.furniture = len(taken)
        blocks: list[list[str]] = []
        kind, gap, stopped = "", False, False
        for i, line in enumerate(lines):
            if i in taken:
                stopped = True
                continue
            if not line.strip():
                gap = not stopped or gap
                continue
            if not body[i]:
                blocks.append(["=", line, "gap" if gap else ""])
                kind = "="
            elif kind == "p" and not (gap and not stopped):
                blocks[-1].append(line)
            elif kind == "p" and stopped and not _TERMINAL.search(blocks[-1][-1]):
                blocks[-1].append(line)
            else:
                blocks.append(["p", line])
                kind = "p"
            gap = stopped = False
        made: list[str] = []
        for k, block in enumerate(blocks):
            if block[0] == "=":
                made.append(("\n" if made and block[2] else "") + block[1])
                continue
            for para in self._paragraphs(block[1:]):
                last = k == len(blocks) - 1
                made.append(("\n" if made else "") + self._stream(para, out, not last or bool(_TERMINAL.search(para[-1]))))
        out.text = "\n".join(made)
        # one changed word of two or three letters is no evidence by itself, unless the page broke the lines
        wrapped = any(b[0] == "p" and len(b) > 2 for b in blocks)
        return Repaired(text) if out.confused == out.short == 1 and not (wrapped or out.broken or out.furniture or out.spaced) else out

    def _paragraphs(self, lines: list[str]) -> list[list[str]]:
        """Where paragraphs begin among consecutive lines: the cheapest sequence of breaks."""
        n = len(lines)
        if n == 1:
            return [lines]
        width = [len(x.rstrip()) + len(_WIDE.findall(x.rstrip())) for x in lines]
        full = max(width)
        cost = [0.0] * n
        for i in range(1, n):
            ends, short = bool(_TERMINAL.search(lines[i - 1])), width[i - 1] < 0.75 * full
            cost[i] = (-1.5 if ends else 6.0) + (-1.0 if short and ends else 2.5) + (0.0 if not lines[i][:1].islower() else 3.0)
        # best[i]: lowest cost of lines[:i] with a paragraph ending before i; a paragraph of one short line costs extra
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        # the cheapest beginning of a paragraph of two lines or more
        least, start = math.inf, 0
        for j in range(1, n + 1):
            c = best[j - 1] + (cost[j - 1] if j > 1 else 0.0)
            one = c + (0.8 if width[j - 1] < 0.5 * full else 0.0)
            best[j], back[j] = (one, j - 1) if one < least else (least, start)
            if c < least:
                least, start = c, j - 1
        out, j = [], n
        while j:
            out.append(lines[back[j] : j])
            j = back[j]
        return out[::-1]

    def _stream(self, lines: list[str], out: Repaired, ended: bool) -> str:
        """One paragraph from its lines."""
        text = ""
        for line in lines:
            line = _SPACED.sub(lambda m: self._close(m[0], out), line)
            if not text:
                text = line.rstrip(" ") if len(lines) > 1 else line
                continue
            line = line.strip(" ")
            m = _HYPHEN.search(text)
            first = line[:1]
            if m and first and (first.isalnum()):
                stem = text[: m.end(1)]
                a, b = _WORD.search(stem[::-1]), _WORD.match(line)
                left = stem[len(stem) - a.end() :] if a and a.start() == 0 else ""
                if left and b and first.islower():
                    text = stem + "-\n" + line
                elif left and b and not first.islower() and self.n(b[0].lower()) >= KNOWN and not left.isupper():
                    text = stem + "-" + line
                else:
                    text = stem + "-" + line
                    out.broken += 1
            elif _WIDE.match(text[-1:]) or _WIDE.match(first):
                if _is_letter(text[-1:]) and _is_letter(first) or text[-1:].isdigit() and first.isdigit():
                    out.broken += 1
                text = text + line
            elif text[-1:].isdigit() and re.match(r"[-/,]?\d", line) and _WIDE.search(text[-40:] + line[:40]):
                out.broken += 1
                text = text + line
            else:
                text = text + "\n" + line
        # paragraphs come again from run to run
        done = self._done.get((text, ended))
        if done is None:
            done = Repaired("")
            done.text = self.letters(self.words(text, done, ended), done)
            self._kept += len(text)
            if self._kept > 4_000_000:
                self._done.clear()
                self._kept = len(text)
            self._done[text, ended] = done
        out.broken, out.confused, out.spaced, out.short = out.broken + done.broken, out.confused + done.confused, out.spaced + done.spaced, out.short + done.short
        return done.text

    def _close(self, run: str, out: Repaired) -> str:
        units = re.split(r"( +)", run)
        if sum(1 for x in units[::2] if _WIDE.match(x)) < 2 and len(units) < 16:
            return run
        out.spaced += 1
        return "".join(x if k % 2 == 0 else " " * (len(x) // 2) for k, x in enumerate(units))


def _cased(read: str, w: str) -> str:
    """``read`` in the case of ``w``."""
    return read.upper() if w.isupper() and len(w) > 1 else read[0].upper() + read[1:] if w[0].isupper() else read


def _rest(text: str) -> str:
    """What no reading changes: a hyphen at a line end stays, other line ends are spaces."""
    return _UNDECIDED.sub("-", text).replace("\n", " ") if "\n" in text else text


def _is_letter(c: str) -> bool:
    return bool(c) and ("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c == "—")


class _Asked(list):
    """Collects the keys that are asked for, and holds none."""

    def __contains__(self, key: int) -> bool:
        self.append(key)
        return False


def _with_heads(texts: DataFrame, column: str, heads: DataFrame) -> DataFrame:
    """``texts`` with ``_heads``: the keys of headings that its lines may repeat; texts meet them by two hashes of their content."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked()
        reader = Decoder(Lexicon(Keyed(np.zeros(0, np.uint64), np.zeros(0)), Keyed(np.zeros(0, np.uint64), np.zeros(0)), 0.2, 0, 1.0), asked)
        for b in slices(batches, column):
            row, keys = [], []
            for i, x in enumerate(b.column(column).to_pylist()):
                if x:
                    reader._lines(_plain(x))
                    row += [i] * len(asked)
                    keys += asked
                    asked.clear()
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("_h1").take(at), b.column("_h2").take(at), pa.array(np.array(keys, dtype=np.uint64).view(np.int64))], names=["_h1", "_h2", "key"])

    hashed = texts.withColumns({"_h1": F.xxhash64(column), "_h2": F.hash(column)})
    asked = hashed.select("_h1", "_h2", column).mapInArrow(ask, "_h1 bigint, _h2 int, key bigint").distinct()
    met = asked.join(heads, "key", "left_semi").groupBy("_h1", "_h2").agg(F.collect_set("key").alias("_heads"))
    return hashed.join(met, ["_h1", "_h2"], "left").select(*texts.columns, "_heads")


def repair(texts: DataFrame, column: str, lexicon: Lexicon, heads: DataFrame) -> DataFrame:
    """``texts`` with ``repaired``, ``broken``, ``confused``, ``furniture`` and ``spaced`` (numbers of what was mended)."""
    made = ("repaired", "broken", "confused", "furniture", "spaced")
    if clash := {*made, "_heads", "_h1", "_h2"} & set(texts.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    names = texts.columns
    few = heads.count() <= HEADS
    keys = heads.toArrow().column("key").to_numpy().view(np.uint64) if few else np.zeros(0, dtype=np.uint64)
    known = Keyed(keys, np.ones(keys.size, dtype=np.float32))
    shared = texts.sparkSession.sparkContext.broadcast((lexicon, known))
    schema = T.StructType([*texts.schema.fields, T.StructField("repaired", T.StringType()), *(T.StructField(k, T.IntegerType()) for k in made[1:])])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(*shared.value)
        for b in slices(batches, column):
            own = [None] * b.num_rows if few else b.column("_heads").to_pylist()
            done = []
            for x, here in zip(b.column(column).to_pylist(), own):
                if not few:
                    decoder.titles = {k & _MASK for k in here or ()}
                done.append(decoder.repair(_plain(x)) if x else Repaired(x))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in names), pa.array([d.text for d in done], pa.string()), *(pa.array([getattr(d, k) for d in done], pa.int32()) for k in made[1:])],
                names=[*names, *made],
            )

    return (texts if few else _with_heads(texts, column, heads)).mapInArrow(apply, schema)


def _plain(text: str) -> str:
    """Invisible characters and look-alikes out of the way of the counts."""
    return text if text.isascii() else _LOOK.sub(lambda m: TO_LATIN[m[0]], _INVISIBLE.sub("", text))


_LOOK = re.compile("[" + "".join(TO_LATIN) + "]")
_INVISIBLE = re.compile(r"[\u200b-\u200f\u2060\ufeff]|\u00ad(?! ?\n)")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Chunks whose content needs mending; a content that several chunks share is read once."""
    chunks = table(spark, root, "chunks").where("length(content) > 0").select("run_id", "chunk_id", "content")
    done = repair(chunks.select("content").distinct(), "content", *corpus_counts(chunks, "content"))
    form = (F.xxhash64("content").alias("h1"), F.hash("content").alias("h2"))
    noisy = done.where("broken + confused + furniture + spaced > 0").select(*form)
    return chunks.select("run_id", "chunk_id", *form).join(noisy, ["h1", "h2"], "left_semi").select("run_id", "chunk_id").distinct()


def p3_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk's content as continuous paragraphs, with what was mended."""
    chunks = table(spark, root, "chunks")
    texts = chunks.select("run_id", "chunk_id", "content").distinct()
    return repair(texts, "content", *corpus_counts(chunks, "content")).drop("content")
