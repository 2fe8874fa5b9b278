"""Problem 9: keyword-stuffed pages, link lists and product tags.

Each document becomes seven numbers: the share of its characters in sentences, the rate of function words, the share of
links, the entropy and the repetition of its tokens and the repetition of its phrases (over windows of a fixed number, so that
the length of a document doesn't matter) and the density of tag and separator marks. Per language, a robust centre and covariance are
estimated over all documents: medians and median deviations first, then mean and covariance of the documents within
the central set, repeated. A document is flagged if its Mahalanobis distance is that of an outlier and if it lies in
the spam-directed part of the space: its projection on the way from the centre to pure spam (no function words, low
entropy, repeated tokens and phrases) exceeds a share of that way, which a text does that is mostly spam.

Defined results: null, empty and very short documents (fewer than ``LEAST`` tokens) are no cases; a language with too few
documents for a covariance takes the figures of all documents; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.arrow import slices
from pagemill.llm.langs import LANGS, WORDS, by_script, by_words, label
from pagemill.llm.lookalike import fold
from pagemill.sources.tables import cut, table

NAMES = ("prose", "words", "links", "entropy", "repetition", "phrases", "marks")
#: Where pure spam lies, on the axes along which it deviates in any of its kinds; the least scale of each number.
SPAM = {"words": 0.0, "entropy": 0.6, "repetition": 0.65, "phrases": 0.7}
FLOOR = np.array([0.08, 0.02, 0.02, 0.03, 0.04, 0.04, 0.02])
LEAST, WINDOW, FEW = 12, 60, 50
#: 0.999 quantile of chi-squared with seven degrees of freedom; the least share of the way from the centre to pure spam.
CUTOFF, SHARE, ROUNDS = 24.32, 0.42, 3

_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|href=|<a\b|</a>|\]\(|\b[a-z0-9\-]+\.(?:example|test|invalid|com|org|net|info|biz|shop|online|site)\b(?:/\S*)?", re.I)
_PIECE = re.compile(r"[^.!?。！？\n#·|]++[.!?。！？]?+|[.!?。！？]++|[\n#·|]++")
_LINKED = ("://", "www.", "](", "</a>", "href=", ".example", ".test", ".invalid", ".com", ".org", ".net", ".info", ".biz", ".shop", ".online", ".site", "WWW.", ".COM")
_WIDE_GAP = re.compile(r"[^\S\n ]|  ")
_WORD = re.compile(r"[a-zß-öø-ɏ]+")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_MARK = re.compile(r"[#·|;•►»]|>>| / |\b[A-Z]{2,4}\d{1,4}\b")
_CUT = re.compile(r"[\n,，、;；|·•#＃►»>\[\]()（）。！？]+|\s[-/]\s|(?<=[぀-ヿ㐀-鿿])\s+|[.!?]\s|\x00")


def _windows(ids: np.ndarray) -> tuple[float, float]:
    """(entropy relative to its maximum, repetition) of the tokens, as means over windows of WINDOW tokens."""
    n = ids.size
    full = n // WINDOW
    sizes = [WINDOW] * full + ([n - full * WINDOW] if n - full * WINDOW >= (LEAST if full else 1) else [])
    entropy = repeated = 0.0
    if full:
        rows = np.sort(ids[: full * WINDOW].reshape(full, WINDOW), axis=1)
        new = np.ones((full, WINDOW), dtype=bool)
        new[:, 1:] = rows[:, 1:] != rows[:, :-1]
        at = np.flatnonzero(new.ravel())
        p = np.diff(np.r_[at, full * WINDOW]) / WINDOW
        entropy -= float((p * np.log(p)).sum()) / np.log(WINDOW)
        repeated += full - at.size / WINDOW
    if len(sizes) > full:
        k = sizes[-1]
        p = np.unique(ids[full * WINDOW :], return_counts=True)[1] / k
        entropy -= float((p * np.log(p)).sum()) / max(np.log(k), 0.7)
        repeated += 1 - p.size / k
    return entropy / len(sizes), repeated / len(sizes)


def features(text: str) -> tuple[list[float], int, str]:
    """The seven numbers, the number of tokens and the language by script and function words."""
    text = fold(text)
    size = max(1, sum(map(len, text.split())))
    links = 0

    def drop(m: re.Match) -> str:
        nonlocal links
        links += len(m[0])
        return "\x00"

    bare = _LINK.sub(drop, text) if any(x in text for x in _LINKED) else text
    prose = held = spaces = 0
    stopped = False
    for piece in _PIECE.findall(bare):
        last = piece[-1]
        if last in "\n#·|":
            if stopped and spaces >= 4 and held >= 18:
                prose += held - spaces
            held = spaces = 0
            continue
        # a point inside a number or code doesn't end a sentence: what follows it doesn't start with a space
        if held and piece[0].isspace() and stopped:
            if spaces >= 4 and held >= 18:
                prose += held - spaces
            held = spaces = 0
        held += len(piece)
        spaces += piece.count(" ")
        stopped = last in ".!?"
        if last in "。！？":
            if held >= 6:
                prose += held - spaces
            held = spaces = 0
    if held >= 18 and spaces >= 4 and stopped:
        prose += held - spaces
    lower = bare.lower()
    words = _WORD.findall(lower)
    wide = [] if lower.isascii() else _CJK.findall(lower)
    n = len(words) + max(0, len(wide) - 1)
    latin = Counter(words)
    lang = by_script(bare) or by_words(latin)
    if not n:
        return [0.0, 0.0, links / size, 0.0, 0.0, 0.0, 0.0], 0, lang
    counted = Counter(wide) if len(words) * 2 <= len(wide) else latin
    rate = sum(counted[w] for w in WORDS[lang]) / max(1, counted.total())
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    if len(wide) > 1:
        points = np.frombuffer("".join(wide).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ids = np.concatenate([ids, points[:-1] << 21 | points[1:]])
    entropy, repeated = _windows(ids)
    parts_of = _CUT.split(lower)
    phrases = [x for x in (map(str.strip, parts_of) if not _WIDE_GAP.search(lower) else (" ".join(p.split()) for p in parts_of)) if len(x) > 1]
    again, parts = 0.0, 0
    for i in range(0, len(phrases), WINDOW):
        part = phrases[i : i + WINDOW]
        if len(part) < LEAST // 2 and parts:
            break
        again += 1 - len(set(part)) / len(part)
        parts += 1
    marks = len(_MARK.findall(bare)) / n
    return [prose / size, rate, links / size, entropy, repeated, again / max(1, parts), min(marks, 1.0)], n, lang


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, tokens and the seven numbers) of every document with text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out: list[list] = [[] for _ in range(len(NAMES) + 2)]
            for text, given in zip(b.column("text").to_pylist(), b.column("given").to_pylist()):
                made, n, lang = features(text)
                if lang not in ("zh-TW", "ja") and made[1] < 0.05 and given in ("en", "de", "fr"):
                    lang = given
                for column, x in zip(out, (lang, n, *made)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.float64()) for c in out[2:])], names=["doc_id", "lang", "n", *NAMES]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.where("length(trim(text)) > 0").select("doc_id", "text", label("lang").alias("given"))
    return texts.mapInArrow(apply, f"doc_id {kind}, lang string, n int, " + ", ".join(f"{x} double" for x in NAMES))


def _moments(rows: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """(count, mean, covariance) by language, and of all under ""."""
    sums = [F.count("*").alias("n"), *(F.sum(a).alias(f"s_{a}") for a in NAMES), *(F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(NAMES) for j, b in enumerate(NAMES) if i <= j)]
    out, total = {}, None
    for r in rows.groupBy("lang").agg(*sums).collect():  # one row for each language
        n = float(r["n"])
        s = np.array([r[f"s_{a}"] for a in NAMES])
        p = np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] for j in range(len(NAMES))] for i in range(len(NAMES))])
        total = (n, s, p) if total is None else (total[0] + n, total[1] + s, total[2] + p)
        out[r["lang"]] = (n, s, p)
    if total is not None:
        out[""] = total
    return {k: (n, s / n, p / n - np.outer(s / n, s / n)) for k, (n, s, p) in out.items()}


def _distances(rows: DataFrame, centre: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``rows`` with ``distance`` (squared) and ``towards`` (0 at the centre, 1 at pure spam), as sums of products of columns."""
    distance, towards = F.lit(None).cast("double"), F.lit(None).cast("double")
    for lang, (mean, cov) in sorted(centre.items()):
        floor = FLOOR**2
        scale = np.sqrt(np.maximum(np.diag(cov), floor))
        corr = cov / np.outer(scale, scale)
        np.fill_diagonal(corr, 1.0)
        inverse = np.linalg.inv(0.9 * corr + 0.1 * np.eye(len(NAMES)))
        z = [(F.col(a) - float(m)) / float(s) for a, m, s in zip(NAMES, mean, scale)]
        d = sum((z[i] * z[j] * float(inverse[i, j] * (1 if i == j else 2)) for i in range(len(NAMES)) for j in range(i, len(NAMES))), F.lit(0.0))
        # the projection on the way from the centre to pure spam, each axis in units of that way
        t = sum(((F.col(a) - float(mean[k])) / (SPAM[a] - float(mean[k])) for k, a in enumerate(NAMES) if a in SPAM), F.lit(0.0)) / len(SPAM)
        here = F.col("lang") == lang
        distance, towards = F.when(here, d).otherwise(distance), F.when(here, t).otherwise(towards)
    return rows.withColumn("distance", distance).withColumn("towards", towards)


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, n, seven numbers, distance, towards, spam) of every document with text."""
    rows = cut(measured(documents), "spam-features")
    usable = rows.where(F.col("n") >= LEAST)
    middle = {
        r["lang"]: (np.array(r["m"]), r["n"])
        for r in usable.groupBy("lang").agg(F.array(*(F.percentile_approx(a, 0.5, 2000) for a in NAMES)).alias("m"), F.count("*").alias("n")).collect()
    }
    if not middle:
        return rows.withColumns({"distance": F.lit(0.0), "towards": F.lit(0.0), "spam": F.lit(False)})
    absolute = usable
    for k, a in enumerate(NAMES):
        m = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(float(v[k]))) for lang, (v, _) in sorted(middle.items())))
        absolute = absolute.withColumn(f"d_{a}", F.abs(F.col(a) - m))
    spread = {r["lang"]: np.array(r["m"]) for r in absolute.groupBy("lang").agg(F.array(*(F.percentile_approx(f"d_{a}", 0.5, 2000) for a in NAMES)).alias("m")).collect()}
    centre = {lang: (m, np.diag(np.maximum(1.4826 * spread[lang], FLOOR) ** 2)) for lang, (m, _) in middle.items()}
    for _ in range(ROUNDS):
        within = _distances(usable, centre).where(F.col("distance") <= CUTOFF)
        moments = _moments(within)
        if "" not in moments:
            break
        overall = moments.pop("")
        centre = {lang: (moments[lang][1:] if lang in moments and moments[lang][0] >= FEW else overall[1:]) for lang in middle}
    spam = (F.col("n") >= LEAST) & (F.col("distance") > CUTOFF) & (F.col("towards") >= SHARE)
    return _distances(rows, centre).withColumn("spam", F.coalesce(spam, F.lit(False)))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return judged(table(spark, root, "documents")).where("spam").select("doc_id").distinct()


def p9_judged(spark: SparkSession, root: str) -> DataFrame:
    """Every document's features, distance and verdict."""
    return judged(table(spark, root, "documents"))


assert set(WORDS) == set(LANGS)
