"""Problem 2: languages of chunks and of the passages in them.

Blended-spectrum kernel: a unit (a sentence, heading or entry) is the set of its character n-grams of 1 to 3
characters; the kernel of two units is the cosine of their sets. A bounded sample of chunks whose run has a
language label trains one-versus-rest kernel ridge regression on Nyström landmarks; since labels are wrong in places,
the fit is repeated once without the units that contradict their label. Scoring needs the kernel with the landmarks
times the coefficients, which is one product of the sparse presence matrix of a batch with a dense
(n-gram x language) matrix; repeated units of a batch are scored once.

Defined results: null and empty contents give no rows; a unit without letters takes the language of the unit before it;
ties go to the language that comes first in ``LANGS``; repeated rows give equal rows (``p2_passages`` takes the latest delivery of a key); a sentence under three words or four CJK letters is no whole sentence; without any labelled sentence all
scores are 0, so that no language leads and nothing is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.arrow import slices
from pagemill.llm.langs import LANGS, label
from pagemill.llm.latest import latest_texts
from pagemill.llm.lookalike import IGNORABLE, TO_LATIN, fold
from pagemill.llm.truncation import MARK
from pagemill.sources.tables import table

#: Cells of the hashed n-grams; landmarks; labelled chunks of the training sample (its bound) and units of it that are fitted; ridge.
CELLS, LANDMARKS, SAMPLE, UNITS, RIDGE = 1 << 15, 240, 3000, 6000, 0.05
_MAX_N = 3
_SENTENCE = re.compile(r"[^.!?。！？]*+(?:[.!?]++(?!\s|$|[぀-ヿ㐀-鿿\"'”»)])[^.!?。！？]*+)*+(?:[.!?。！？]++[\"'”»」』）)]*+\s*+|$)")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_ENTRY = re.compile(r"\s*(?:[-*•・·◦‣📎]|\d{1,3}[.)、）．]|[a-z][.)])\s+")
_LABEL = re.compile(r"\s*[^\s:：。.]{1,14}[:：]\s*\S{0,40}$")
_WHOLE = re.compile(r"[.!?。！？][\"'”»」』）)]*$")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_CJK_RUN, _LATIN = re.compile("[぀-ヿ㐀-鿿]+"), re.compile("[a-zß-öø-ɏ]+")
_ASCII = {c: chr(c).lower() if chr(c).isalpha() else " " for c in range(128)}
_DIRT = re.compile(rf"[{IGNORABLE}\u0300-\u052f\u2f00-\u2fdf\uf900-\ufaff\ufb00-\ufb06\uff21-\uff3a\uff41-\uff5a\uff66-\uff9f]")
_LOOK = re.compile("[" + "".join(TO_LATIN) + "]")


def units(text: str) -> list[tuple[str, bool]]:
    """(unit, whole): sentences, headings, list entries and table rows in order; ``whole`` marks complete sentences."""
    if not text.isascii() and _DIRT.search(text):
        text = _LOOK.sub(lambda m: TO_LATIN[m[0]], fold(text))
    out: list[tuple[str, bool]] = []
    block: list[str] = []
    first = True

    def close(last: bool = False) -> None:
        nonlocal first
        if not block:
            return
        joined = block[0]
        for line in block[1:]:
            if joined[-1:] in "-­¬":
                joined = joined[:-1] + line.lstrip()
            elif _CJK.match(joined[-1:]) or _CJK.match(line.lstrip()[:1]):
                joined += line.lstrip()
            else:
                joined += " " + line.lstrip()
        block.clear()
        if last and (m := MARK.search(joined)):
            joined = joined[: m.start()]
        for part in _SENTENCE.findall(joined):
            # a stop before a small letter was that of an abbreviation
            if out and out[-1][1] and part[:1].islower() and out[-1][0][-1:] == "." and not first:
                part = out.pop()[0] + " " + part
            part = part.strip()
            if part:
                whole = bool(_WHOLE.search(part)) and not part.endswith("..") and not _LABEL.match(part)
                out.append((part, whole and not (first and part[:1].islower())))
                first = False

    lines = text.split("\n")
    for line in lines:
        bare = line.strip()
        if not bare:
            close()
        elif bare[0] in "#|" or _ENTRY.match(line) or _LABEL.match(bare):
            close()
            out.append((bare, False))
            first = False
        else:
            block.append(bare[1:].strip() if bare[0] == ">" else bare)
    close(True)
    return out


def letters(unit: str) -> str:
    """A unit's letters in lower case, with one space between words; numbers dropped.

    Where CJK and Latin letters mix, those of the script with more words stay (menu names and quoted signs aren't the
    language of a sentence).
    """
    if unit.isascii():
        return " ".join(unit.translate(_ASCII).split())
    x = _NOT_LETTER.sub(" ", unit).strip().lower()
    wide = _CJK.findall(x)
    if not wide or not (latin := _LATIN.findall(x)):
        return x
    return " ".join((_LATIN if len(wide) > 1.8 * len(latin) else _CJK_RUN).sub(" ", x).split())


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(unit, cell) of all distinct n-grams of at most 65,536 units, sorted: the sparse presence matrix."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    flat = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
    owner = np.r_[owner, owner[-1:]] if owner.size else owner
    keys = []
    h = flat
    with np.errstate(over="ignore"):
        for n in range(1, _MAX_N + 1):
            if flat.size < n:
                break
            h = h[: flat.size - n + 1] * np.uint32(0x01000193) + flat[n - 1 :] if n > 1 else flat + np.uint32(7)
            cell = (h ^ h >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(17)
            first = owner[: owner.size - n + 1]
            key = first << np.uint32(15) | cell
            # n-grams that reach from one unit over a space into the next
            keys.append(key if n < 3 else key[first == owner[n - 2 : owner.size - 1]])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.sort(np.concatenate(keys))
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> np.uint32(15)).astype(np.int64), (key & np.uint32(CELLS - 1)).astype(np.int64)


def _dense(texts: list[str]) -> np.ndarray:
    unit, cell = presence(texts)
    out = np.zeros((len(texts), CELLS), dtype=np.float32)
    out[unit, cell] = 1
    return out / np.maximum(np.sqrt(out.sum(1, keepdims=True)), 1)


def fit(texts: list[str], labels: list[int]) -> np.ndarray:
    """(CELLS x languages) coefficients; ``labels`` index LANGS."""
    y = np.array(labels)
    order = np.argsort([hash_of(t) for t in texts], kind="stable")
    chosen: list[int] = []
    for k in range(len(LANGS)):  # landmarks of every language
        chosen += order[y[order] == k][: LANDMARKS // len(LANGS)].tolist()
    marks = _dense([texts[i] for i in chosen])
    kmm = marks @ marks.T
    w, v = np.linalg.eigh(kmm.astype(np.float64))
    keep = w > 1e-5
    root = v[:, keep] / np.sqrt(w[keep])
    z = np.concatenate([(_dense(texts[i : i + 400]) @ marks.T) @ root for i in range(0, len(texts), 400)])
    out = np.zeros((marks.shape[0], len(LANGS)))
    use = np.ones(len(texts), dtype=bool)
    for _ in range(2):
        target = np.where(y[:, None] == np.arange(len(LANGS)), 1.0, -1.0)
        a = z[use].T @ z[use] + RIDGE * use.sum() / 100 * np.eye(z.shape[1])
        coef = np.linalg.solve(a, z[use].T @ target[use])
        use = (z @ coef).argmax(1) == y
        out = root @ coef
    return (marks.T @ out).astype(np.float32)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def score(texts: list[str], coefficients: np.ndarray) -> np.ndarray:
    """Scores by language: presence matrix times coefficients, over the norm of the unit."""
    unit, cell = presence(texts)
    size = np.bincount(unit, minlength=len(texts))
    out = np.stack([np.bincount(unit, coefficients[:, k].take(cell), minlength=len(texts)) for k in range(len(LANGS))], axis=1)
    return out / np.sqrt(np.maximum(size, 1))[:, None]


def run_labels(gate: DataFrame) -> DataFrame:
    """(run_id, label): the language that a run's label names; null where none."""
    return gate.where("run_id is not null").select("run_id", label("stats.semantic_output_language").alias("label")).groupBy("run_id").agg(F.max("label").alias("label"))


def train(chunks: DataFrame, gate: DataFrame) -> np.ndarray:
    """Coefficients from a sample of at most SAMPLE labelled chunks, taken in the order of a hash of their keys."""
    labelled = run_labels(gate).where("label is not null")
    keyed = chunks.where("length(content) > 40").select("run_id", "chunk_id").withColumn("h", F.xxhash64("run_id", "chunk_id")).join(labelled, "run_id").orderBy("h", "run_id", "chunk_id").limit(SAMPLE)
    keys = [(r["run_id"], r["chunk_id"], r["label"]) for r in keyed.collect()]
    if not keys:
        return np.zeros((CELLS, len(LANGS)), dtype=np.float32)
    spark = chunks.sparkSession
    wanted = spark.createDataFrame(keys, "run_id string, chunk_id string, label string")
    rows = chunks.join(F.broadcast(wanted), ["run_id", "chunk_id"]).select("content", "label").distinct().collect()
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: hash_of(r["content"])):
        for u, whole in units(r["content"]):
            x = letters(u)
            if whole and len(x) >= 8:
                texts.append(x)
                labels.append(LANGS.index(r["label"]))
    return fit(texts[:UNITS], labels[:UNITS]) if texts else np.zeros((CELLS, len(LANGS)), dtype=np.float32)


#: Slope of the softmax over scores that gives the confidence; the least lead over the next language that a foreign sentence needs.
SLOPE, LEAD = 4.0, 0.2


def classify(chunks: DataFrame, coefficients: np.ndarray) -> DataFrame:
    """(run_id, chunk_id, unit_no, lang, confidence, lead, whole, n_chars) for every unit of every chunk."""
    shared: Broadcast = chunks.sparkSession.sparkContext.broadcast(coefficients)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float, float]] = {}
        g = np.asfortranarray(shared.value)
        for b in slices(batches, "content", 1_000_000):
            rows: list[tuple[int, int, str, int, int]] = []
            fresh: dict[str, None] = {}
            for i, text in enumerate(b.column("content").to_pylist()):
                for k, (u, whole) in enumerate(units(text)):
                    x = letters(u)
                    if x and x not in known:
                        fresh[x] = None
                    rows.append((i, k, x, _size(u, x) if whole else 0, len(u)))
            if len(known) > 400_000:
                kept = {x for _, _, x, _, _ in rows}
                known = {x: v for x, v in known.items() if x in kept}
            for part in _parts(list(fresh), 400_000):
                s = score(part, g)
                order = np.argsort(-s, axis=1, kind="stable")
                best = order[:, 0]
                at = np.arange(len(part))
                lead = s[at, best] - s[at, order[:, 1]]
                e = np.exp(SLOPE * (s - s.max(1, keepdims=True)))
                conf = 1 / e.sum(1)
                known |= {x: (int(a), float(c), float(d)) for x, a, c, d in zip(part, best, conf, lead)}
            run, chunk = b.column("run_id").to_pylist(), b.column("chunk_id").to_pylist()
            out: list[list] = [[] for _ in range(8)]
            last = (None, 0, 0.0, 0.0)
            for i, k, x, whole, n in rows:
                if x:
                    last = (i, *known[x])
                elif last[0] != i:
                    last = (i, 0, 0.2, 0.0)
                for column, v in zip(out, (run[i], chunk[i], k, LANGS[last[1]], last[2], last[3], whole == 2 or whole == 1 and last[3] >= 2 * LEAD, n)):
                    column.append(v)
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["run_id", "chunk_id", "unit_no", "lang", "confidence", "lead", "whole", "n_chars"])

    texts = chunks.where("length(content) > 0").select("run_id", "chunk_id", "content")
    return texts.mapInArrow(apply, "run_id string, chunk_id string, unit_no int, lang string, confidence double, lead double, whole boolean, n_chars int")


def _size(unit: str, x: str) -> int:
    """2 for a sentence of four words or six CJK letters, 1 for a shorter one that opens and closes like a sentence (three words or four CJK letters), 0 for less."""
    wide = 0 if x.isascii() else len(_CJK.findall(x))
    words = x.split(" ")
    if len(words) > 3 or wide >= 6:
        return 2
    return int(wide >= 4 or len(words) == 3 and unit[:1].isupper() and len(words[-1]) > 2)


def _parts(texts: list[str], chars: int) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n > chars or len(part) == 1 << 16:
            yield part
            part, n = [], 0
    if part:
        yield part


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    chunks, gate = table(spark, root, "chunks"), table(spark, root, "quality_gate")
    sure = classify(chunks, train(chunks, gate)).where(f"whole and lead >= {LEAD}").select("run_id", "chunk_id", "lang").distinct()
    return sure.join(run_labels(gate), "run_id", "left").where("label is null or label <> lang").select("run_id", "chunk_id", "lang").distinct()


def p2_passages(spark: SparkSession, root: str) -> DataFrame:
    """Every passage (run of units of one language) with its language and confidence, and its chunk's main language."""
    chunks, gate = table(spark, root, "chunks"), table(spark, root, "quality_gate")
    found = classify(latest_texts(chunks), train(chunks, gate))
    by = "partition by run_id, chunk_id"
    numbered = found.withColumn("change", F.expr(f"cast(coalesce(lag(lang) over ({by} order by unit_no) <> lang, true) as int)")).withColumn("passage_no", F.expr(f"sum(change) over ({by} order by unit_no)"))
    passages = numbered.groupBy("run_id", "chunk_id", "passage_no", "lang").agg(
        F.sum("n_chars").alias("n_chars"), (F.sum(F.col("confidence") * F.col("n_chars")) / F.sum("n_chars")).alias("confidence")
    )
    return passages.withColumn("chunk_lang", F.expr(f"max_by(lang, n_chars) over ({by})"))
