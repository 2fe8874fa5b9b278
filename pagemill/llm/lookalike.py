"""Problem 1: text that reads the same on the page but differs in its characters.

``canonicalise`` brings a text to one form in three steps: ignorable characters are deleted, width and
presentation variants are folded by compatibility normalisation (only the mappings that keep the look: fractions,
superscripts and circled signs stay), and every token that holds letters with look-alikes in another script goes
through a lattice: a position offers one letter for each script whose alphabet has a letter of that look, and
Viterbi search takes the path with the best sum of letter bigram scores, of which a change of script inside a
token costs a fixed amount. The bigram scores are counted over all texts of the corpus (``letter_model``).

Defined results: null stays null and empty stays empty; letter case, accents, digits, line breaks and the number
of spaces are kept; the form of a text doesn't depend on other rows, given the model; repeated rows give
the same form; columns of the input are kept, so a clash with the output column is refused with ValueError.
"""

from __future__ import annotations

import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.arrow import code_points, slices
from pagemill.sources.tables import cut, table

# Letters of other scripts that look like Latin letters.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝӏѵАВЕКМНОРСТХІЅЈУҺ", "aeopcyxsijhdqwlvABEKMHOPCTXISJYH", strict=True))
GREEK = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX", strict=True))
# Default-ignorable code points (soft hyphen, joiners, direction and word marks, selectors, BOM).
IGNORABLE = r"\u00ad\u034f\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff"

SCRIPTS = ("latin", "greek", "cyrillic")
TO_LATIN = CYRILLIC | GREEK
_FROM_LATIN = ({}, {v: k for k, v in GREEK.items()}, {v: k for k, v in CYRILLIC.items()})
_IGNORABLE = re.compile(f"[{IGNORABLE}]")
_TOKEN = re.compile(r"[A-Za-z\u00c0-\u024f\u0370-\u052f]+")
_FOREIGN = re.compile(r"[\u0370-\u052f]")
#: Nats that a change of script inside a token costs.
SWITCH = 14.0
#: Letters a script counts for before any text is seen.
PRIOR_LETTERS = 5.0
#: What the script of the rest of a text weighs against the letter scores of a token.
PRIOR_WEIGHT = 4.0
_ALPHABET = 64


@lru_cache(1)
def _kept() -> re.Pattern:
    """Characters whose compatibility mapping changes the look: superscripts, fractions, circled and squared signs."""
    tags = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")
    found = [chr(c) for c in range(0xA0, 0x10000) if unicodedata.decomposition(chr(c)).startswith(tags)]
    return re.compile("([" + re.escape("".join(found)) + "]+)")


@lru_cache(1)
def _letter_index() -> np.ndarray:
    """Code point to script * 64 + letter, -1 elsewhere; Latin letters are folded to lower case without accents."""
    out = np.full(0x530, -1, dtype=np.int16)
    for c in range(0x530):
        base = unicodedata.normalize("NFD", chr(c).lower())[0]
        if "a" <= base <= "z":
            out[c] = ord(base) - 97
        elif "α" <= base <= "ω":
            out[c] = _ALPHABET + ord(base) - 0x3B1
        elif "а" <= base <= "џ":
            out[c] = 2 * _ALPHABET + ord(base) - 0x430
    return out


class LetterModel:
    """Log probability of a letter after another, by script, and each script's share of all letters."""

    def __init__(self, counts: np.ndarray):
        c = np.asarray(counts, dtype=np.float64).reshape(len(SCRIPTS), _ALPHABET, _ALPHABET)
        self.scores = np.log((c + 0.5) / (c.sum(2, keepdims=True) + 0.5 * _ALPHABET))
        mass = c.sum((1, 2)) + 1
        self.share = mass / mass.sum()
        self._memo: dict[tuple, str] = {}

    def _prior(self, seen: tuple[int, ...]) -> np.ndarray:
        n = np.asarray(seen, dtype=np.float64)
        return PRIOR_WEIGHT * np.log((PRIOR_LETTERS * self.share + n) / (PRIOR_LETTERS + n.sum()))

    def token(self, token: str, seen: tuple[int, ...]) -> str:
        """The best path through the lattice of ``token``; ``seen`` counts the text's letters of each script that have no look-alike."""
        key = (token, seen)
        if key not in self._memo:
            if len(self._memo) > 200_000:
                self._memo.clear()
            self._memo[key] = self._search(token, seen)
        return self._memo[key]

    def _search(self, token: str, seen: tuple[int, ...]) -> str:
        lattice = [_offers(ch) for ch in token]
        prior, index = self._prior(seen), _letter_index()
        best: dict[int, tuple[float, str]] = {}
        last: dict[int, int] = {}
        for i, offers in enumerate(lattice):
            now: dict[int, tuple[float, str]] = {}
            at: dict[int, int] = {}
            for s, ch in offers.items():
                k = int(index[ord(ch)])
                at[s] = k % _ALPHABET if k >= 0 else -1
                if not i:
                    now[s] = (float(prior[s]), ch)
                    continue
                ways = []
                for r, (score, path) in best.items():
                    step = -SWITCH + float(prior[s]) if r != s else 0.0
                    if r == s and last[r] >= 0 <= at[s]:
                        step += float(self.scores[s, last[r], at[s]])
                    else:
                        step -= 3.0
                    ways.append((score + step, path + ch))
                now[s] = max(ways)
            best, last = now, at
        return max(best.values())[1]


@lru_cache(4096)
def _offers(ch: str) -> dict[int, str]:
    """Letters that look like ``ch``, by script."""
    if ch not in TO_LATIN and not any(ch in back for back in _FROM_LATIN[1:]):
        c = ord(ch)
        return {1 if 0x370 <= c < 0x400 else 2 if 0x400 <= c < 0x530 else 0: ch}
    latin = TO_LATIN.get(ch, ch)
    return {0: latin} | {s: back[latin] for s, back in enumerate(_FROM_LATIN) if latin in back}


def _seen(text: str) -> tuple[int, ...]:
    """Letters of each script without a look-alike, counted where a script other than Latin has one (at most 50 count)."""
    if not any(len(_offers(ch)) == 1 for ch in set(_FOREIGN.findall(text))):
        return (0, 0, 0)
    n = [0, 0, 0]
    for token in _TOKEN.findall(text):
        for ch in token:
            if len(o := _offers(ch)) == 1:
                n[next(iter(o))] += 1
    top = max(n)
    return tuple(min(50, round(50 * x / top)) for x in n)


def fold(text: str) -> str:
    """``text`` without ignorable characters, in the composed compatibility form of what looks the same."""
    if text.isascii():
        return text
    if _IGNORABLE.search(text):
        text = _IGNORABLE.sub("", text)
    if _kept().search(text):
        parts = _kept().split(text)
        text = "".join(p if i % 2 else unicodedata.normalize("NFKC", p) for i, p in enumerate(parts))
    else:
        text = unicodedata.normalize("NFKC", text)
    return text.replace("\u2010", "-").replace("\u2011", "-")


def canonical(text: str, model: LetterModel) -> str:
    text = fold(text)
    if text.isascii() or not _FOREIGN.search(text):
        return text
    seen = _seen(text)
    return _TOKEN.sub(lambda m: model.token(m[0], seen) if _FOREIGN.search(m[0]) else m[0], text)


def letter_model(df: DataFrame, column: str) -> np.ndarray:
    """Counts of letter pairs within tokens, by script, over all rows (a fixed 3 x 64 x 64 table)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SCRIPTS) * _ALPHABET * _ALPHABET, dtype=np.int64)
        index = np.concatenate([_letter_index(), np.full(1, -1, np.int16)])
        for b in slices(batches, column):
            flat, _ = code_points([x for x in b.column(column).to_pylist() if x])
            k = index[np.minimum(flat, 0x530)].astype(np.int64)
            a, c = k[:-1], k[1:]
            ok = (a >= 0) & (c >= 0) & (a // _ALPHABET == c // _ALPHABET)
            total += np.bincount(a[ok] * _ALPHABET + c[ok] % _ALPHABET, minlength=total.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    counted = df.select(column).mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(len(SCRIPTS) * _ALPHABET * _ALPHABET, dtype=np.int64)
    for r in counted.collect():  # at most 12,288 rows
        out[r["pair"]] = r["n"]
    return out


def canonicalise(df: DataFrame, column: str, output: str, counts: np.ndarray) -> DataFrame:
    """``df`` with ``output``: the canonical form of ``column``."""
    if output in df.columns:
        raise ValueError(f"column {output} exists already")
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LetterModel(counts)
        for b in slices(batches, column):
            made = [x if x is None else canonical(x, model) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*names, output])

    return df.mapInArrow(apply, schema)


#: Samples that one comparison block of a run holds on average at most, and samples from which on an automaton looks for all at once.
BLOCK, MANY = 4096, 24
#: Bytes of samples that are sent to all tasks at most; more meet their chunks in a shuffle.
SENT = 64 << 20
#: A run with more than one in so many of all chunks is dealt into pieces of that size (so at most as many runs are).
PIECES = 1000


def samples_of(gate: DataFrame) -> DataFrame:
    """(run_id, item, sample): the entries of missing_samples that hold text, once for each key."""
    return (
        gate.select("run_id", "issue_no", F.posexplode("evidence.missing_samples").alias("k", "sample"))
        .where("length(sample) > 0")
        .select("run_id", F.concat_ws("/", "run_id", F.lit("sample"), "issue_no", "k").alias("item"), "sample")
        .distinct()
    )


def _dealt(texts: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``salt``: runs that hold more than one in ``PIECES`` of all rows are dealt into pieces, and their samples go to each."""
    sizes = texts.groupBy("run_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = max(1, -(-total // PIECES))
    hot = [(r["run_id"], -(-r["n"] // share)) for r in sizes.where(f"n > {share} and run_id is not null").collect()]  # fewer than PIECES rows
    pieces = F.broadcast(texts.sparkSession.createDataFrame(hot, "run_id string, pieces long"))
    one = F.coalesce("pieces", F.lit(1))
    dealt = texts.join(pieces, "run_id", "left").withColumn("salt", F.pmod(F.xxhash64("item"), one)).drop("pieces")
    return dealt, samples.join(pieces, "run_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), one - 1))).drop("pieces")


class _Block:
    """Samples that are looked for in contents: raw, and in canonical form."""

    def __init__(self, samples: list[dict], model: LetterModel):
        self.samples = [(s["item"], s["sample"], canonical(s["sample"], model)) for s in samples]
        self.automaton = None
        if len(samples) >= MANY:
            self.automaton = ahocorasick.Automaton()
            by_form: dict[str, list[int]] = {}
            for k, (_, _, form) in enumerate(self.samples):
                if form:
                    by_form.setdefault(form, []).append(k)
            for form, ks in by_form.items():
                self.automaton.add_word(form, ks)
            self.automaton.make_automaton()

    def lost(self, content: str, form: str) -> list[str]:
        """Items of the samples that ``content`` holds by look and not character for character."""
        if self.automaton is None:
            return [item for item, raw, own in self.samples if raw not in content and own and own in form]
        if not len(self.automaton):
            return []
        here = {k for _, ks in self.automaton.iter(form) for k in ks}
        return [self.samples[k][0] for k in sorted(here) if self.samples[k][1] not in content]


def looked_at(chunks: DataFrame, gate: DataFrame, counts: np.ndarray) -> DataFrame:
    """Of every chunk with text (doc_id, item, form, raw): digests of its canonical form and of its characters; and of every
    missing sample that a chunk of its run holds in canonical but not in raw form (item, sample_item).

    Samples are gathered by run into blocks. Up to ``SENT`` bytes of them are sent to the chunks, which then don't move;
    beyond that both meet by run in a shuffle, where large runs are dealt into pieces by their counted rows.
    """
    samples = samples_of(gate)
    blocks = (
        samples.join(samples.groupBy("run_id").agg(F.ceil(F.count("*") / BLOCK).alias("of")), "run_id")
        .withColumn("block", F.expr("pmod(xxhash64(item), of)"))
        .groupBy("run_id", "block")
        .agg(F.collect_list(F.struct("item", "sample")).alias("samples"))
    )
    blocks = cut(blocks, "lookalike-samples")
    size = blocks.agg(F.sum(F.aggregate("samples", F.lit(0).cast("bigint"), lambda n, s: n + F.octet_length(s["item"]) + F.octet_length(s["sample"]) + 32))).first()[0] or 0
    texts = chunks.where("length(content) > 0").select("run_id", "doc_id", F.concat_ws("/", "run_id", "chunk_id").alias("item"), "content")
    if size <= SENT:
        joined = texts.join(F.broadcast(blocks), "run_id", "left")
    else:
        texts, blocks = _dealt(texts, blocks)
        joined = texts.join(blocks, ["run_id", "salt"], "left")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LetterModel(counts)
        known: OrderedDict[tuple, _Block] = OrderedDict()
        for b in slices(batches, "content"):
            out: list[list] = [[], [], [], [], []]
            rows = zip(*(b.column(k).to_pylist() for k in range(5)), range(b.num_rows))
            last, form = None, ""
            for run, block, doc, item, content, i in rows:
                if content != last:
                    last, form = content, canonical(content, model)
                for row, x in zip(out, (doc, item, None, xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass")), xxhash.xxh3_128_digest(content.encode("utf-8", "surrogatepass")))):
                    row.append(x)
                if block is None:
                    continue
                if (run, block) not in known:
                    if len(known) > 256:
                        known.popitem(last=False)
                    known[run, block] = _Block(b.column("samples")[i].as_py(), model)
                for other in known[run, block].lost(content, form):
                    for row, x in zip(out, (None, item, other, None, None)):
                        row.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()))],
                names=["doc_id", "item", "sample_item", "form", "raw"],
            )

    joined = joined.select("run_id", "block", "doc_id", "item", "content", "samples")
    return cut(joined.mapInArrow(match, "doc_id string, item string, sample_item string, form binary, raw binary"), "lookalike")


def look_alike_classes(met: DataFrame) -> DataFrame:
    """(doc_id, item, form, raw) of the chunks whose canonical form a chunk of the same document has in other characters; equal forms meet by their digests."""
    whole = met.where("sample_item is null and doc_id is not null")
    mixed = whole.groupBy("doc_id", "form").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("doc_id", "form")
    return whole.join(mixed, ["doc_id", "form"], "left_semi").select("doc_id", "form", "raw", "item").distinct()


def look_alike_pairs(chunks: DataFrame, gate: DataFrame, counts: np.ndarray) -> DataFrame:
    """(item_a, item_b): chunks of a document with equal canonical and different raw contents, and missing samples that a chunk of their run holds in canonical but not in raw form."""
    met = looked_at(chunks, gate, counts)
    inside = met.where("sample_item is not null").select(F.least("item", "sample_item").alias("item_a"), F.greatest("item", "sample_item").alias("item_b"))
    members = cut(look_alike_classes(met), "lookalike-groups")
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, F.expr("a.doc_id = b.doc_id and a.form = b.form and a.raw <> b.raw and a.item < b.item")).select(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"))
    return pairs.unionByName(inside).distinct()


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks")
    return look_alike_pairs(chunks, table(spark, root, "quality_gate"), letter_model(chunks, "content"))


def p1_canonical(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk content and missing sample with its canonical form."""
    chunks = table(spark, root, "chunks")
    items = (
        chunks.select(F.concat_ws("/", "run_id", "chunk_id").alias("item"), F.col("content").alias("text"))
        .unionByName(samples_of(table(spark, root, "quality_gate")).select("item", F.col("sample").alias("text")))
        .distinct()
    )
    return canonicalise(items, "text", "canonical", letter_model(chunks, "content"))


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    """The same links without all pairs: every chunk of a class of equal look with its class (the least item of the class) and variant (the least item with the same characters)."""
    chunks = table(spark, root, "chunks")
    members = cut(look_alike_classes(looked_at(chunks, table(spark, root, "quality_gate"), letter_model(chunks, "content"))), "lookalike-groups")
    classes = members.groupBy("doc_id", "form").agg(F.min("item").alias("class_item"), F.countDistinct("raw").alias("n_variants"), F.count("*").alias("n_members"))
    variants = members.groupBy("doc_id", "form", "raw").agg(F.min("item").alias("variant_item"))
    return members.join(variants, ["doc_id", "form", "raw"]).join(classes, ["doc_id", "form"]).select("doc_id", "item", "class_item", "variant_item", "n_variants", "n_members")
