"""Problem 8: passages of evaluation items in the texts of a corpus.

Seeds are n-grams. A first pass over the whole corpus counts how often each n-gram of the items occurs; of every stretch of
an item the rarest one becomes a seed, so that no stretch is without one, however common the item's phrases are. A
second pass joins texts to items by the seeds, gathers seeds on near diagonals and aligns item and passage there by
Smith-Waterman. Two searches use this:

* verbatim (``VERBATIM``): seeds of 5 words (12 letters) out of every 18 words (36 letters). What scores less than that
  many matches is dropped, the rest is decided by the exact length of the longest equal run.
* edited copies (``EDITED``): shorter seeds out of shorter stretches, two of them near each other; what reaches
  ``COPY`` of the score of a whole verbatim copy is a copy, whether or not a long equal run is left.

Letter case, width variants, look-alike letters, invisible characters, accents' composition and everything between words
don't count. The items are a stated query set: they are sent to all tasks in blocks of at most ``ITEMS``; nothing of
the corpus is.

Defined results: null and empty texts and items give no rows; items shorter than the stated length can't leak; an item
leaks once for each document, however often the document holds it; repeated rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.arrow import slices
from pagemill.llm.lookalike import TO_LATIN, fold
from pagemill.sources.tables import table

#: Units (words, and letters or digits) of a leak.
LEAK = (18, 36)


@dataclass(frozen=True)
class Search:
    """Units of a seed, units of the stretch that gives one, and how many seeds a passage must hold near each other."""

    seed: tuple[int, int]
    stretch: tuple[int, int]
    together: int


VERBATIM, EDITED = Search((5, 12), LEAK, 1), Search((3, 5), (7, 11), 2)
#: Share of the score of a whole verbatim copy that an edited copy reaches.
COPY = 0.5
#: Items that one pass over the corpus looks for at most.
ITEMS = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
_NONE = (1 << 64) - 1
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FOLD = {ord(a): ord(b) for a, b in TO_LATIN.items()}
_ALNUM = np.fromiter((chr(c).isalnum() for c in range(0x10000)), dtype=bool, count=0x10000)
_HIGH: dict[int, bool] = {}
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(256)], dtype=np.uint64)


def plain(text: str) -> str:
    return text.lower() if text.isascii() else fold(text).translate(_FOLD).lower()


def sequences(texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For words, and for letters and digits: a number for each unit, and the text it is of."""
    flat = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[: flat.size]
    keep = _ALNUM[np.minimum(flat, 0xFFFF)]
    if (high := np.flatnonzero(flat >= 0x10000)).size:  # rare letters, and signs and pictures that are none
        keep[high] = [_HIGH.setdefault(c, chr(c).isalnum()) for c in flat[high].tolist()]
    units, of = flat[keep], owner[keep]
    start = keep & ~np.r_[False, keep[:-1]]
    at = np.flatnonzero(start[keep])
    if not at.size:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        return none, none
    where = np.arange(units.size) - np.repeat(at, np.diff(np.r_[at, units.size]))
    with np.errstate(over="ignore"):
        words = np.add.reduceat((units.astype(np.uint64) + np.uint64(1)) * _POWERS[where & 255] + (where >> 8).astype(np.uint64), at)
        return (words * _MIX ^ words >> np.uint64(31), of[at]), (units.astype(np.uint64), of)


def grams(units: np.ndarray, n: int) -> np.ndarray:
    """A number for every n units in a row."""
    if units.size < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, size = units * _MIX + np.uint64(1), 1
        for bit in bin(n)[3:]:  # doubling: n-grams of 2k or 2k + 1 units from those of k
            out = out[: out.size - size] * np.uint64(pow(int(_BASE), size, 1 << 64)) + out[size:]
            size *= 2
            if bit == "1":
                out = out[:-1] * _BASE + (units[size:] * _MIX + np.uint64(1))
                size += 1
        return (out ^ out >> np.uint64(29)) * _MIX


class Items:
    """The items' units and their n-grams, sorted by number."""

    def __init__(self, rows: list[tuple[int, str, str]], search: Search = VERBATIM):
        self.search = search
        self.ids = [r[0] for r in rows]
        self.kind = [int((r[1] or "").lower().startswith("zh")) for r in rows]
        self.units = []
        for (_, _, text), kind in zip(rows, self.kind):
            made = sequences([plain(text or "")])[kind][0]
            self.units.append(made)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for kind in (0, 1):
            g, item, at = [], [], []
            for k, u in enumerate(self.units):
                if self.kind[k] == kind and u.size >= LEAK[kind]:
                    made = grams(u, search.seed[kind])
                    g.append(made)
                    item.append(np.full(made.size, k))
                    at.append(np.arange(made.size))
            if g:
                g, item, at = np.concatenate(g), np.concatenate(item), np.concatenate(at)
                order = np.argsort(g, kind="stable")
                self.tables.append((g[order], item[order], at[order]))
            else:
                self.tables.append((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
        #: whether an n-gram of letters holds none that isn't ASCII: only then must texts without such letters be searched
        self.ascii = any(self.kind[k] and any((u[i : i + LEAK[1]] < 128).all() for i in range(max(0, u.size - LEAK[1] + 1))) for k, u in enumerate(self.units))
        self.seeds: list[np.ndarray] = [np.unique(t[0]) for t in self.tables]

    def choose(self, frequency: dict[int, int]) -> None:
        """Of every stretch, keep the rarest n-gram."""
        kept: list[set[int]] = [set(), set()]
        for k, u in enumerate(self.units):
            kind = self.kind[k]
            if u.size < LEAK[kind]:
                continue
            g = grams(u, self.search.seed[kind]).tolist()
            width = self.search.stretch[kind] - self.search.seed[kind] + 1
            for i in range(len(g) - width + 1):
                kept[kind].add(min(g[i : i + width], key=lambda x: (frequency.get(x, 0), x)))
        self.seeds = [np.array(sorted(s), dtype=np.uint64) for s in kept]

    def filters(self) -> list[np.ndarray]:
        out = []
        for s in self.seeds:
            f = np.zeros(1 << 20, dtype=bool)
            f[(s >> np.uint64(44)).astype(np.int64)] = True
            out.append(f)
        return out


def _hits(texts: list[str], items: Items, filters: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, units, text of each unit, positions of the n-grams that are seeds, their numbers)."""
    both = sequences(texts)
    for kind in (0, 1):
        seeds = items.seeds[kind]
        if not seeds.size:
            continue
        units, of = both[kind]
        if kind and not items.ascii:  # texts without CJK letters hold no stretch of such an item
            wide = np.zeros(len(texts), dtype=bool)
            wide[of[units >= 0x2E80]] = True
            units, of = units[wide[of]], of[wide[of]]
        size = items.search.seed[kind]
        g = grams(units, size)
        if not g.size:
            continue
        at = np.flatnonzero(filters[kind][(g >> np.uint64(44)).astype(np.int64)])
        at = at[of[at] == of[at + size - 1]]
        place = np.minimum(np.searchsorted(seeds, g[at]), seeds.size - 1)
        at = at[seeds[place] == g[at]]
        yield kind, units, of, at, g[at]


def _count(documents: DataFrame, items: Items) -> dict[int, int]:
    """How often each n-gram of the items occurs in the corpus (at most as many rows as the items have n-grams)."""
    shared = documents.sparkSession.sparkContext.broadcast((items, items.filters()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, filters = shared.value
        total = [np.zeros(s.size, dtype=np.int64) for s in items.seeds]
        for b in slices(batches, "text"):
            texts = [plain(x) for x in b.column("text").to_pylist() if x]
            for kind, _, _, _, g in _hits(texts, items, filters) if texts else ():
                total[kind] += np.bincount(np.searchsorted(items.seeds[kind], g), minlength=items.seeds[kind].size)
        for kind in (0, 1):
            at = np.flatnonzero(total[kind])
            yield pa.RecordBatch.from_arrays([pa.array(items.seeds[kind][at].astype(np.int64), pa.int64()), pa.array(total[kind][at], pa.int64())], names=["gram", "n"])

    counted = documents.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"] % (1 << 64): r["n"] for r in counted}


#: Cells of the alignment rows that are computed at once.
_CELLS = 1 << 16


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Smith-Waterman scores of pairs of unit sequences; pairs of like size are aligned together, row by row."""
    out = [0] * len(pairs)
    order = sorted((k for k, (a, b) in enumerate(pairs) if a.size and b.size), key=lambda k: (pairs[k][1].size, pairs[k][0].size))
    while order:
        # sizes grow towards the end of the order
        width = pairs[order[-1]][1].size
        some = order[-max(1, _CELLS // width) :]
        del order[-len(some) :]
        height = max(pairs[k][0].size for k in some)
        # numbers that no unit has fill the shorter ones up
        rows = np.full((height, len(some), 1), np.uint64(_NONE - 1), dtype=np.uint64)
        columns = np.full((len(some), width), np.uint64(_NONE), dtype=np.uint64)
        for i, k in enumerate(some):
            a, b = pairs[k]
            rows[: a.size, i, 0] = a
            columns[i, : b.size] = b
        row = np.zeros((len(some), width + 1), dtype=np.int32)
        steps = np.arange(width + 1, dtype=np.int32) * -GAP
        best = np.zeros(len(some), dtype=np.int32)
        for x in rows:
            new = np.zeros_like(row)
            np.maximum(row[:, :-1] + np.where(columns == x, np.int32(MATCH), np.int32(MISMATCH)), row[:, 1:] + np.int32(GAP), out=new[:, 1:])
            np.maximum(new, 0, out=new)
            # gaps along the row: running maximum of the value raised by what the gap has cost so far
            row = np.maximum.accumulate(new + steps, axis=1) - steps
            np.maximum(best, row.max(1), out=best)
        for k, score in zip(some, best.tolist()):
            out[k] = score
    return out


def _clusters(units: np.ndarray, of: np.ndarray, at: np.ndarray, g: np.ndarray, items: Items, kind: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, item, diagonals) of the seeds that lie on near diagonals."""
    table_g, table_item, table_at = items.tables[kind]
    low, high = np.searchsorted(table_g, g, "left"), np.searchsorted(table_g, g, "right")
    n = high - low
    if not n.sum():
        return
    k = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
    p, item, q = np.repeat(at, n), table_item[k], table_at[k]
    text, diagonal = of[p].astype(np.int64), p - q
    order = np.lexsort((diagonal, item, text))
    text, item, q, diagonal = text[order], item[order], q[order], diagonal[order]
    reach = np.array([u.size // 4 + 2 for u in items.units])
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > reach[item[1:]])])
    for a, b in zip(new.tolist(), [*new[1:].tolist(), text.size]):
        if items.search.together == 1 or np.unique(q[a:b]).size >= items.search.together:
            yield int(text[a]), int(item[a]), np.unique(diagonal[a:b])


def _longest_run(u: np.ndarray, units: np.ndarray, diagonals: np.ndarray, lo: int, hi: int) -> int:
    """The longest run of equal units on any of the diagonals, within a text's own units."""
    best = 0
    for d in diagonals.tolist():
        a, b = max(0, lo - d), min(u.size, hi - d)
        differ = np.flatnonzero(u[a:b] != units[a + d : b + d])
        best = max(best, int(np.diff(np.r_[-1, differ, b - a]).max()) - 1)
    return best


def leaked(documents: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_id, score, share, longest_run, leak): texts joined to items by seeds, with the best alignment.

    ``share`` is that of the score of a whole verbatim copy; in the verbatim search alignments that can't hold a run of
    the stated length are left out, and ``leak`` tells whether there is one; in the other, whether ``share`` is that of a copy.
    """
    items.choose(_count(documents, items))
    shared = documents.sparkSession.sparkContext.broadcast((items, items.filters()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, filters = shared.value
        verbatim = items.search == VERBATIM
        for b in slices(batches, "text"):
            ids = b.column("doc_id")
            keep = [i for i, x in enumerate(b.column("text").to_pylist()) if x]
            texts = [plain(x) for x in b.column("text").to_pylist() if x]
            found: dict[tuple[int, int], tuple[int, int]] = {}
            for kind, units, of, at, g in _hits(texts, items, filters) if texts else ():
                begin = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
                wanted, pairs = [], []
                for text, item, diagonals in _clusters(units, of, at, g, items, kind):
                    u, lo, hi = items.units[item], begin[text], begin[text + 1]
                    margin = u.size // 4 + 8
                    passage = units[max(lo, int(diagonals[0]) - margin) : min(hi, int(diagonals[-1]) + u.size + margin)]
                    least = MATCH * LEAK[kind] if verbatim else COPY * MATCH * u.size
                    # no alignment scores more than the units of the item that the passage holds at all
                    if MATCH * np.isin(u, passage).sum() >= least:
                        wanted.append((text, item, diagonals, least))
                        pairs.append((u, passage))
                for (text, item, diagonals, least), (u, _), score in zip(wanted, pairs, align(pairs)):
                    if score >= least:
                        run = _longest_run(u, units, diagonals, begin[text], begin[text + 1])
                        known = found.get((text, item), (0, 0))
                        found[text, item] = max(known[0], score), max(known[1], run)
            rows = sorted(found.items())
            size = [items.units[i].size for (_, i), _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([keep[t] for (t, _), _ in rows], pa.int32())),
                    pa.array([items.ids[i] for (_, i), _ in rows], pa.int64()),
                    pa.array([score for _, (score, _) in rows], pa.int32()),
                    pa.array([score / (MATCH * n) for n, (_, (score, _)) in zip(size, rows)], pa.float64()),
                    pa.array([run for _, (_, run) in rows], pa.int32()),
                    pa.array([not verbatim or run >= LEAK[items.kind[i]] for (_, i), (_, run) in rows], pa.bool_()),
                ],
                names=["doc_id", "item_id", "score", "share", "longest_run", "leak"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, item_id bigint, score int, share double, longest_run int, leak boolean")


def leaks_of(documents: DataFrame, eval_items: DataFrame, search: Search) -> DataFrame:
    """``leaked`` for all items, in blocks of about ``ITEMS``, one pass for each."""
    wanted = eval_items.where("length(expected_evidence) > 0").select("item_id", "lang", "expected_evidence").distinct()
    blocks = max(1, -(-wanted.count() // ITEMS))
    out = None
    for k in range(blocks):
        rows = wanted.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {k}")).collect()
        made = leaked(documents, Items(sorted(tuple(r) for r in rows), search))
        out = made if out is None else out.unionByName(made)
    return out


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    found = leaks_of(table(spark, root, "documents"), table(spark, root, "eval_items"), VERBATIM)
    return found.where("leak").select("doc_id", "item_id").distinct()


def p8_copies(spark: SparkSession, root: str) -> DataFrame:
    """Every document with the items of which it holds a copy, edited or not: score, share and longest equal run of the best alignment."""
    found = leaks_of(table(spark, root, "documents"), table(spark, root, "eval_items"), EDITED)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("share").alias("share"), F.max("longest_run").alias("longest_run"))


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    """By item, the number of documents that give it away."""
    return p8_found(spark, root).groupBy("item_id").agg(F.count("*").alias("n_documents"))
