"""Problem 4: text that was cut by a field limit or during transfer.

A backward character n-gram model is trained over all values: for the last 1 to 8 characters before a position (digits
count as one class, letters in lower case, width variants and look-alikes folded) it counts how often a value, sentence,
list entry or table row ends there and how often it goes on. The contexts of ends and of continuations are counted apart for
running text, list entries, table rows and headings, and for each column. Shorter contexts smooth longer ones. A
value's log-odds compare the likelihood of its final context at a true end with that at a random stop; its own end is
left out of the counts; the share of ends among all places is one for each column. What is copied counts once (a content by its text, a message by its text and the contents of its document):
the copies of a cut value would else vouch for its end. The threshold follows from the share of cut values, which is estimated by expectation
maximisation for each language and column (and for values with a mark in running text apart) from all values.

Only contexts at which a value ends are counted, each under its full 64-bit key, and of those all: the end of a cut value
is a rare end, so the rare contexts are the ones that tell it. Up to ``MOST`` contexts are sent to the workers at once. Where there
are more, they are dealt into blocks by their last ``GROUP`` characters, and the values are read once for each block; all
longer contexts of a place are in one block, shorter ones are in every block.

Defined results: null and empty values and values without a letter are no cases; a mark put after the stop (dots, brackets,
replacement characters) is taken off before scoring; an ending that is one long code is complete; a part of a split
chunk whose next part exists is no case; repeated rows count once, and so do copied documents.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.arrow import code_points, slices
from pagemill.llm.langs import guess
from pagemill.llm.lookalike import TO_LATIN
from pagemill.sources.tables import cut, table

LONGEST, SMOOTH = 8, 4.0
#: Contexts that are sent to the workers at once; the last characters by which more of them are dealt, and the parts (a power of 2) that these fall into.
MOST, GROUP, PARTS = 2_000_000, 3, 4096
#: Recounts of the ends, and nats above the threshold up to which a value's end is left out of them.
ROUNDS, DOUBT = 2, 4.5
#: What may stand after the stop.
MARK = re.compile(r"(?:\s*(?:\[\s*(?:\.{2,}|…+)\s*\]|\(\s*(?:\.{2,}|…+)\s*\)|\.{2,}|…+|�+|[\[(<]\s*(?:truncated|cut|continued|more)[^\])>]*[\])>]))+\s*$", re.I)
_CODE = re.compile(r"[0-9A-Za-z+/=]{32,}[.。]?$")
_LIST = re.compile(r"\s*(?:[-*•・·◦‣–📎>]|\d{1,3}[.)、）．]|[a-z][.)])\s+")
_TEXT, _ENTRY, _ROW, _HEAD = range(4)


def _fold_table() -> np.ndarray:
    out = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x250):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    for c in range(0xFF01, 0xFF5F):
        out[c] = out[c - 0xFEE0]
    for a, b in TO_LATIN.items():
        out[ord(a)] = ord(b.lower())
    for c in (0xA0, 0x2002, 0x2007, 0x202F, 0x3000):
        out[c] = 32
    for c in (0x2010, 0x2011):
        out[c] = 45
    out[48:58] = 48
    out[0xFF10:0xFF1A] = 48
    for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF):
        out[c] = 0  # dropped
    return out


_FOLD = _fold_table()
_STOPS = np.isin(np.arange(0x10000), [ord(x) for x in ".!?。！？"])
_CAPITAL = np.fromiter((chr(c).isupper() or c >= 0x3000 for c in range(0x10000)), dtype=bool, count=0x10000)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _folded(flat: np.ndarray) -> np.ndarray:
    return np.where(flat < 0x10000, _FOLD[np.minimum(flat, 0xFFFF)], flat)


def line_kind(line: str) -> int:
    if line.startswith("|"):
        return _ROW
    if line.startswith("#"):
        return _HEAD
    return _ENTRY if _LIST.match(line) else _TEXT


def _end_of(text: str) -> tuple[str, int, bool] | None:
    """(text before the stop, kind of the last line, whether a mark was taken off); null for a text without characters."""
    text = text.rstrip()
    m = MARK.search(text, max(0, len(text) - 60)) if text and text[-1] in "].)>…�" else None
    bare = text[: m.start()].rstrip() if m else text
    if not bare:
        return None
    at = bare.rfind("\n") + 1
    return bare, line_kind(bare[at : at + 12]), m is not None


def _end_keys(ends: list[tuple[str, int]], column: np.ndarray) -> np.ndarray:
    """For each (text, kind), the keys of the contexts of 1 to LONGEST characters at its end; 0 where it is shorter."""
    # twice the length leaves room for characters that are dropped
    points = np.zeros((len(ends), 3 * LONGEST), dtype=np.uint32)
    for i, (text, _) in enumerate(ends):
        last = text[-3 * LONGEST :]
        points[i, 3 * LONGEST - len(last) :] = np.frombuffer(last.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = _folded(points)
    # dropped characters move to the front, the others keep their order
    points = np.take_along_axis(points, np.argsort(points > 0, axis=1, kind="stable"), axis=1)[:, -LONGEST:]
    salt = np.array([k for _, k in ends], dtype=np.uint64) + np.uint64(4) * column.astype(np.uint64)
    out = np.zeros((len(ends), LONGEST), dtype=np.uint64)
    p = points.astype(np.uint64)
    h, power = np.zeros(len(ends), dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for length in range(1, LONGEST + 1):
            c = p[:, LONGEST - length]
            h = h + (c + np.uint64(1)) * power
            power = power * _BASE
            out[:, length - 1] = np.where(c > 0, _mixed(h, salt, length), np.uint64(0))
    return out


def _mixed(h: np.ndarray, salt: np.ndarray, length: int) -> np.ndarray:
    m = (h ^ (h >> np.uint64(29)) ^ salt * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)) * np.uint64(0x94D049BB133111EB)
    # the low bits of a product depend on few bits of its factors
    return np.maximum(m ^ (m >> np.uint64(32)), np.uint64(1))


class Contexts:
    """Contexts at which values end: sorted keys, found through the range of keys that begin with the same bits (at most 48 bytes for each, with the keys)."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        bits = max(10, int(4 * max(1, keys.size)).bit_length())
        self.shift = np.uint64(64 - bits)
        size = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.zeros(size.size + 1, dtype=np.int32)
        np.cumsum(size, out=self.first[1:])
        self.used = size > 0
        self.most = int(size.max(initial=0))

    def __reduce__(self):
        # what is sent is the keys; the rest is made again from them
        return Contexts, (self.keys,)

    @property
    def size(self) -> int:
        return self.keys.size

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is no such context."""
        out = np.full(keys.size, -1, dtype=np.int32)
        bucket = (keys >> self.shift).astype(np.int64)
        left = np.flatnonzero(self.used[bucket])
        bucket = bucket[left]
        at, end, wanted = self.first[bucket], self.first[bucket + 1], keys[left]
        for _ in range(self.most):
            same = self.keys[at] == wanted
            out[left[same]] = at[same]
            at = at + np.int32(1)
            more = ~same & (at < end)
            if not more.any():
                break
            left, at, end, wanted = left[more], at[more], end[more], wanted[more]
        return out


def values_of(chunks: DataFrame, gate: DataFrame) -> DataFrame:
    """(run_id, item_id, doc_id, col, text): contents (col 0) and messages (col 1) that hold text."""
    contents = chunks.select("run_id", F.col("chunk_id").alias("item_id"), "doc_id", F.lit(0).alias("col"), F.col("content").alias("text"))
    messages = gate.select("run_id", F.concat_ws("/", F.lit("message"), "issue_no").alias("item_id"), "doc_id", F.lit(1).alias("col"), F.col("message").alias("text"))
    return contents.unionByName(messages).where("length(trim(text)) > 0")


def _alike(ends: DataFrame) -> DataFrame:
    """(doc_id, unit): documents that hold the same contents have one unit, told by the least hash of a document's contents, so that copies may differ in a few of them."""
    return ends.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("col") == 0, F.col("text_hash"))), F.min("text_hash")).alias("unit"))


def _units(values: DataFrame, alike: DataFrame) -> DataFrame:
    """``values`` with ``unit``: equal texts of one unit are copies. Contents are one unit; messages, which follow templates, have that of their document."""
    messages = values.where("col = 1").join(alike, "doc_id", "left").withColumn("unit", F.coalesce("unit", F.lit(0)))
    return values.where("col = 0").withColumn("unit", F.lit(0).cast("bigint")).unionByName(messages)


def _texts(values: DataFrame, alike: DataFrame) -> DataFrame:
    """(col, unit, text) of each text of a unit once."""
    return _units(values, alike).select("col", "unit", "text").distinct()


def _ends(values: DataFrame) -> DataFrame:
    """(run_id, item_id, doc_id, col, lang, marked, usable, text_hash, keys) of every value; ``usable`` is false where nothing can be said (no letter, an ending that is one long code)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "tail"):
            lang, marked, ends, usable = [], [], [], []
            for text in b.column("tail").to_pylist():
                end = _end_of(text)
                lang.append(guess(text))
                marked.append(bool(end and end[2] and end[1] in (_TEXT, _HEAD)))
                ends.append(end[:2] if end else ("", 0))
                usable.append(bool(end) and not _CODE.search(end[0], max(0, len(end[0]) - 64)) and any(map(str.isalpha, end[0])))
            keys = _end_keys(ends, b.column("col").to_numpy(zero_copy_only=False))
            packed = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), LONGEST).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in ("run_id", "item_id", "doc_id", "col")), pa.array(lang, pa.string()), pa.array(marked, pa.bool_()), pa.array(usable, pa.bool_()), b.column("text_hash"), packed],
                names=["run_id", "item_id", "doc_id", "col", "lang", "marked", "usable", "text_hash", "keys"],
            )

    # the end decides, and the start of the last line where that line is long; the rest of a text is counted in _count_inside
    last = F.expr("substring_index(rtrim(text), '\n', -1)")
    tail = F.when(F.length(last) > 380, F.concat(F.lit("\n"), F.substring(last, 1, 8), F.expr("right(rtrim(text), 390)"))).otherwise(F.expr("right(rtrim(text), 400)"))
    tails = values.select("run_id", "item_id", "doc_id", "col", F.xxhash64("text").alias("text_hash"), tail.alias("tail"))
    return tails.mapInArrow(find, "run_id string, item_id string, doc_id string, col int, lang string, marked boolean, usable boolean, text_hash bigint, keys array<bigint>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, LONGEST)


def _counted(ends: DataFrame) -> DataFrame:
    """(key, part, col, n) of every context at which a value ends, and its column; equal ends of one document count once. Contexts under GROUP characters have part -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = _matrix(b.column("keys"))
                part = np.where(np.arange(LONGEST) < GROUP - 1, -1, _part(keys[:, GROUP - 1 : GROUP])).ravel()
                keys, first, n = np.unique(keys.ravel(), return_index=True, return_counts=True)
                there = keys > 0
                first = first[there]
                col = b.column("col").to_numpy(zero_copy_only=False)[first // LONGEST]
                yield pa.RecordBatch.from_arrays([pa.array(keys[there].view(np.int64)), pa.array(part[first], pa.int32()), pa.array(col, pa.int32()), pa.array(n[there], pa.int64())], names=["key", "part", "col", "n"])

    counted = _distinct(ends).mapInArrow(count, "key bigint, part int, col int, n bigint")
    return cut(counted.groupBy("key").agg(F.min("part").alias("part"), F.min("col").alias("col"), F.sum("n").alias("n")), "truncation-contexts")


def _part(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(PARTS - 1)).astype(np.int32)


def _count_ends(ends: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all contexts at which a value ends, and the ends at each."""
    found = _counted(ends).toArrow()
    return found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()


def _dealt(counted: DataFrame) -> list[range]:
    """Ranges of parts with MOST contexts at most (unless a part alone has more), with the short ones that each holds too."""
    size = {r["part"]: r["count"] for r in counted.groupBy("part").count().collect()}
    room, held, starts = max(MOST - size.get(-1, 0), MOST // 2), 0, [0]
    for part in range(PARTS):
        n = size.get(part, 0)
        if held and held + n > room:
            starts.append(part)
            held = 0
        held += n
    return [range(a, b) for a, b in zip(starts, [*starts[1:], PARTS])]


class Block:
    """The contexts of some parts and what was counted at them, in a file of the driver while others are at work."""

    def __init__(self, folder: str, parts: range, counted: DataFrame, values: DataFrame):
        self.parts, self.path = parts, f"{folder}/{parts.start}.npz"
        found = counted.where(F.col("part").between(parts.start, parts.stop - 1) | (F.col("part") < 0)).toArrow()
        keys, part, col, n = (found.column(k).to_numpy() for k in ("key", "part", "col", "n"))
        keys = keys.view(np.uint64)
        contexts = Contexts(keys)
        inside, closed = _count_inside(values, contexts, parts)
        # short contexts are in every block, the first one's are added up
        own = _placed(contexts, keys, (part >= 0) | (parts.start == 0)) > 0
        col = _placed(contexts, keys, col)
        self.going = _by_column(inside, own, col)
        self._save(keys=contexts.keys, own=own, col=col, inside=inside, closed=closed, counts=_placed(contexts, keys, n))

    def _save(self, **arrays: np.ndarray) -> None:
        self.total = _by_column(arrays["counts"], arrays["own"], arrays["col"])
        np.savez(self.path, **arrays)

    def load(self) -> dict[str, np.ndarray]:
        with np.load(self.path) as f:
            return dict(f)

    def ends(self, ends: DataFrame) -> DataFrame:
        """The ends whose contexts are here; those under GROUP characters are in the first block."""
        if len(self.parts) == PARTS:
            return ends
        return ends.where(F.expr(f"(keys[{GROUP - 1}] & {PARTS - 1}) between {self.parts.start} and {self.parts.stop - 1}"))

    def recount(self, ends: DataFrame) -> None:
        """Takes the counts from other ends, which are those of all blocks."""
        arrays = self.load()
        self._save(**arrays | {"counts": _recount(ends, Contexts(arrays["keys"]))})


def _distinct(ends: DataFrame) -> DataFrame:
    return ends.where("usable").select("doc_id", "col", "keys").distinct().select("col", "keys")


def _once(ends: DataFrame, alike: DataFrame) -> DataFrame:
    """The usable ends, copies only in one of their documents (named by a hash, so that the aggregate needs no sort)."""
    usable = ends.where("usable").select("doc_id", "col", "text_hash", "keys")
    return _units(usable, alike).groupBy("col", "unit", "text_hash", "keys").agg(F.min(F.xxhash64("doc_id")).alias("doc_id")).withColumn("usable", F.lit(True))


def _recount(ends: DataFrame, contexts: Contexts) -> np.ndarray:
    """The ends at each context, of other ends."""
    shared = ends.sparkSession.sparkContext.broadcast(contexts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                place = shared.value.find(_matrix(b.column("keys")).ravel())
                place, n = np.unique(place[place >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(n, pa.int64())], names=["place", "n"])

    summed = _distinct(ends).mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(contexts.size, dtype=np.int64)
    out[summed.column("place").to_numpy()] = summed.column("n").to_numpy()
    return out


def _placed(contexts: Contexts, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` at the places of ``keys``, which are all contexts; 0 elsewhere."""
    out = np.zeros(contexts.size, dtype=np.int64)
    out[contexts.find(keys)] = n
    return out


def _by_column(n: np.ndarray, own: np.ndarray, col: np.ndarray) -> np.ndarray:
    return np.array([n[own & (col == c)].sum() for c in (0, 1)])


def _count_inside(values: DataFrame, contexts: Contexts, parts: range = range(PARTS)) -> tuple[np.ndarray, np.ndarray]:
    """Continuations, and ends of list entries and table rows inside values, at the contexts at which any value ends and which are those of ``parts`` or short."""
    wanted = values.sparkSession.sparkContext.broadcast(contexts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        total, closed = np.zeros(known.size, dtype=np.int64), np.zeros(known.size, dtype=np.int64)
        # slices whose arrays stay in the processor's caches
        for b in slices(batches, "text", 400_000):
            for column in (0, 1):
                texts = [t for c, t in zip(b.column("col").to_pylist(), b.column("text").to_pylist()) if c == column]
                if not texts:
                    continue
                flat, _ = code_points([t + "\n" for t in texts])
                capital = _CAPITAL[np.minimum(flat, 0xFFFF)]
                flat = _folded(flat)
                flat, capital = flat[flat > 0], capital[flat > 0]
                # the kind of each line, from its first characters, on all its characters
                starts = np.r_[0, np.flatnonzero(flat[:-1] == 10) + 1]
                first = [flat[np.minimum(starts + k, flat.size - 1)] for k in range(4)]
                kind = np.full(starts.size, _TEXT, dtype=np.uint64)
                bullet = np.isin(first[0], np.array([ord(x) for x in "-*•・·◦‣–📎>"], dtype=np.uint32)) & (first[1] == 32)
                after = lambda k: np.isin(first[k], np.array([ord(x) for x in ".)、）．"], dtype=np.uint32)) & (first[k + 1] == 32)
                number = (first[0] == 48) & (after(1) | (first[1] == 48) & after(2))
                kind[bullet | number] = _ENTRY
                kind[first[0] == ord("|")] = _ROW
                kind[first[0] == ord("#")] = _HEAD
                salt = np.repeat(kind, np.diff(np.r_[starts, flat.size])) + np.uint64(4 * column)
                following = np.r_[flat[1:], 10]
                # a sentence that ends inside a text might end it: such a place is an end, not a continuation
                closes = _STOPS[np.minimum(flat, 0xFFFF)]
                sentence = closes & (flat >= 0x3000) | closes & ((following == 32) | (following == 10)) & np.r_[capital[2:], True, True]
                inside = (following != 10) & (flat != 10) & ~sentence
                listed = (salt == 4 * column + _ENTRY) | (salt == 4 * column + _ROW)
                # the last line of a value isn't counted here: its end is a value's end
                again = np.r_[flat[2:], 10, 10] != 10
                # menu names end in dots of their own, which scoring takes off
                points = np.flatnonzero(flat == 46)
                points = points[(points > 0) & (points + 3 < flat.size)]
                points = points[(flat[points + 1] == 46) & (flat[points + 2] == 46) & (flat[points + 3] == 10) & (flat[points - 1] != 46)] - 1
                dotted = np.zeros(flat.size, dtype=bool)
                dotted[points] = True
                stops = ((following == 10) & again | dotted) & listed & (flat != 10) | sentence
                inside &= ~(dotted & listed)
                met: list[np.ndarray] = []
                shut: list[np.ndarray] = []
                p = flat.astype(np.uint64) + np.uint64(1)
                at = np.flatnonzero(inside | stops)
                h, power = np.zeros(at.size, dtype=np.uint64), np.uint64(1)
                with np.errstate(over="ignore"):
                    for length in range(1, LONGEST + 1):
                        reach = at >= length - 1
                        at = at[reach]
                        # the character furthest from the end carries the highest power
                        h = h[reach] + p[at - length + 1] * power
                        power = power * _BASE
                        keys = _mixed(h, salt[at], length)
                        if length == GROUP and len(parts) < PARTS:
                            part = _part(keys)
                            held = (part >= parts.start) & (part < parts.stop)
                            at, h, keys = at[held], h[held], keys[held]
                        place = known.find(keys)
                        # where a context is none of an end, neither is a longer one
                        hit = place >= 0
                        at, h, place = at[hit], h[hit], place[hit]
                        met.append(place[inside[at]])
                        shut.append(place[stops[at]])
                total += np.bincount(np.concatenate(met), minlength=known.size)
                closed += np.bincount(np.concatenate(shut), minlength=known.size)
        at = np.flatnonzero(total | closed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64()), pa.array(closed[at], pa.int64())], names=["place", "n", "closed"])

    counted = values.select("col", "text").mapInArrow(count, "place bigint, n bigint, closed bigint")
    summed = counted.groupBy("place").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed")).toArrow()
    inside, closed = np.zeros(contexts.size, dtype=np.int64), np.zeros(contexts.size, dtype=np.int64)
    at = summed.column("place").to_numpy()
    inside[at], closed[at] = summed.column("n").to_numpy(), summed.column("closed").to_numpy()
    return inside, closed


def _score(ends: DataFrame, blocks: list[Block], drop: tuple[str, ...] = ()) -> DataFrame:
    """``ends`` with log_odds; ``counted`` tells whether a value's own end is among the counts."""
    # a message ends sooner than a content: the share of ends among the places is one for each column
    total, going = (np.maximum(1, sum(n) // LONGEST) for n in ([b.total for b in blocks], [b.going for b in blocks]))
    base = total / (total + going)
    return reduce(DataFrame.unionByName, [cut(_score_block(b.ends(ends), base, **b.load()).drop(*drop), "truncation-scores") for b in blocks])


def _score_block(ends: DataFrame, base: np.ndarray, keys: np.ndarray, counts: np.ndarray, closed: np.ndarray, inside: np.ndarray, **_: np.ndarray) -> DataFrame:
    tables = ends.sparkSession.sparkContext.broadcast((Contexts(keys), (counts + closed).astype(np.float32), inside.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stop, go = tables.value
        for b in batches:
            if not b.num_rows:
                continue
            keys, own = _matrix(b.column("keys")), b.column("counted").to_numpy(zero_copy_only=False)
            p = start = base[b.column("col").to_numpy(zero_copy_only=False)]
            prior, last = start, np.full(b.num_rows, np.inf)
            for length in range(LONGEST):
                # ends of values that aren't usable may be no context; they get no score
                place = known.find(keys[:, length])
                here = place >= 0
                e = np.where(here, np.maximum(0.0, stop[place] - own), 0.0) if stop.size else np.zeros(b.num_rows)
                n = e + (go[place] if go.size else 0.0)
                # a longer context that is seen nearly as often is the same evidence: it replaces the last, else it builds on it
                new = here & (n < last / 2)
                prior, last = np.where(new, p, prior), np.where(new, n, last)
                p = np.where(here, (e + SMOOTH * prior) / (n + SMOOTH), p)
            p = np.clip(p, 1e-9, 1 - 1e-9)
            odds = pa.array(np.log(p / (1 - p)) - np.log(start / (1 - start)), pa.float64(), mask=~b.column("usable").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, odds], names=[*b.schema.names, "log_odds"])

    return ends.mapInArrow(score, T.StructType([*ends.schema.fields, T.StructField("log_odds", T.DoubleType())]))


def scored(values: DataFrame) -> tuple[DataFrame, dict[tuple[str, int, bool], float]]:
    """(run_id, item_id, doc_id, col, lang, marked, log_odds) of every value, and the thresholds; high log-odds speak for a true end.

    Cut values are among the ends that are counted, so the counts are taken again without those that look cut.
    """
    ends = cut(_ends(values), "truncation-ends")
    alike = cut(_alike(ends), "truncation-alike")
    counted = _counted(_once(ends, alike))
    dealt, texts = _dealt(counted), _texts(values, alike)
    # where there are several blocks, each reads the texts
    texts = cut(texts, "truncation-texts") if len(dealt) > 1 else texts
    with tempfile.TemporaryDirectory(prefix="truncation-") as folder:
        blocks = [Block(folder, parts, counted, texts) for parts in dealt]
        own: Column = F.lit(1)
        for _ in range(ROUNDS):
            scores = _score(ends.withColumn("counted", own).drop("keep"), blocks)
            limit = _limit(thresholds(scores))
            ends = scores.withColumn("keep", F.coalesce(F.col("log_odds") >= limit + DOUBT, F.lit(True)).cast("int")).drop("counted", "log_odds")
            for b in blocks:
                b.recount(_once(ends.where("keep = 1"), alike))
            own = F.col("keep")
        scores = _score(ends.withColumn("counted", own).drop("keep"), blocks, ("keys",))
    return scores, thresholds(scores)


def _limit(limits: dict[tuple[str, int, bool], float]) -> Column:
    cases = [F.when((F.col("lang") == lang) & (F.col("col") == col) & (F.col("marked") == marked), F.lit(x)) for (lang, col, marked), x in sorted(limits.items())]
    return F.coalesce(*cases, F.lit(0.0))


def thresholds(scores: DataFrame) -> dict[tuple[str, int, bool], float]:
    """By language, column and mark, the log-odds below which a cut is likelier than an end, given the estimated share of cuts."""
    bins = scores.where("log_odds is not null").groupBy("lang", "col", "marked", F.round(F.col("log_odds") * 4).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    out: dict[tuple[str, int, bool], float] = {}
    for key in {(r["lang"], r["col"], r["marked"]) for r in bins}:
        own = [r for r in bins if (r["lang"], r["col"], r["marked"]) == key]
        odds = np.array([r["bin"] / 4 for r in own])
        n = np.array([r["n"] for r in own], dtype=np.float64)
        share = 0.05
        for _ in range(50):
            cut_of = share / (share + (1 - share) * np.exp(np.clip(odds, -30, 30)))
            share = min(max(float((cut_of * n).sum() / n.sum()), 1e-4), 0.98)
        out[key] = float(np.log(share / (1 - share)))
    return out


def truncated(chunks: DataFrame, gate: DataFrame) -> DataFrame:
    """(run_id, item_id, doc_id, col, lang, log_odds, marked, cut) of every value."""
    scores, limits = scored(values_of(chunks, gate))
    parts = chunks.where("metadata.part_index is not null").select("run_id", F.regexp_replace("chunk_id", r"_part\d+$", "").alias("whole"), F.col("metadata.part_index").alias("k"), "chunk_id").distinct()
    followed = (
        parts.alias("a")
        .join(parts.alias("b"), F.expr("a.run_id = b.run_id and a.whole = b.whole and b.k = a.k + 1"), "left_semi")
        .select("run_id", F.col("chunk_id").alias("item_id"), F.lit(True).alias("goes_on"))
        .distinct()
    )
    return (
        scores.join(followed, ["run_id", "item_id"], "left")
        .withColumn("cut", F.coalesce(F.col("log_odds") < _limit(limits), F.lit(False)) & F.col("goes_on").isNull())
        .drop("goes_on", "usable", "text_hash", "counted")
    )


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return truncated(table(spark, root, "chunks"), table(spark, root, "quality_gate")).where("cut").select("run_id", "item_id").distinct()


def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    """By source and column: values, cut values and their share."""
    found = truncated(table(spark, root, "chunks"), table(spark, root, "quality_gate"))
    source = table(spark, root, "docs").select("doc_id", F.regexp_extract("source_path", "^/data/inbox/([^/]+)/", 1).alias("source")).dropDuplicates(["doc_id"])
    return (
        found.join(source, "doc_id", "left")
        .groupBy("source", F.when(F.col("col") == 0, "content").otherwise("message").alias("field"))
        .agg(F.count("*").alias("n_values"), F.sum(F.col("cut").cast("int")).alias("n_cut"))
        .withColumn("share", F.col("n_cut") / F.col("n_values"))
    )
