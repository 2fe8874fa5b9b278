"""Problem 7: fill containers of a fixed capacity with whole items.

The plan is made on the histogram of sizes, which has at most as many bins as the capacity, whatever the number of
items. Shallow combinations of lengths (some items of one length, some of a second, one that closes the window) that
fill the capacity up to a small window become the columns of a non-negative least squares problem whose right-hand
side is the histogram; the solution says how often each combination is used. The counts are rounded to what is in
stock, and the residual is packed greedily, largest first. Items then take their places: items of one size are
numbered by a range sort on (size, id), so that a frequent size is spread over tasks, and number ranges of the plan
tell the container.

Defined results: an item above the capacity gets a container of its own (``oversized``), after those of the others, in the order of sizes; empty and null texts have
size 0 and go to the first container; no capacity, a null one or one below 1 is refused with ValueError; two items may
share an id and each gets its place; equal sizes are placed in the order of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.tokens import token_estimate
from pagemill.sources.tables import cut, table

#: Share of the capacity that a combination may leave unused; lengths tried for each leading length; update steps.
WINDOW, PARTNERS, STEPS = 0.004, 6, 300


def combinations(sizes: np.ndarray, stock: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Combinations ((length, times), ...) of at most three lengths that fill the window below the capacity."""
    window = max(1, int(capacity * WINDOW))
    order = np.argsort(-stock, kind="stable")
    common = sizes[order[:64]]
    # for each sum, the largest present length that doesn't exceed it
    below = np.zeros(capacity + 1, dtype=np.int64)
    below[sizes] = sizes
    below = np.maximum.accumulate(below)
    found: dict[tuple, None] = {}
    for lead in sizes.tolist():
        most = capacity // lead
        # a length that no combination carries into the window still gets the fullest ones there are
        best: list[tuple[int, tuple]] = []
        for times in sorted({1, max(1, most // 2), most}):
            room = capacity - lead * times
            if room <= window:
                found[((lead, times),)] = None
            partners = [x for x in common.tolist() if x <= room][:PARTNERS]
            for second in partners:
                for n in sorted({1, max(1, room // second // 2), room // second}):
                    rest = room - second * n
                    last = int(below[rest]) if rest > 0 else 0
                    made: dict[int, int] = {}
                    for length, k in ((lead, times), (second, n), (last, 1 if last else 0)):
                        if k:
                            made[length] = made.get(length, 0) + k
                    pattern = tuple(sorted(made.items(), reverse=True))
                    if rest - last <= window:
                        found[pattern] = None
                        best = [(-1, ())]
                    elif not best or best[0][0] >= 0:
                        best = sorted({*best, (rest - last, pattern)})[:4]
        for unused, pattern in best:
            if unused >= 0:
                found[pattern] = None
    return list(found)


def repeat_counts(patterns: list[tuple[tuple[int, int], ...]], stock: np.ndarray) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram by multiplicative updates.

    ``A x`` is to be ``stock``, with A non-negative, and a row weighs as the square of its length (what stays unplaced is
    counted by volume); x is multiplied by (A' W stock) / (A' W A x) until it settles.
    """
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([length for p in patterns for length, _ in p], dtype=np.int64)
    weight = np.array([k for p in patterns for _, k in p], dtype=np.float64)
    n = len(patterns)
    volume = np.arange(stock.size, dtype=np.float64) ** 2
    target = np.bincount(column, weight * (volume * stock)[row], minlength=n)
    x = np.full(n, stock.sum() / max(1.0, weight.sum()))
    for _ in range(STEPS):
        made = np.bincount(row, weight * x[column], minlength=stock.size)
        x *= target / np.maximum(np.bincount(column, weight * (volume * made)[row], minlength=n), 1e-12)
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(combination, number of containers) that together use exactly the items of ``histogram`` (index: size, from 1 to capacity)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []
    sizes = np.flatnonzero(left)
    patterns = combinations(sizes, left[sizes], capacity) if sizes.size else []
    if patterns:
        x = repeat_counts(patterns, left.astype(np.float64))
        # large items first: they depend on the small ones that close their containers
        for k in np.lexsort((-x, [-p[0][0] for p in patterns])):
            n = int(round(x[k]))
            if n <= 0:
                continue
            n = min(n, *(int(left[s]) // m for s, m in patterns[k]))
            if n > 0:
                out.append((patterns[k], n))
                for s, m in patterns[k]:
                    left[s] -= n * m
    # the residual: largest first, each container closed with the largest lengths that still fit
    present = left > 0
    while present.any():
        room, made = capacity, {}
        at = int(np.flatnonzero(present)[-1])
        while at > 0:
            take = min(int(left[at]), room // at)
            made[at] = take
            room -= take * at
            fit = np.flatnonzero(present[: min(room, at - 1) + 1])
            at = int(fit[-1]) if fit.size else 0
        n = min(int(left[s]) // m for s, m in made.items())
        out.append((tuple(made.items()), n))
        for s, m in made.items():
            left[s] -= n * m
            present[s] = left[s] > 0
    return out


def places(steps: list[tuple[tuple[tuple[int, int], ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """By size and number of the item: size, first number, first container, items in one container; sorted."""
    taken = np.zeros(capacity + 1, dtype=np.int64)
    rows, container = [], 0
    for pattern, n in steps:
        for size, m in pattern:
            rows.append((size, int(taken[size]), container, m))
            taken[size] += n * m
        container += n
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def numbered(items: DataFrame, capacity: int) -> DataFrame:
    """(id, full, size, nth): items that aren't empty, numbered within their size; sizes above the capacity count as one more than it (``full`` is the size itself)."""
    clipped = items.where("size > 0").select("id", F.least("size", F.lit(capacity + 1)).alias("bin"), F.col("size").alias("full"))
    spread = clipped.repartitionByRange("bin", "full", "id").sortWithinPartitions("bin", "full", "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            size = b.column(1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.r_[size[:1] != last, size[1:] != size[:-1]])
            start = np.zeros(size.size, dtype=np.int64)
            start[new] = new
            start = np.maximum.accumulate(start)
            nth = np.arange(size.size) - start
            if size.size and size[0] == last:
                nth[start == 0] += n
            last, n = int(size[-1]), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(np.full(size.size, part), pa.int32()), pa.array(nth, pa.int64())], names=["id", "full", "size", "part", "nth"])

    kind = items.schema["id"].dataType.simpleString()
    local = cut(spread.mapInArrow(count, f"id {kind}, full bigint, size bigint, part int, nth bigint"), "pack-numbers")
    # a size spans several parts only where it is frequent: rows are at most sizes plus parts
    counts = sorted((r["size"], r["part"], r["n"]) for r in local.groupBy("size", "part").agg(F.count("*").alias("n")).collect())
    offset, last, total = {}, None, 0
    for size, part, n in counts:
        total = total if size == last else 0
        if total:
            offset[size, part] = total
        last, total = size, total + n
    keys = sorted(offset)
    packed = np.array([s << 24 | p for s, p in keys], dtype=np.int64)
    add = np.array([offset[k] for k in keys], dtype=np.int64)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, part, nth = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 4))
            if packed.size:
                key = size << 24 | part
                at = np.minimum(np.searchsorted(packed, key), packed.size - 1)
                nth = nth + np.where(packed[at] == key, add[at], 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(nth, pa.int64())], names=["id", "full", "size", "nth"])

    return local.mapInArrow(shift, f"id {kind}, full bigint, size bigint, nth bigint")


def pack(items: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(pack_id, container, id, size, oversized) for items (id, size) and capacities (pack_id, capacity).

    ``container`` counts from 0 within a pack; an oversized item is alone in its container.
    """
    if not capacities:
        raise ValueError("no capacity is given")
    for pack_id, capacity in capacities:
        if capacity is None or capacity < 1:
            raise ValueError(f"capacity of pack {pack_id} is {capacity}")
    most = max(c for _, c in capacities)
    # ids and sizes are read several times (range bounds, numbering, what is left over): texts only once
    items = cut(items.select("id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")), "pack-sizes")
    kind = items.schema["id"].dataType.simpleString()
    places_of = numbered(items, most)
    histogram = np.zeros(most + 2, dtype=np.int64)
    for r in places_of.groupBy("size").agg(F.count("*").alias("n")).collect():  # at most ``most`` rows and one
        histogram[r["size"]] = r["n"]
    below = np.r_[0, np.cumsum(histogram)]
    tables = []
    for p, c in capacities:
        steps = plan(histogram[: c + 1], c)
        # oversized items follow the shared containers, of which the first is there in any case (for empty items)
        tables.append((p, c, places(steps, c), below - below[c + 1] + max(1, sum(n for _, n in steps))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, nth = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            for pack_id, capacity, (sizes, first, container, m), alone in tables:
                fits = size <= capacity
                where = np.zeros(size.size, np.int64)
                if sizes.size:
                    step = int(nth.max(initial=0)) + int(first.max()) + 2
                    at = np.maximum(np.searchsorted(sizes * step + first, size * step + nth, side="right") - 1, 0)
                    where = container[at] + (nth - first[at]) // m[at]
                where = np.where(fits, where, alone[size] + nth)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size.size, pack_id), pa.int32()), pa.array(where, pa.int64()), b.column(0), b.column(1), pa.array(~fits)],
                    names=["pack_id", "container", "id", "size", "oversized"],
                )

    schema = f"pack_id int, container bigint, id {kind}, size bigint, oversized boolean"
    placed = places_of.mapInArrow(place, schema)
    # texts without tokens
    rest = (
        items.where("size < 1")
        .select(F.explode(F.array(*(F.lit(int(p)) for p, _ in capacities))).alias("pack_id"), "id", "size")
        .select("pack_id", F.lit(0).cast("bigint").alias("container"), "id", "size", F.lit(False).alias("oversized"))
    )
    return placed.unionByName(rest)


def _packed(spark: SparkSession, root: str) -> DataFrame:
    specs = [(r["pack_id"], r["capacity_tokens"]) for r in table(spark, root, "pack_specs").distinct().orderBy("pack_id").collect()]
    items = table(spark, root, "documents").select(F.col("doc_id").alias("id"), token_estimate("text").alias("size"))
    return pack(items, specs).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root).where("oversized").select("pack_id", "doc_id").distinct()


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """Every document's container, for each capacity."""
    return _packed(spark, root)


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """Members and fill of all containers; ``oversized`` marks those of one document above the capacity."""
    return _packed(spark, root).groupBy("pack_id", "container").agg(F.count("*").alias("members"), F.sum("size").alias("fill"), F.max("oversized").alias("oversized"))


P7_FOUND_SQL = """
with sized as (
  select doc_id, length(text) as n,
         length(regexp_replace(text, '[^\\x{3000}-\\x{303F}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{FF00}-\\x{FFEF}]', '', 'g')) as w
  from documents)
select distinct p.pack_id, s.doc_id from sized s, pack_specs p
where ((2 * w + 2) // 3 + (n - w + 3) // 4) > p.capacity_tokens
"""
