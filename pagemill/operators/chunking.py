"""Heading-aware chunks under a token limit.

Sections, their merging and the packing of blocks depend on what was packed before, so they run as an ordered fold for
each document. A document arrives as one value, so nothing is shuffled: the fold is an Arrow function over the scan. All
sizes come from running sums over the code points of a text, so that no piece of it is measured twice.

The blocks of a document are its lines that aren't blank; a chunk is its blocks with an empty line between them.

Defined results: null, empty and blank texts give no chunks; a text without headings is one section; repeated rows give
repeated chunks; a limit below 1 is refused with ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.functions.arrow import slices
from pagemill.functions.tokens import estimate, is_wide

#: Sections below so many tokens are merged.
SMALL_SECTION = 80
#: Characters of overlap between the parts of an oversized chunk at most.
PART_OVERLAP = 32
CHUNK = (
    ("chunk_id", "string", pa.string()), ("parent_chunk_id", "string", pa.string()), ("part_index", "int", pa.int32()), ("part_count", "int", pa.int32()), ("heading_path", "array<string>", pa.list_(pa.string())),
    ("heading", "string", pa.string()), ("content", "string", pa.string()), ("first_block", "int", pa.int32()), ("last_block", "int", pa.int32()), ("tokens", "int", pa.int32()),
)
_HEADING = re.compile(r"(#{1,6}) ")
_BREAK = re.compile(r"[。！？\n;]|\s+")


class Sizes:
    """Token estimates of any piece of a text."""

    def __init__(self, text: str):
        wide = is_wide(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        self.wide = np.concatenate([[0], np.cumsum(wide)])

    def of(self, a: int, b: int) -> int:
        wide = int(self.wide[b] - self.wide[a])
        return estimate(wide, b - a - wide)


def tokens(text: str) -> int:
    return Sizes(text).of(0, len(text))


def bound(text: str, limit: int) -> Iterator[str]:
    """Parts of a text within the limit: the longest start that fits, back to the last break (sentence end, line end, semicolon or white space) past its half; each part repeats the end of the one before."""
    sizes, start = Sizes(text), 0
    while start < len(text):
        low, high = start + 1, len(text)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if sizes.of(start, mid) <= limit else (low, mid - 1)
        end = low
        if end < len(text):
            last = max((m.end() for m in _BREAK.finditer(text, start, end)), default=start)
            end = last if last - start > (end - start) // 2 else end
        yield text[start:end]
        if end == len(text):
            return
        start = max(start + 1, end - min(PART_OVERLAP, (end - start) // 4))


@dataclass
class Section:
    """Blocks ``first`` to ``last`` (exclusive) with the path of open headings."""

    first: int
    last: int
    path: list[str]
    tokens: int
    small: bool
    bare: bool


def sections(lines: list[str], size) -> list[Section]:
    """A section at each heading; the blocks before the first are one as well. ``size(a, b)`` measures blocks a to b."""
    level = [len(m[1]) if (m := _HEADING.match(x)) else 0 for x in lines]
    starts = [i for i in range(len(lines)) if level[i] or not i]
    out, stack = [], []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        if level[a]:
            while stack and stack[-1][0] >= level[a]:
                stack.pop()
            stack.append((level[a], lines[a].lstrip("#").strip()))
        n = size(a, b)
        out.append(Section(a, b, [t for _, t in stack], n, n < SMALL_SECTION, bool(level[a]) and b - a == 1))
    return out


def merged(found: list[Section], limit: int) -> list[Section]:
    """A heading without body takes in the section after it, whatever its size, and that one's path; neighbours that were both small become one while their sizes fit; a heading that ends the text goes back."""
    out: list[Section] = []

    def join(a: Section, b: Section, path: list[str]) -> Section:
        return Section(a.first, b.last, path, a.tokens + b.tokens, a.small and b.small, a.bare and b.bare)

    for s in found:
        if out and out[-1].bare:
            out[-1] = join(out[-1], s, s.path)
        elif out and out[-1].small and s.small and out[-1].tokens + s.tokens <= limit:
            out[-1] = join(out[-1], s, out[-1].path)
        else:
            out.append(s)
    if len(out) > 1 and out[-1].bare:
        last = out.pop()
        out[-1] = join(out[-1], last, out[-1].path)
    return out


def packed(section: Section, one: list[int], limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of a section's blocks that fill the limit; each begins with the longest ending of the one before within the overlap. ``one`` holds each block's size."""
    first, used = section.first, 0
    for k in range(section.first, section.last):
        if used + one[k] > limit and k > first:
            yield first, k
            room, back = 0, k
            while back > first and room + one[back - 1] <= overlap:
                back -= 1
                room += one[back]
            first, used = back, room
        used += one[k]
    yield first, section.last


def chunks_of(text: str, limit: int = 512, overlap: int = 50) -> list[tuple]:
    """The chunks (columns of ``CHUNK``) of one text."""
    order, lines = [], []
    for k, x in enumerate(text.split("\n")):
        if x.strip():
            order.append(k)
            lines.append(x)
    if not lines:
        return []
    sizes = Sizes("".join(lines))
    at = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).tolist()

    def size(a: int, b: int) -> int:
        wide = int(sizes.wide[at[b]] - sizes.wide[at[a]])
        # an empty line between blocks
        return estimate(wide, at[b] - at[a] - wide + 2 * (b - a - 1))

    one = [size(k, k + 1) for k in range(len(lines))]
    out: list[tuple] = []
    n = 0
    for section in merged(sections(lines, size), limit):
        ranges = [(section.first, section.last)] if section.tokens <= limit else packed(section, one, limit, overlap)
        for k, (a, b) in enumerate(ranges):
            content = "\n\n".join(lines[a:b])
            if k and section.path:
                content = f"{' > '.join(section.path)}（續）\n\n{content}"
            name, count = f"c{n:06d}", tokens(content)
            n += 1
            parts = [content] if count <= limit else list(bound(content, limit))
            for i, part in enumerate(parts, 1):
                cut = count > limit
                out.append((
                    f"{name}_part{i}" if cut else name, name if cut else None, i if cut else None, len(parts) if cut else None, section.path,
                    section.path[-1] if section.path else None, part, order[a], order[b - 1], tokens(part) if cut else count,
                ))
    return out


def chunk_documents(documents: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks of all documents: (key, columns of ``CHUNK``)."""
    if limit < 1:
        raise ValueError(f"the limit is {limit}")
    kind = documents.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            at, rows = [], []
            for i, x in enumerate(b.column(text).to_pylist()):
                made = chunks_of(x, limit, overlap) if x else []
                at += [i] * len(made)
                rows += made
            columns = list(zip(*rows)) if rows else [[] for _ in CHUNK]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, _, t) in zip(columns, CHUNK))], names=[key, *(name for name, _, _ in CHUNK)])

    return documents.select(key, text).mapInArrow(fold, f"{key} {kind}, " + ", ".join(f"{name} {kind}" for name, kind, _ in CHUNK))
