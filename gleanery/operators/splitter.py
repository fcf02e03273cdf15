"""Recursive text splitting, the one step that is sequential within a document.

A document never leaves its row: Spark decides where rows go, and the helper
below turns one text into ranges. It works on character positions, so a chunk's
start comes for free and pieces are never copied before the final slice.
"""

from bisect import bisect_left, bisect_right
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.schema import (
    CODE_SEPARATORS,
    MARKDOWN_SEPARATORS,
    PYTHON_SEPARATORS,
    TEXT_SEPARATORS,
)

SEPARATORS_BY_KIND = {
    "text": TEXT_SEPARATORS,
    "markdown": MARKDOWN_SEPARATORS,
    "sections": MARKDOWN_SEPARATORS,
    "python": PYTHON_SEPARATORS,
    "code": CODE_SEPARATORS,
}


def _edges(text: str, lo: int, hi: int, separator: str) -> Sequence[int]:
    """Piece boundaries of ``text[lo:hi]``; a separator opens the piece after it."""
    if separator == "":
        return range(lo, hi + 1)
    edges = [lo]
    at = text.find(separator, lo, hi)
    while at != -1:
        if at > lo:
            edges.append(at)
        at = text.find(separator, at + len(separator), hi)
    edges.append(hi)
    return edges


def _pack(edges: Sequence[int], first: int, last: int, size: int, overlap: int):
    """Ranges of neighbouring pieces ``first..last`` filled greedily up to ``size``.

    The next range starts at the earliest piece that keeps at most ``overlap``
    characters of the previous one and still leaves room for one more piece.
    """
    while True:
        end = bisect_right(edges, edges[first] + size, first + 1, last + 1) - 1
        yield edges[first], edges[end]
        if end == last:
            return
        floor = max(edges[end] - overlap, edges[end + 1] - size)
        first = bisect_left(edges, floor, first + 1, end + 1)


def split_ranges(text: str, separators: Sequence[str], size: int, overlap: int):
    """(start, end) of every chunk of ``text``, in order, stripped, none empty."""

    def narrow(lo, hi):
        stripped = text[lo:hi].lstrip()
        lo = hi - len(stripped)
        return lo, lo + len(stripped.rstrip())

    def walk(lo, hi, level):
        while level < len(separators) and separators[level] and text.find(separators[level], lo, hi) < 0:
            level += 1
        if level < len(separators):
            edges = _edges(text, lo, hi, separators[level])
        else:
            edges = [lo, hi]
        finer = level + 1 < len(separators) and separators[level] != ""
        pieces = len(edges) - 1
        run = 0
        if isinstance(edges, range):
            oversized = range(pieces) if size <= 1 else ()
        else:
            oversized = [i for i in range(pieces) if edges[i + 1] - edges[i] >= size]
        for i in oversized:
            if run < i:
                yield from map(lambda r: narrow(*r), _pack(edges, run, i, size, overlap))
            if finer:
                yield from walk(edges[i], edges[i + 1], level + 1)
            else:
                yield edges[i], edges[i + 1]
            run = i + 1
        if run < pieces:
            yield from map(lambda r: narrow(*r), _pack(edges, run, pieces, size, overlap))

    if overlap > size:
        raise ValueError(f"chunk overlap {overlap} is larger than chunk size {size}")
    return [(lo, hi) for lo, hi in walk(0, len(text), 0) if lo < hi] if text else []


#: Documents that are lists of Python at a time; bounds what a worker holds, not the result.
STEP_ROWS = 128

CHUNKS_TYPE = (
    "array<struct<section_index:int,section_chunk_index:int,section_chunk_count:int,"
    "chunk_count:int,start:int,header_level:int,header_text:string,content:string>>"
)


def chunk_array(
    sections: Column,
    headers: Column,
    kind: Column,
    size: Column,
    overlap: Column,
    separators: Sequence[str] | None = None,
) -> Column:
    """Chunks of a document given as an array of consecutive section texts.

    Sections are split one by one, so no chunk crosses a section, and ``start``
    counts from the start of the document. A few documents of an Arrow batch are
    worked on at a time, so a worker holds no more for a larger table.
    ``headers`` holds (level, text) per section, or is null.
    """
    custom = list(separators) if separators is not None else None

    @F.arrow_udf(CHUNKS_TYPE)
    def chunks(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch[0]), STEP_ROWS):
                asked = [column.slice(at, STEP_ROWS).to_pylist() for column in batch]
                yield chunk_lists(*asked, itertools.repeat(custom))

    return chunks(sections, headers, kind, size, overlap)


def chunk_lists(sections, headers, kinds, sizes, overlaps, separators) -> pa.Array:
    """Chunks of documents, each given as texts of its sections; separators of its kind unless it has its own.

    A null kind, size or overlap gives no chunk.
    """
    ends = [0]
    section, position, in_section, in_document, start, level, header, content = rows = [[] for _ in range(8)]
    for texts, heads, name, limit, shared, custom in zip(sections, headers, kinds, sizes, overlaps, separators):
        offset = 0
        known = limit is not None and shared is not None and (custom or name is not None)
        for number, text in enumerate(texts or [] if known else []):
            text = text or ""
            head = heads[number] if heads else None
            ranges = split_ranges(text, custom or SEPARATORS_BY_KIND[name], limit, shared)
            n = len(ranges)
            section.extend([number] * n)
            position.extend(range(n))
            in_section.extend([n] * n)
            start.extend([offset + lo for lo, _ in ranges])
            level.extend([head and head["level"]] * n)
            header.extend([head and head["text"]] * n)
            content.extend([text[lo:hi] for lo, hi in ranges])
            offset += len(text)
        total = len(content) - ends[-1]
        in_document.extend([total] * total)
        ends.append(len(content))
    types = [pa.int32()] * 6 + [pa.string()] * 2
    fields = ["section_index", "section_chunk_index", "section_chunk_count", "chunk_count", "start",
              "header_level", "header_text", "content"]
    arrays = [pa.array(values, type_) for values, type_ in zip(rows, types)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields))
