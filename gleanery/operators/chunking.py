"""Chunking: documents in, one row per chunk out. No operator here shuffles,
except ``renumber_chunks``, which repairs numbering over an existing table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import chunk_id
from gleanery.operators.ordering import running_total
from gleanery.operators.splitter import chunk_array
from gleanery.schema import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE
from gleanery.session import remembered

# A Markdown section: a header line (or nothing, for the preamble) followed by
# whole fenced blocks and ordinary lines. Possessive loops keep it linear.
_FENCE = r"^(?<f>`{3,}|~{3,})[^\n]*\n(?:(?!\k<f>[ \t]*(?:\n|\z))[^\n]*\n)*+\k<f>[ \t]*(?:\n|\z)"
_ATX = r"^#{1,6}(?:[ \t][^\n]*)?(?:\n|\z)"
_SETEXT = r"^(?![ \t]*(?:\n|[-*+>|]))[^\n]+\n(?:=+|-{2,})[ \t]*(?:\n|\z)"
_LINE = r"(?:[^\n]*\n|[^\n]+\z)"
_PLAIN = rf"(?!{_ATX}|{_SETEXT}){_LINE}"
# A section that opens with a fence needs a group name of its own there.
_OPENING_FENCE = _FENCE.replace("<f>", "<g>")
SECTION_PATTERN = rf"(?m)(?:{_ATX}|{_SETEXT}|{_OPENING_FENCE}|{_LINE})(?:{_FENCE}|{_PLAIN})*+"


def markdown_sections(text: Column) -> Column:
    """Array of consecutive section texts whose concatenation is the document."""
    return F.regexp_extract_all(text, F.lit(SECTION_PATTERN), F.lit(0))


def header_level(section: Column) -> Column:
    marks = F.length(F.regexp_extract(section, r"^(#{1,6})(?:[ \t]|\n|\z)", 1))
    underline = F.regexp_extract(section, rf"\A(?={_SETEXT})[^\n]+\n(=|-)", 1)
    return (
        F.when(marks > 0, marks)
        .when(underline == "=", 1)
        .when(underline == "-", 2)
        .cast("int")
    )


def header_text(section: Column) -> Column:
    line = F.regexp_extract(section, r"\A[^\n]*", 0)
    bare = F.regexp_replace(F.regexp_replace(line, r"^#{1,6}[ \t]*", ""), r"(?:^|[ \t]+)#+[ \t]*$", "")
    return F.when(header_level(section).isNotNull(), F.trim(bare))


def split_sections(docs: DataFrame, text: str = "content") -> DataFrame:
    """One row per Markdown section with its level and header text."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(
        *keep, F.posexplode_outer(markdown_sections(F.col(text))).alias("section_index", "section_text")
    ).where("section_text is not null").select(
        *keep,
        "section_index",
        header_level(F.col("section_text")).alias("header_level"),
        header_text(F.col("section_text")).alias("header_text"),
        "section_text",
    )


@remembered
def route_chunker_of(content_type: str, strategy: str) -> Column:
    """The same for a column by its name."""
    return route_chunker(F.col(content_type), strategy)


def route_chunker(content_type: Column, strategy: Column | str = "semantic") -> Column:
    """Which separators a document is split with."""
    strategy = F.lit(strategy) if isinstance(strategy, str) else strategy
    return (
        F.when(content_type == "python", "python")
        .when(content_type == "csharp", "code")
        .when((content_type == "markdown") & (strategy == "semantic"), "sections")
        .when(content_type == "markdown", "markdown")
        .otherwise("text")
    )


def _as_column(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("int")


def chunk_documents(
    docs: DataFrame,
    kind: str | Column = "text",
    size: int | Column = DEFAULT_CHUNK_SIZE,
    overlap: int | Column = DEFAULT_CHUNK_OVERLAP,
    separators: Sequence[str] | None = None,
    doc_id: str = "doc_id",
    text: str = "content",
) -> DataFrame:
    """Recursive chunks of every document, numbered over the whole document.

    ``kind`` is one of text, markdown, sections, python, code, or a column of
    those (see ``route_chunker``); ``size`` and ``overlap`` may be columns too.
    Every other column of the document is copied to its chunks.
    """
    if isinstance(size, int) and isinstance(overlap, int) and overlap > size:
        raise ValueError(f"chunk overlap {overlap} is larger than chunk size {size}")
    sectioned = not isinstance(kind, str) or kind == "sections"
    keep = [c for c in docs.columns if c != text]
    sections, chunks = _chunk_columns(text, kind, size, overlap, None if separators is None else tuple(separators))
    # The outer explode keeps Catalyst from pushing a "not empty" filter below
    # the generator, which would run the Python function a second time.
    rows = (
        docs.withColumn("_sections", sections)
        .withColumn("_chunks", chunks)
        .select(*keep, F.posexplode_outer("_chunks").alias("chunk_index", "_c"))
        .where("_c is not null")
    )
    fields = ["section_index", "section_chunk_index", "section_chunk_count", "header_level", "header_text"]
    return rows.select(
        *keep,
        chunk_id(F.col(doc_id), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index",
        "_c.chunk_count",
        "_c.start",
        *([f"_c.{name}" for name in fields] if sectioned else []),
        "_c.content",
    )


@remembered
def _chunk_columns(text: str, kind: str | Column, size: int | Column, overlap: int | Column, separators: tuple[str, ...] | None) -> tuple[Column, Column]:
    """The sections of a document, and its chunks from them."""
    sectioned = not isinstance(kind, str) or kind == "sections"
    kind = F.lit(kind) if isinstance(kind, str) else kind
    whole = F.array(F.col(text))
    sections = F.when(kind == "sections", markdown_sections(F.col(text))).otherwise(whole) if sectioned else whole
    headers = F.transform("_sections", _header) if sectioned else F.lit(None).cast(f"array<{_HEADER}>")
    return sections, chunk_array(F.col("_sections"), headers, kind, _as_column(size), _as_column(overlap), separators)


_HEADER = "struct<level:int,text:string>"


def _header(section: Column) -> Column:
    return F.struct(header_level(section).alias("level"), header_text(section).alias("text"))


def number_chunks(docs: DataFrame, pieces: str = "pieces", doc_id: str = "doc_id") -> DataFrame:
    """Explode an array of texts into numbered chunk rows with ids."""
    keep = [c for c in docs.columns if c != pieces]
    # Count first: a size taken after the explode would copy the array to every row.
    counted = docs.withColumn("chunk_count", F.size(pieces))
    return counted.select(
        *keep, "chunk_count", F.posexplode_outer(pieces).alias("chunk_index", "content")
    ).where("chunk_index is not null").select(
        *keep,
        chunk_id(F.col(doc_id), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index", "chunk_count", "content",
    )


def _digits(value: int | Column) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def chunk_fixed(
    docs: DataFrame,
    size: int | Column = DEFAULT_CHUNK_SIZE,
    overlap: int | Column = DEFAULT_CHUNK_OVERLAP,
    doc_id: str = "doc_id",
    text: str = "content",
) -> DataFrame:
    """Character windows of ``size`` every ``size - overlap`` characters; both may be columns.

    One linear regular expression: a look-ahead captures the window while the
    match itself advances by the step. A tail lying wholly inside the previous
    window's overlap is not repeated; empty documents give no rows.
    """
    if isinstance(size, int) and isinstance(overlap, int) and not 0 <= overlap < size:
        raise ValueError("fixed windows need 0 <= overlap < size")
    pattern = F.concat(
        F.lit(r"(?s)(?:\A|(?=.{"), _digits(overlap + 1), F.lit(r"}))(?=(.{1,"), _digits(size), F.lit(r"})).{1,"), _digits(size - overlap), F.lit("}"),
    )
    windows = F.regexp_extract_all(F.col(text), pattern, F.lit(1))
    keep = [c for c in docs.columns if c != text]
    return number_chunks(docs.select(*keep, windows.alias("pieces")), doc_id=doc_id)


def chunk_by_tokens(
    docs: DataFrame,
    max_tokens: int | Column,
    overlap: int | Column = 0,
    doc_id: str = "doc_id",
    text: str = "content",
) -> DataFrame:
    """Windows of at most ``max_tokens`` whitespace-separated tokens; both numbers may be columns.

    The same look-ahead form as ``chunk_fixed``, over single-spaced text.
    """
    if isinstance(max_tokens, int) and isinstance(overlap, int) and not 0 <= overlap < max_tokens:
        raise ValueError("token windows need 0 <= overlap < max_tokens")
    keep = [c for c in docs.columns if c != text]
    single_spaced = F.trim(F.regexp_replace(text, r"\s+", " "))
    pattern = F.concat(
        F.lit(r"(?:\A|(?=(?:\S++ ){"), _digits(overlap), F.lit(r"}+\S))(?=(\S++(?: \S++){0,"), _digits(max_tokens - 1),
        F.lit(r"}+))(?:\S++ ?){1,"), _digits(max_tokens - overlap), F.lit("}+"),
    )
    windows = F.regexp_extract_all(single_spaced, pattern, F.lit(1))
    return number_chunks(docs.select(*keep, windows.alias("pieces")), doc_id=doc_id)


def chunk_as_asked(docs: DataFrame, doc_id: str = "doc_id", text: str = "content") -> DataFrame:
    """Chunks of documents that bring their own way: chunk_size, chunk_overlap, max_tokens, strategy.

    With max_tokens, windows of so many tokens; with the strategy "fixed", windows of
    characters; else the recursive chunks that fit the content type, Markdown by sections for
    "semantic". The columns of the request stay on the chunks.
    """
    fixed = F.col("max_tokens").isNull() & (F.col("strategy") == "fixed")
    size, overlap = F.col("chunk_size").cast("int"), F.col("chunk_overlap").cast("int")
    kind = route_chunker(F.col("content_type"), F.col("strategy"))
    parts = [
        chunk_documents(docs.where(F.col("max_tokens").isNull() & ~fixed), kind, size, overlap, doc_id=doc_id, text=text),
        # an overlap as large as the window would never advance
        chunk_fixed(docs.where(fixed), size, F.least(overlap, size - 1), doc_id, text),
        chunk_by_tokens(docs.where(F.col("max_tokens").isNotNull()), F.col("max_tokens").cast("int"), 0, doc_id, text),
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def renumber_chunks(chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Document-wide index, count and id for chunks numbered per section.

    Needs ``section_index``, ``section_chunk_index`` and ``section_chunk_count``.
    Only per-section counts are summed up and joined back, so the chunk texts of
    a document, however many, are never gathered in one task.
    """
    sections = chunks.groupBy(doc_id, "section_index").agg(F.max("section_chunk_count").alias("_n"))
    offsets = running_total(sections, [doc_id], "section_index", "_n", "_before", "chunk_count")
    kept = [c for c in chunks.columns if c not in ("chunk_id", "chunk_index", "chunk_count")]
    return chunks.select(*kept).join(offsets.drop("_n"), [doc_id, "section_index"]).withColumn(
        "chunk_index", (F.col("_before") + F.col("section_chunk_index")).cast("int")
    ).select(
        *kept,
        chunk_id(F.col(doc_id), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index",
        F.col("chunk_count").cast("int").alias("chunk_count"),
    )
