"""The chunkers as functions of Spark SQL, for a session.

``chunk_recursive`` is an Arrow function over batches of documents; the others are SQL
functions that Catalyst inlines, so they stay on the JVM. All give arrays, to be
exploded where the documents lie, without a shuffle:

    SELECT doc_id, chunk_index, c.content
    FROM (SELECT doc_id, chunk_recursive(text, 'text', 1000, 200, NULL) AS cs FROM documents)
    LATERAL VIEW OUTER posexplode(cs) t AS chunk_index, c WHERE c IS NOT NULL
"""

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanery.operators.chunking import SECTION_PATTERN
from gleanery.operators.splitter import CHUNKS_TYPE, chunk_lists


def _recursive():
    @F.arrow_udf(CHUNKS_TYPE)
    def chunk_recursive(content: pa.Array, kind: pa.Array, size: pa.Array, overlap: pa.Array, separators: pa.Array) -> pa.Array:
        texts = [[text] for text in content.to_pylist()]
        return chunk_lists(texts, [None] * len(texts), *(column.to_pylist() for column in (kind, size, overlap, separators)))

    return chunk_recursive


_WINDOWS = r"""
CREATE OR REPLACE TEMPORARY FUNCTION chunk_windows(content STRING, size INT, overlap INT) RETURNS ARRAY<STRING>
RETURN IF(overlap >= 0 AND overlap < size, regexp_extract_all(
  content, concat(r'(?s)(?:\A|(?=.{', overlap + 1, r'}))(?=(.{1,', size, r'})).{1,', size - overlap, '}'), 1), NULL)"""
_TOKENS = r"""
CREATE OR REPLACE TEMPORARY FUNCTION chunk_tokens(content STRING, max_tokens INT, overlap INT) RETURNS ARRAY<STRING>
RETURN IF(overlap >= 0 AND overlap < max_tokens, regexp_extract_all(
  trim(regexp_replace(content, r'\s+', ' ')),
  concat(r'(?:\A|(?=(?:\S++ ){', overlap, r'}+\S))(?=(\S++(?: \S++){0,', max_tokens - 1, r'}+))(?:\S++ ?){1,', max_tokens - overlap, '}+'), 1), NULL)"""
_SECTIONS = rf"""
CREATE OR REPLACE TEMPORARY FUNCTION markdown_sections(content STRING) RETURNS ARRAY<STRING>
RETURN regexp_extract_all(content, r'{SECTION_PATTERN}', 0)"""


def register_chunkers(spark: SparkSession) -> None:
    """Make the chunkers known to ``spark.sql``.

    * ``chunk_recursive(content, kind, size, overlap, separators)``: the recursive chunks of
      ``chunk_documents`` for the kinds text, markdown, python and code, or for an array of
      separators; a struct per chunk.
    * ``chunk_windows(content, size, overlap)`` and ``chunk_tokens(content, max_tokens, overlap)``:
      the windows of ``chunk_fixed`` and ``chunk_by_tokens``; texts.
    * ``markdown_sections(content)``: the sections of a Markdown text; texts.

    Sizes may be columns. Null arguments, and windows with an overlap that is no less than their
    size, give no chunk.
    """
    spark.udf.register("chunk_recursive", _recursive())
    for statement in (_WINDOWS, _TOKENS, _SECTIONS):
        spark.sql(statement)
