"""Batched embedding with a pluggable model, and the dimension check."""

import hashlib
import logging
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.schema import DEFAULT_DIMENSION
from gleanery.session import remembered

# A model turns a list of texts into one vector per text. A loader builds the
# model and runs once per Python worker, on first use.
Model = Callable[[list[str]], "np.ndarray"]
Loader = Callable[[], Model]

#: Tokens whose bucket a worker remembers, and rows whose vectors leave it at a time; both bound what it holds, not the result.
BUCKET_TABLE, STEP_ROWS = 1 << 16, 1 << 10


def hashed_bag_of_words(dimension: int = DEFAULT_DIMENSION) -> Loader:
    """Default model: token counts hashed into buckets, scaled to unit length.

    The bucket of a token is the number in the first 8 hex digits of its MD5,
    modulo the dimension, so vectors are equal on every machine.
    """

    class Buckets(dict):
        """Bucket of every token met so far; a full table computes without storing."""

        def __missing__(self, token: str) -> int:
            found = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimension
            if len(self) < BUCKET_TABLE:
                self[token] = found
            return found

    def load() -> Model:
        bucket_of = Buckets().__getitem__
        blanks = re.compile("[ \t\n\r\f\x0b]+")

        def embed(texts: list[str]) -> np.ndarray:
            counts = np.zeros((len(texts), dimension))
            for row, text in enumerate(texts):
                buckets = list(map(bucket_of, filter(None, blanks.split(text.lower()))))
                if buckets:
                    counts[row] = np.bincount(buckets, minlength=dimension)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return np.divide(counts, norms, out=counts, where=norms > 0)

        return embed

    return load


def embed_column(text: Column, loader: Loader, batch_size: int = 32) -> Column:
    """Vector of a text column; null when the model is not installed."""

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            model = loader()
        except ImportError as missing:
            logging.getLogger(__name__).warning("no embedding model, vectors stay null: %s", missing)
            model = None
        for texts in batches:
            if model is None:
                yield pa.nulls(len(texts), pa.list_(pa.float32()))
                continue
            parts, rows = [], 0
            for at in range(0, len(texts), batch_size):
                part = texts[at : at + batch_size]
                block = np.asarray(model([t or "" for t in part.to_pylist()]), dtype=np.float32)
                offsets = pa.array(np.arange(len(part) + 1) * block.shape[1], pa.int32())
                parts.append(pa.ListArray.from_arrays(offsets, pa.array(block.ravel(), pa.float32())))
                rows += len(part)
                if rows >= STEP_ROWS or at + batch_size >= len(texts):
                    yield pa.concat_arrays(parts)
                    parts, rows = [], 0

    # Marked nondeterministic so that Catalyst never runs the model twice, which
    # it would do for a filter on the vector.
    return vectors.asNondeterministic()(text)


def embed_chunks(
    chunks: DataFrame,
    loader: Loader | None = None,
    batch_size: int = 32,
    text: str = "content",
    vector: str = "vector",
) -> DataFrame:
    """Add the vector of every chunk; only the text column crosses to Python."""
    return chunks.withColumn(vector, _vectors_of(text, loader or hashed_bag_of_words(), batch_size))


@remembered
def _vectors_of(text: str, loader: Loader, batch_size: int) -> Column:
    return embed_column(F.col(text), loader, batch_size)


def embed_query(
    queries: DataFrame, loader: Loader | None = None, text: str = "text", vector: str = "vector"
) -> DataFrame:
    """Vectors for text queries; a query that brings a vector keeps it."""
    if vector not in queries.columns:
        if loader is None:
            raise ValueError("text queries need an embedding function")
        return queries.withColumn(vector, embed_column(F.col(text), loader))
    if loader is None:
        return queries
    # Only the rows without a vector are sent to the model.
    ready = queries.where(F.col(vector).isNotNull())
    missing = queries.where(F.col(vector).isNull())
    return ready.unionByName(missing.withColumn(vector, embed_column(F.col(text), loader)))


def has_dimension(vector: Column, dimension: int) -> Column:
    return F.coalesce(F.size(vector), F.lit(0)) == dimension


def reject_reason(vector: Column, dimension: int) -> Column:
    """Why a vector cannot be stored or compared; null for a sound one."""
    found = F.greatest(F.coalesce(F.size(vector), F.lit(0)), F.lit(0))
    unsound = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(found != dimension, F.format_string("expected %d values, got %d", F.lit(dimension), found)).when(
        F.exists(vector, unsound), F.lit("null or non-finite value")
    )


def is_sound(vector: Column, dimension: int) -> Column:
    return reject_reason(vector, dimension).isNull()


def check_dimension(
    chunks: DataFrame, dimension: int = DEFAULT_DIMENSION, vector: str = "vector"
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): exactly ``dimension`` values, all of them finite."""
    judged = chunks.withColumn("reason", reject_reason(F.col(vector), dimension))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")
