"""What the operators on vectors share: which rows take part, matrices, exact top lists."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.embedding import is_sound

#: Rows that one vectorised step works on.
BATCH_ROWS = 8_192


def common_dimension(df: DataFrame, vector: str) -> int:
    """The length that most vectors have, the larger of equally frequent ones; 0 without vectors."""
    sizes = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def sound_rows(df: DataFrame, id_col: str, vector: str, dimension: int, *more: Column) -> DataFrame:
    """(id, vector, more): rows with an id and ``dimension`` finite components, under fixed names."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("vector"), *more)
    return rows.where(F.col("id").isNotNull() & is_sound(F.col("vector"), dimension))


def matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Vectors as rows, in the precision they come in."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dimension)


def vector_array(rows: np.ndarray) -> pa.ListArray:
    flat = np.ascontiguousarray(rows).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(flat))


def pair_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision; a pair's score does not depend on what else is scored."""
    return (rows.astype(np.float64) * query.astype(np.float64)).sum(axis=1)


def top_rows(query: np.ndarray, rough: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, unique: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the first ``k`` ids by score, then id. ``rough`` are scores of any precision of matrix products.

    Without ``unique`` an id may have several rows; its best one counts.
    """
    near = np.arange(len(rough))
    if unique and len(rough) > k:
        slack = 1e-12 * (1.0 + np.abs(rough).max()) * len(query)
        near = np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack)
    scores, names = pair_scores(query, rows[near]), ids[near]
    order = np.lexsort((names, -scores))
    if not unique:
        order = order[np.sort(np.unique(names[order], return_index=True)[1])]
    return names[order[:k]], scores[order[:k]]
