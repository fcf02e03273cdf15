"""Coarse cells over the vectors, and search that probes only the nearest cells."""

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.embedding import is_sound
from gleanery.operators.search import merge_hits, nearest, stored_dimension, with_columns_of
from gleanery.schema import DEFAULT_K, DEFAULT_NLIST, DEFAULT_NPROBE
from gleanery.session import cut_lineage

#: Centres go to every task; more than this is refused.
CENTER_BYTES = 256 * 1024 * 1024


def train_cells(
    corpus: DataFrame,
    nlist: int = DEFAULT_NLIST,
    seed: int = 17,
    max_iter: int = 10,
    vector: str = "vector",
    fraction: float = 1.0,
    dimension: int | None = None,
) -> np.ndarray:
    """Cell centres by distributed k-means over all sound vectors. ``nlist`` is capped by their number.

    Vectors of another length than ``dimension`` (by default that of most), with a null or
    non-finite entry, or null are left out. Without any, there is one centre at the origin.

    A caller may train on a random ``fraction``, at every size alike; it only moves the
    centres, as every row is assigned to a cell afterwards.
    """
    dimension = dimension if dimension is not None else stored_dimension(corpus, vector)
    rows = corpus.where(is_sound(F.col(vector), dimension)).select(array_to_vector(F.col(vector)).alias("features"))
    rows = (rows if fraction >= 1 else rows.sample(fraction=fraction, seed=seed)).cache()
    try:
        count = rows.count()
        if not count:
            return np.zeros((1, dimension), dtype=np.float32)
        model = KMeans(k=max(1, min(nlist, count)), seed=seed, maxIter=max_iter).fit(rows)
    finally:
        rows.unpersist()
    return np.array(model.clusterCenters(), dtype=np.float32)


def _nearest_cells(vector: Column, centers: np.ndarray, n: int) -> Column:
    """The ``n`` nearest cells of a vector, nearest first; of equally near ones the lower number."""
    if centers.nbytes > CENTER_BYTES:
        raise ValueError(f"cell centres take {centers.nbytes} bytes, at most {CENTER_BYTES} are sent to tasks")

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
        rows = flat.reshape(len(vectors), -1)
        distance = (centers * centers).sum(axis=1) - 2 * rows @ centers.T
        if n == 1:
            order = distance.argmin(axis=1)[:, None].astype(np.int32)
        else:
            kth = np.partition(distance, n - 1, axis=1)[:, n - 1 : n]
            order = np.empty((len(rows), n), np.int32)
            for i, line in enumerate(distance):
                near = np.flatnonzero(line <= kth[i])
                order[i] = near[np.argsort(line[near], kind="stable")[:n]]
        offsets = pa.array(np.arange(len(rows) + 1) * order.shape[1], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(order.ravel(), pa.int32()))

    # evaluated once, also when a filter on the cell follows
    return cells.asNondeterministic()(vector)


def ivf_assign(corpus: DataFrame, centers: np.ndarray, vector: str = "vector") -> DataFrame:
    """Add ``_cell``, the nearest cell of every row with a sound vector."""
    return corpus.where(is_sound(F.col(vector), centers.shape[1])).withColumn(
        "_cell", _nearest_cells(F.col(vector), centers, 1)[0]
    )


def write_cells(cells: DataFrame, path: str) -> DataFrame:
    """Store assigned rows in one directory per cell, so that a search reads only what it probes.

    The rebalance hint gathers a cell's rows in few files and splits a cell
    that holds very many of them.
    """
    cells.hint("rebalance", "_cell").write.mode("overwrite").partitionBy("_cell").parquet(path)
    return cells.sparkSession.read.schema(cells.schema).parquet(path)


def ivf_search(
    queries: DataFrame,
    cells: DataFrame,
    centers: np.ndarray,
    k: int = DEFAULT_K,
    nprobe: int = DEFAULT_NPROBE,
    metric: str = "L2",
    output: list[str] | None = None,
    **options,
) -> DataFrame:
    """Probe the ``nprobe`` nearest cells of each query and rank their rows exactly.

    With ``nprobe`` equal to the number of cells the result is the exact one.
    """
    sound = queries.where(is_sound(F.col("vector"), centers.shape[1]))
    probes = sound.withColumn("cells", _nearest_cells(F.col("vector"), centers, min(nprobe, len(centers))))
    return nearest(probes, cells, k, metric, output, dimension=centers.shape[1], **options)


# --- exact search that passes over cells ---------------------------------------

def _distances(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances of all vectors from all centres in double precision."""
    vectors, centers = vectors.astype(np.float64), centers.astype(np.float64)
    squares = (vectors * vectors).sum(axis=1)[:, None] + (centers * centers).sum(axis=1) - 2 * vectors @ centers.T
    return np.sqrt(np.maximum(squares, 0.0))


def cell_sizes(cells: DataFrame, centers: np.ndarray, vector: str = "vector") -> list[tuple[float, int]]:
    """(radius, rows) of every cell: no row of it is farther from its centre than the radius."""

    def spread(batches):
        radius, rows = np.zeros(len(centers)), np.zeros(len(centers), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                cell = part.column("_cell").to_numpy()
                stored = part.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(len(cell), -1).astype(np.float64)
                away = np.sqrt(((stored - centers[cell].astype(np.float64)) ** 2).sum(axis=1))
                np.maximum.at(radius, cell, away)
                rows += np.bincount(cell, minlength=len(centers))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(radius[some]), pa.array(rows[some])], ["_cell", "radius", "n"])

    found = cells.select("_cell", vector).mapInArrow(spread, "_cell int, radius double, n bigint")
    whole = {r["_cell"]: (r["radius"], r["n"]) for r in found.groupBy("_cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()}
    return [whole.get(i, (0.0, 0)) for i in range(len(centers))]  # one row per cell


def _reachable_cells(vector: Column, limit: Column, centers: np.ndarray, radii: np.ndarray, metric: str) -> Column:
    """The cells that can hold a row as good as ``limit``; all of them where it is null."""

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array, limits: pa.Array) -> pa.Array:
        rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)
        if metric == "L2":
            # a row is at least as far as the centre less the radius
            bound = np.maximum(_distances(rows, centers) - radii, 0.0) ** 2
        else:
            # a row's inner product is at most that of the centre and the norm of the query times the radius
            bound = -(rows @ centers.T.astype(np.float64) + np.sqrt((rows * rows).sum(axis=1))[:, None] * radii)
        most = np.array([np.inf if x is None else (x if metric == "L2" else -x) for x in limits.to_pylist()])
        slack = 1e-6 * (1.0 + (rows * rows).sum(axis=1)[:, None] + (centers.astype(np.float64) ** 2).sum(axis=1) + radii**2)
        near = bound <= most[:, None] + slack
        return pa.array([np.flatnonzero(line).astype(np.int32) for line in near], pa.list_(pa.int32()))

    return cells.asNondeterministic()(vector, limit)


def open_cells(queries: DataFrame, first: DataFrame, centers: np.ndarray, radii: np.ndarray, k: int, metric: str = "L2") -> DataFrame:
    """(query_id, vector, cells): the cells a first round over ``queries.cells`` has not settled, from its hits."""
    limits = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("limit"))
    left = queries.join(limits, "query_id", "left")
    left = left.withColumn("reach", _reachable_cells(F.col("vector"), F.col("limit"), centers, radii, metric))
    return left.select("query_id", "vector", F.array_except("reach", "cells").alias("cells")).where(F.size("cells") > 0)


def bounded_search(
    queries: DataFrame,
    cells: DataFrame,
    centers: np.ndarray,
    radii: np.ndarray,
    k: int = DEFAULT_K,
    metric: str = "L2",
    output: list[str] | None = None,
    first_cells: int = 2,
    **options,
) -> DataFrame:
    """The exact k best, from fewer comparisons.

    A first round searches the ``first_cells`` nearest cells; the k-th score it finds is a limit
    that the centre and radius of most cells cannot reach. A second round visits the
    others. For L2 and IP; a cosine is the IP of vectors of unit length.
    """
    metric = metric.upper()
    if metric not in ("L2", "IP"):
        raise ValueError("cells are bounded for L2 and IP; store unit vectors and use IP for COSINE")
    dimension = centers.shape[1]
    sound = queries.where(is_sound(F.col("vector"), dimension)).select("query_id", "vector")
    asked = cut_lineage(sound.withColumn("cells", _nearest_cells(F.col("vector"), centers, min(first_cells, len(centers)))))
    first = cut_lineage(nearest(asked, cells, k, metric, [], dimension=dimension, **options))
    second = nearest(cut_lineage(open_cells(asked, first, centers, radii, k, metric)), cells, k, metric, [], dimension=dimension, **options)
    output = output if output is not None else [c for c in cells.columns if c not in ("vector", "_cell")]
    return with_columns_of(merge_hits([first, second], k, metric), cells, output)
