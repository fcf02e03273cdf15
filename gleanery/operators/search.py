"""Filtered top-k vector search.

Exact scoring compares every query with every stored vector, but the pairs are
never rows: each Arrow batch of ids and vectors meets the query matrix in one
matrix product, and a task sends its final top k of every query. Text and metadata
are read afterwards, for the hits only.
"""

import logging
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.embedding import Loader, embed_query, has_dimension, is_sound, reject_reason
from gleanery.operators.ordering import top_n_per_group
from gleanery.schema import DEFAULT_K, MAX_K, MIN_K
from gleanery.session import cut_lineage

METRICS = ("L2", "IP", "COSINE")
_ID_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
PLANS = ("scan", "blocks")
# The scan plan sends the query set to every task and refuses one above this size.
SCAN_QUERY_BYTES = 16 * 1024 * 1024
BLOCK_ROWS = 50_000
# What one task holds: (query, hit) entries of all its running top k lists,
# and distances of one matrix product.
STATE_ENTRIES = 1_000_000
PRODUCT_CELLS = 4_000_000
TILE_ROWS = 8_192


# --- predicates ------------------------------------------------------------

def filter_content_type(value: str | list[str]) -> Column:
    """Equality or IN on the partition column, so it prunes directories."""
    return F.col("content_type").isin(list(value)) if isinstance(value, (list, tuple, set)) else (
        F.col("content_type") == F.lit(value)
    )


def filter_source(value: str) -> Column:
    return F.col("metadata.source") == F.lit(value)


def filter_doc_id(value: str) -> Column:
    return F.col("doc_id") == F.lit(value)


_FILTERS = {"content_type": filter_content_type, "source": filter_source, "doc_id": filter_doc_id}


def filter_dynamic(key: str, value, column: str = "dynamic") -> Column:
    """Equality or IN on a key of a variant column, by type: numbers match numbers, strings strings, booleans booleans.

    A missing key and a null match nothing; an integer equals the double of the same value.
    """
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    if '"' in key and "'" in key:
        raise ValueError(f"a key may not hold both kinds of quotes: {key}")
    path = f"$['{key}']" if "'" not in key else f'$["{key}"]'
    kind = F.schema_of_variant(F.try_variant_get(column, path, "variant"))
    kinds = {bool: ("boolean", kind == "BOOLEAN"), str: ("string", kind == "STRING")}
    number = ("double", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    found = F.lit(False)
    for v in values:
        if not isinstance(v, (bool, str, int, float)):
            raise TypeError(f"{key}: {type(v).__name__} values cannot be filtered by")
        sql_type, right = kinds.get(type(v), number)
        wanted = F.lit(float(v) if sql_type == "double" else v)
        found = found | F.coalesce(right & (F.try_variant_get(column, path, sql_type) == wanted), F.lit(False))
    return found


def combine_filters(filters: dict | None, dynamic: bool = False) -> Column:
    """AND of all supported filters.

    Another key is looked up in the dynamic field if there is one; else it is warned about and ignored.
    """
    conditions = []
    for key, value in (filters or {}).items():
        if key in _FILTERS:
            conditions.append(_FILTERS[key](value))
        elif dynamic:
            conditions.append(filter_dynamic(key, value))
        else:
            logging.getLogger(__name__).warning("unsupported filter field: %s", key)
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# --- scoring inside a task -------------------------------------------------

def exact_scores(query: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Scores of ``rows`` for one query in double precision."""
    query, rows = query.astype(np.float64), rows.astype(np.float64)
    if metric == "L2":
        return ((rows - query) ** 2).sum(axis=1)
    dots = rows @ query
    if metric == "IP":
        return dots
    norms = np.sqrt((rows**2).sum(axis=1)) * np.sqrt((query**2).sum())
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


@dataclass
class QueryBlock:
    """Query ids and vectors one task works with, and the cells each one probes."""

    ids: list
    vectors: np.ndarray
    cells: list | None = None

    def probing(self, cell: int) -> np.ndarray:
        if self.cells is None:
            return np.arange(len(self.ids))
        if not hasattr(self, "_asking"):
            self._asking: dict[int, list[int]] = {}
            for i, probed in enumerate(self.cells):
                for c in probed:
                    self._asking.setdefault(c, []).append(i)
        return np.array(self._asking.get(cell, []), dtype=int)


class RunningTopK:
    """Best k (distance, id, score, row to keep) per query seen so far by one task; an id counts once."""

    def __init__(self, queries: QueryBlock, k: int, metric: str) -> None:
        self.queries, self.k, self.metric = queries, k, metric
        self.best: list[list[tuple]] = [[] for _ in queries.ids]
        self.limits = np.full(len(queries.ids), np.inf)

    def _rough(self, which: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single-precision distances, smaller is nearer, and a bound on their error."""
        q = self.queries.vectors[which]
        dots = q @ rows.T
        sq_q, sq_r = (q * q).sum(axis=1, keepdims=True), (rows * rows).sum(axis=1)
        slack = 8 * rows.shape[1] * np.finfo(np.float32).eps * (sq_q[:, 0] + sq_r.max(initial=0.0) + 1e-30)
        if self.metric == "L2":
            return sq_q + sq_r - 2 * dots, slack
        if self.metric == "IP":
            return -dots, slack
        norms = np.sqrt(sq_q) * np.sqrt(sq_r)
        cosine = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
        return -cosine, np.full(len(which), 8 * rows.shape[1] * np.finfo(np.float32).eps)

    def offer(self, which: np.ndarray, rows: np.ndarray, ids: list) -> None:
        """Let rows compete for the best k of the queries ``which``."""
        step = max(1, PRODUCT_CELLS // max(1, len(rows)))
        for at in range(0, len(which), step):
            self._offer(which[at : at + step], rows, ids)

    def _offer(self, which: np.ndarray, rows: np.ndarray, ids: list) -> None:
        rough, slack = self._rough(which, rows)
        limits = self.limits[which] + slack
        # most batches bring nothing to most queries: they are passed over without a loop
        for at in np.flatnonzero(~(rough.min(axis=1) > limits)).tolist():
            line, q, margin = rough[at], int(which[at]), slack[at]
            k = min(self.k, len(line))
            nearest = np.partition(line, k - 1)[k - 1] + 2 * margin
            near = np.flatnonzero(~(line > min(limits[at], nearest) if self._unique(ids) else line > limits[at]))
            scores = exact_scores(self.queries.vectors[q], rows[near], self.metric)
            ranked = scores if self.metric == "L2" else -scores
            fresh = [(d, ids[i], s, i) for d, s, i in zip(ranked.tolist(), scores.tolist(), near.tolist())]
            merged, seen = [], set()
            for entry in sorted(self.best[q] + fresh, key=lambda e: e[:2]):
                if entry[1] not in seen:
                    seen.add(entry[1])
                    # a row of this batch is kept as its vector, for callers that want it
                    merged.append(entry if isinstance(entry[3], np.ndarray) else (*entry[:3], rows[entry[3]].copy()))
                    if len(merged) == self.k:
                        break
            self.best[q] = merged
            if len(merged) == self.k:
                self.limits[q] = merged[-1][0]

    def _unique(self, ids: list) -> bool:
        """Whether a batch has no id twice; only then do its k nearest rows stand for k ids."""
        if getattr(self, "_last", None) is not ids:
            self._last, self._distinct = ids, len(set(ids)) == len(ids)
        return self._distinct

    def found(self, query_type: pa.DataType, id_type: pa.DataType, id_name: str, vector: str | None):
        """The best k of every query as Arrow batches of bounded size."""
        for at in range(0, len(self.best), 1_000):
            part = [(self.queries.ids[at + i], *e) for i, best in enumerate(self.best[at : at + 1_000]) for e in best]
            columns = [
                pa.array([e[0] for e in part], query_type), pa.array([e[2] for e in part], id_type),
                pa.array([e[3] for e in part], pa.float64()),
            ]
            names = ["query_id", id_name, "score"]
            if vector is not None:
                flat = np.concatenate([e[4] for e in part]) if part else np.zeros(0, np.float32)
                size = len(flat) // len(part) if part else 0
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * size, pa.int32()), pa.array(flat, pa.float32())))
                names.append(vector)
            if part:
                yield pa.RecordBatch.from_arrays(columns, names)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; a null entry becomes NaN."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(vectors), -1)


def _compete(batch: pa.RecordBatch, state: RunningTopK, vector: str, chunk_id: str) -> None:
    """Offer the rows of a batch whose vectors are finite to the queries that probe their cells."""
    rows, ids = _matrix(batch.column(vector)), batch.column(chunk_id).to_pylist()
    cells = np.asarray(batch.column("_cell").to_numpy(zero_copy_only=False))
    sound = np.isfinite(rows).all(axis=1)
    for cell in np.unique(cells[sound]):
        which = state.queries.probing(int(cell))
        members = np.flatnonzero(sound & (cells == cell))
        if len(which):
            state.offer(which, rows[members], [ids[i] for i in members])


# --- the two ways to bring queries and vectors together ---------------------

def _id_type(df: DataFrame, column: str) -> pa.DataType:
    name = df.schema[column].dataType.simpleString()
    if name not in _ID_TYPES:
        raise TypeError(f"{column} must be one of {', '.join(_ID_TYPES)}, not {name}")
    return _ID_TYPES[name]


def _scan_topk(block: QueryBlock, corpus: DataFrame, out: T.StructType, k: int, metric: str, names: tuple, types: tuple) -> DataFrame:
    """Every task scans its part of the collection against all queries. No shuffle."""
    vector, chunk_id, kept = names

    def run(batches):
        state = RunningTopK(block, k, metric)
        for batch in batches:
            if batch.num_rows:
                _compete(batch, state, vector, chunk_id)
        yield from state.found(*types, chunk_id, kept)

    return corpus.mapInArrow(run, out)


def _in_blocks(
    queries: DataFrame, corpus: DataFrame, out: T.StructType | str, query_rows: int, chunk_id: str, celled: bool, work
) -> DataFrame:
    """Both sides cut into blocks of bounded size, every block pair one group.

    ``work(stored rows, query rows)`` gets two Arrow tables and gives one. A cell
    with many vectors or many queries gets more blocks, so the size of a group
    does not depend on how rows are distributed over cells. Blocks follow from
    ids, so copies of a vector spread and a repeated task cuts alike.
    """
    probes = cut_lineage(queries.select("query_id", F.explode("cells").alias("_cell"), F.col("vector").alias("_query")))

    def blocks(df: DataFrame, name: str, rows: int) -> DataFrame:
        return df.groupBy("_cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    if celled:
        # one row per cell: bounded by nlist
        sizes = F.broadcast(
            blocks(corpus, "_stored_blocks", BLOCK_ROWS).join(blocks(probes, "_probe_blocks", query_rows), "_cell")
        )
        sized = lambda df: df.join(sizes, "_cell")
    else:
        counts = {"_stored_blocks": -(-corpus.count() // BLOCK_ROWS), "_probe_blocks": -(-probes.count() // query_rows)}
        sized = lambda df: df.withColumns({name: F.lit(max(1, n)) for name, n in counts.items()})

    def pairs(df: DataFrame, row_id: str, own: str, other: str, own_key: str, other_key: str) -> DataFrame:
        return (
            sized(df)
            .withColumn(own_key, F.pmod(F.xxhash64(row_id), F.col(own)).cast("int"))
            .withColumn(other_key, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop(own, other)
        )

    keys = ["_cell", "_stored_block", "_probe_block"]
    left = pairs(corpus, chunk_id, "_stored_blocks", "_probe_blocks", "_stored_block", "_probe_block")
    right = pairs(probes, "query_id", "_probe_blocks", "_stored_blocks", "_probe_block", "_stored_block")

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        return work(rows.drop_columns(["_stored_block", "_probe_block"]), wanted)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, out)


def _block_topk(
    queries: DataFrame, corpus: DataFrame, out: T.StructType, k: int, metric: str, names: tuple, types: tuple, celled: bool
) -> DataFrame:
    vector, chunk_id, kept = names

    def work(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and wanted.num_rows:
            state = RunningTopK(QueryBlock(wanted.column("query_id").to_pylist(), _matrix(wanted.column("_query").combine_chunks())), k, metric)
            for batch in rows.combine_chunks().to_batches(max_chunksize=10_000):
                _compete(batch, state, vector, chunk_id)
            found = list(state.found(*types, chunk_id, kept))
        if found:
            return pa.Table.from_batches(found)
        columns = [pa.array([], types[0]), pa.array([], types[1]), pa.array([], pa.float64())]
        columns += [pa.array([], pa.list_(pa.float32()))] if kept is not None else []
        return pa.Table.from_arrays(columns, out.fieldNames())

    return _in_blocks(queries, corpus, out, min(BLOCK_ROWS, STATE_ENTRIES // k), chunk_id, celled, work)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "L2",
    output: list[str] | None = None,
    vector: str = "vector",
    chunk_id: str = "chunk_id",
    plan: str = "scan",
    dimension: int | None = None,
) -> DataFrame:
    """k best rows of ``corpus`` for every row of ``queries(query_id, vector)``.

    Only ids and vectors are scored; the other columns of ``output`` are joined to
    the at most queries x k rows that are left. Rows that share a chunk id count as
    one. When both sides carry cells (``corpus._cell``, ``queries.cells``) a query
    only meets the cells it probes. Ranks are by score, ties by chunk id.

    ``plan="scan"`` sends the queries to every task and refuses a set too large for
    that; ``plan="blocks"`` shuffles both sides in blocks and takes any number. Both
    give the same rows. Vectors of another length than ``dimension`` (by default that
    of most stored vectors, found in a scan of its own), with a null or non-finite entry, or null are not compared, on
    either side: ``vector_rejects`` counts them.
    """
    if not MIN_K <= k <= MAX_K:
        raise ValueError(f"k must be between {MIN_K} and {MAX_K}")
    metric = metric.upper()
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if plan not in PLANS:
        raise ValueError(f"plan is one of {', '.join(PLANS)}")
    with_cells = "cells" in queries.columns
    output = output if output is not None else [c for c in corpus.columns if c not in (vector, "_cell")]
    asked = queries.select("query_id", F.col("vector"), (F.col("cells") if with_cells else F.array(F.lit(0))).alias("cells"))
    dimension = dimension if dimension is not None else stored_dimension(corpus, vector)
    asked = asked.where(is_sound(F.col("vector"), dimension))
    rows = corpus.where(has_dimension(F.col(vector), dimension)).select(
        chunk_id, vector, (F.col("_cell") if with_cells else F.lit(0)).cast("int").alias("_cell")
    )
    kept = vector if vector in output else None
    types = (_id_type(asked, "query_id"), _id_type(rows, chunk_id))
    out = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField(chunk_id, rows.schema[chunk_id].dataType),
        T.StructField("score", T.DoubleType()), *([T.StructField(vector, T.ArrayType(T.FloatType()))] if kept else []),
    ])
    if plan == "blocks":
        scored = _block_topk(asked, cut_lineage(rows), out, k, metric, (vector, chunk_id, kept), types, with_cells)
    else:
        block = _query_block(asked, dimension, STATE_ENTRIES // k)
        if with_cells:
            rows = rows.where(F.col("_cell").isin(sorted({c for cells in block.cells for c in cells})))
        scored = _scan_topk(block, rows, out, k, metric, (vector, chunk_id, kept), types)
    order = F.min if metric == "L2" else F.max
    once = scored.groupBy("query_id", chunk_id).agg(order("score").alias("score"), *([F.first(vector).alias(vector)] if kept else []))
    return with_columns_of(topk_per_query(once, k, metric, chunk_id), corpus, output, chunk_id)


def with_columns_of(best: DataFrame, corpus: DataFrame, output: list[str], chunk_id: str = "chunk_id") -> DataFrame:
    """Hits with the columns of ``output``; those they do not bring are read from the corpus."""
    more = [c for c in dict.fromkeys(output) if c not in best.columns]
    if more:
        # a table of known size, so that Spark can choose the join; vectors are not read again
        best = cut_lineage(best)
        wanted = best.select(chunk_id).distinct()
        best = best.join(corpus.select(chunk_id, *more).join(wanted, chunk_id, "left_semi").dropDuplicates([chunk_id]), chunk_id)
    return best.select("query_id", "rank", *dict.fromkeys([chunk_id, *output]), "score")


def merge_hits(parts: list[DataFrame], k: int, metric: str = "L2", chunk_id: str = "chunk_id") -> DataFrame:
    """The best k of several searches for the same queries; a chunk found twice counts once."""
    hits = reduce(DataFrame.unionByName, (p.select("query_id", chunk_id, "score") for p in parts))
    order = F.min if metric.upper() == "L2" else F.max
    return topk_per_query(hits.groupBy("query_id", chunk_id).agg(order("score").alias("score")), k, metric, chunk_id)


def stored_dimension(corpus: DataFrame, vector: str = "vector") -> int:
    """The length most stored vectors have, the larger of equally frequent ones; 0 without vectors."""
    sizes = corpus.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def vector_rejects(queries: DataFrame, corpus: DataFrame, dimension: int | None = None, vector: str = "vector") -> DataFrame:
    """(side, reason, n): the vectors that a search does not compare, by reason."""
    dimension = dimension if dimension is not None else stored_dimension(corpus, vector)
    sides = (("query", queries.select(F.col("vector").alias("v"))), ("stored", corpus.select(F.col(vector).alias("v"))))
    counted = [
        df.select(F.lit(side).alias("side"), reject_reason(F.col("v"), dimension).alias("reason")).where("reason IS NOT NULL") for side, df in sides
    ]
    return counted[0].unionByName(counted[1]).groupBy("side", "reason").agg(F.count("*").alias("n"))


def _query_block(queries: DataFrame, dimension: int, most: int) -> QueryBlock:
    """The query set as one block; an error when it is too large for one task."""
    total, ids, probes = queries.agg(
        F.count("*"), F.sum(F.length(F.col("query_id").cast("string"))), F.max(F.size("cells"))
    ).first()
    if total > most or total * (4 * (dimension + (probes or 0)) + 64) + 4 * (ids or 0) > SCAN_QUERY_BYTES:
        raise ValueError(f"{total} queries are too many for the scan plan; use plan='blocks'")
    rows = queries.collect()
    vectors = np.array([r["vector"] for r in rows], dtype=np.float32).reshape(len(rows), dimension)
    return QueryBlock([r["query_id"] for r in rows], vectors, [set(r["cells"]) for r in rows])


def topk_per_query(scored: DataFrame, k: int, metric: str = "L2", chunk_id: str = "chunk_id") -> DataFrame:
    order = F.asc("score") if metric.upper() == "L2" else F.desc("score")
    return top_n_per_group(scored, ["query_id"], [order, F.asc(chunk_id)], k)


def candidate_summary(
    queries: DataFrame,
    corpus: DataFrame,
    metric: str = "L2",
    vector: str = "vector",
    chunk_id: str = "chunk_id",
    plan: str = "scan",
    dimension: int | None = None,
) -> DataFrame:
    """Per query: candidate pairs, lowest and highest score, without producing the pairs.

    Plans and unsound vectors as in ``nearest``. A task holds three numbers per query
    and the scores of one query with a tile of rows.
    """
    if plan not in PLANS:
        raise ValueError(f"plan is one of {', '.join(PLANS)}")
    asked = queries.select("query_id", "vector", F.array(F.lit(0)).alias("cells"))
    dimension = dimension if dimension is not None else stored_dimension(corpus, vector)
    asked = asked.where(is_sound(F.col("vector"), dimension))
    id_type, id_name = _id_type(asked, "query_id"), asked.schema["query_id"].dataType.simpleString()
    rows = corpus.where(has_dimension(F.col(vector), dimension)).select(chunk_id, vector, F.lit(0).alias("_cell"))
    out = f"query_id {id_name}, pairs bigint, low double, high double"

    class Summary:
        def __init__(self, ids: list, vectors: np.ndarray) -> None:
            self.ids, self.vectors, self.pairs = ids, vectors, 0
            self.low, self.high = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)

        def add(self, stored: np.ndarray) -> None:
            stored = stored[np.isfinite(stored).all(axis=1)]
            self.pairs += len(stored)
            for at in range(0, len(stored), TILE_ROWS):
                tile = stored[at : at + TILE_ROWS]
                for i, q in enumerate(self.vectors):
                    scores = exact_scores(q, tile, metric)
                    self.low[i], self.high[i] = min(self.low[i], scores.min()), max(self.high[i], scores.max())

        def batch(self) -> pa.RecordBatch:
            n = len(self.ids) if self.pairs else 0
            columns = [
                pa.array(self.ids[:n], id_type), pa.array([self.pairs] * n, pa.int64()), pa.array(self.low[:n]), pa.array(self.high[:n]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "pairs", "low", "high"])

    def work(stored: pa.Table, wanted: pa.Table) -> pa.Table:
        vectors = _matrix(wanted.column("_query").combine_chunks()) if wanted.num_rows else np.empty((0, 1))
        summary = Summary(wanted.column("query_id").to_pylist(), vectors)
        if stored.num_rows and wanted.num_rows:
            summary.add(_matrix(stored.column(vector).combine_chunks()))
        return pa.Table.from_batches([summary.batch()])

    if plan == "blocks":
        parts = _in_blocks(asked, cut_lineage(rows), out, BLOCK_ROWS, chunk_id, False, work)
    else:
        block = _query_block(asked, dimension, STATE_ENTRIES)

        def scan(batches):
            summary = Summary(block.ids, block.vectors)
            for batch in batches:
                if batch.num_rows:
                    summary.add(_matrix(batch.column(vector)))
            yield summary.batch()

        parts = rows.select(vector).mapInArrow(scan, out)
    return parts.groupBy("query_id").agg(F.sum("pairs").alias("pairs"), F.min("low").alias("low"), F.max("high").alias("high"))


# --- request level ----------------------------------------------------------

def vector_search(
    queries: DataFrame,
    collection: DataFrame,
    k: int = DEFAULT_K,
    filters: dict | None = None,
    metric: str = "L2",
    include_metadata: bool = True,
    include_vectors: bool = False,
    plan: str = "scan",
    dimension: int | None = None,
) -> DataFrame:
    """Exact filtered search; filters apply before ranking. Plans as in ``nearest``."""
    output = response_columns(include_metadata, include_vectors)
    hits = nearest(queries, collection.where(combine_filters(filters)), k, metric, output, plan=plan, dimension=dimension)
    return project_hits(hits, include_metadata, include_vectors)


def response_columns(include_metadata: bool, include_vectors: bool) -> list[str]:
    return ["doc_id", "content"] + (["metadata"] if include_metadata else []) + (["vector"] if include_vectors else [])


def text_search(queries: DataFrame, collection: DataFrame, loader: Loader, **options) -> DataFrame:
    """Embed text queries (query_id, text), then search. The model sees each query once."""
    return vector_search(cut_lineage(embed_query(queries, loader)), collection, **options)


def project_hits(hits: DataFrame, include_metadata: bool = True, include_vectors: bool = False) -> DataFrame:
    """Result columns of a search response."""
    return hits.select(
        "query_id", "rank", F.col("chunk_id").alias("id"), F.col("doc_id").alias("document_id"), "content", "score",
        *(["metadata"] if include_metadata else []),
        *(["vector"] if include_vectors else []),
    )


def search_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.count("*").alias("total"))
