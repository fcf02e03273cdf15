"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample (``sample_rows``, taken by a hash of the id): a node
is cut into BRANCHES clusters until its share of the sample is small. Every row of the
table goes down to one leaf. A query walks the tree with a priority queue: the open node
with the largest estimate of the inner products below it comes next, an inner node adds
its children, a leaf is a visit. How many leaves a search visits is calibrated: the
neighbours of a bounded set of queries are found exactly in one scan, and the number of
visits is widened until the wanted share of them lies in visited leaves.

Neighbouring leaves form bins of bounded size. A query is sent once to every bin in which
it visits leaves, with the list of these leaves; a bin is one group of a task, where rows
and queries meet in matrix products and each query keeps its first k. A leaf with very
many rows, as copies of one vector make it, is cut into several bins by hash. Scores of
what is kept are computed again in double precision, each pair by itself, so equal vectors
have equal scores wherever they lie.
"""

import heapq
import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import trimmed
from gleanery.llm.vectors import BATCH_ROWS, common_dimension, matrix, sound_rows, top_rows, vector_array
from gleanery.operators.ordering import top_n_per_group
from gleanery.session import cut_lineage

BRANCHES = 8
#: Rows that the tree is fitted on, and bytes that they may take.
SAMPLE_ROWS, SAMPLE_BYTES = 1 << 16, 1 << 26
#: Leaves of a tree, and bytes that its centres may take: a tree goes to every task.
LEAVES, TREE_BYTES = 4_096, 1 << 24
#: Rows of the table per leaf that a tree aims at.
LEAF_ROWS = 128
#: Queries whose neighbours are found exactly.
CALIBRATION = 256
#: Bytes of vectors in a bin, and bins at the least, for tasks to share.
BIN_BYTES, BINS = 1 << 24, 8
#: Queries that meet a bin in one group; a bin that more visit is met in several.
BIN_QUERIES = 1 << 15
#: Scores that a task holds at once.
SCORES = 1 << 21
#: How far the estimate of a node reaches beyond its mean, in spreads of its rows.
REACH = 3.0


@dataclass
class Tree:
    """Nodes in the order of their making; leaves are numbered depth first, so that near leaves have near numbers."""

    centres: np.ndarray
    spreads: np.ndarray
    children: list[tuple[int, int]]
    leaf: np.ndarray

    @property
    def parts(self) -> tuple:
        """What a task makes the tree from again: broadcasts hold plain values, as tasks may lack this module."""
        return self.centres, self.spreads, self.children, self.leaf

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def leaves_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row: the nearest child at each node on the way down."""
        out, work = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while work:
            node, some = work.pop()
            first, end = self.children[node]
            if first == end:
                out[some] = self.leaf[node]
                continue
            centres = self.centres[first:end]
            nearest = ((centres * centres).sum(axis=1) - 2 * (rows[some] @ centres.T)).argmin(axis=1)
            work.extend((first + j, some[nearest == j]) for j in np.unique(nearest).tolist())
        return out

    def visits(self, query: np.ndarray):
        """Leaves in the order in which best-bin-first search visits them."""
        norm = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        reach = np.float32(REACH * norm / max(1.0, np.sqrt(len(query))))
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            first, end = self.children[node]
            if first == end:
                yield int(self.leaf[node])
                continue
            hopes = self.centres[first:end] @ query + reach * self.spreads[first:end]
            for j, hope in enumerate(hopes.tolist(), first):
                heapq.heappush(queue, (-hope, j))


def _split(rows: np.ndarray, branches: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Cluster of every row: k-means from distinct rows."""
    start = np.unique(rows[rng.choice(len(rows), min(len(rows), 4 * branches), replace=False)], axis=0)
    centres = start[rng.permutation(len(start))[:branches]].copy()
    for _ in range(rounds):
        nearest = ((centres * centres).sum(axis=1) - 2 * (rows @ centres.T)).argmin(axis=1)
        for j in range(len(centres)):
            if (mine := nearest == j).any():
                centres[j] = rows[mine].mean(axis=0)
    return nearest


def fit_tree(sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 11) -> Tree:
    """A tree over the sample with about ``leaves`` leaves; no rows give one leaf."""
    rng, small = np.random.default_rng(seed), max(1, len(sample) // max(1, leaves))
    sample = sample.astype(np.float32)
    centres, spreads, children, members = [], [], [], []

    def add(rows: np.ndarray) -> None:
        centre = rows.mean(axis=0) if len(rows) else np.zeros(sample.shape[1], np.float32)
        centres.append(centre)
        spreads.append(np.sqrt(((rows - centre) ** 2).sum(axis=1).mean()) if len(rows) else 0.0)
        children.append((0, 0))
        members.append(rows)

    add(sample)
    at = 0
    while at < len(members):
        rows, members[at] = members[at], None
        if len(rows) > small:
            parts = _split(rows, branches, rng)
            kinds = np.unique(parts)
            if len(kinds) > 1:
                first = len(centres)
                for j in kinds:
                    add(rows[parts == j])
                children[at] = (first, len(centres))
        at += 1
    leaf, work, n = np.full(len(centres), -1, np.int32), [0], 0
    while work:
        node = work.pop()
        first, end = children[node]
        if first == end:
            leaf[node], n = n, n + 1
        work.extend(range(end - 1, first - 1, -1))
    return Tree(np.array(centres, np.float32), np.array(spreads, np.float32), children, leaf)


@dataclass
class TreeIndex:
    """Every row with its leaf, the tree, and of every leaf its rows, first bin and number of bins."""

    rows: DataFrame
    tree: Tree
    dimension: int
    kind: str
    counts: np.ndarray
    first_bin: np.ndarray
    bins: np.ndarray


def _out(kind: str) -> str:
    return f"id bigint, vector array<{kind}>, leaf int"


def build_index(df: DataFrame, id_col: str, vector: str, leaves: int | None = None, sample_rows: int = SAMPLE_ROWS) -> TreeIndex:
    """Fits the tree on at most ``sample_rows`` rows and writes every row with its leaf to a table."""
    spark, dimension = df.sparkSession, common_dimension(df, vector)
    kind = df.schema[vector].dataType.elementType.simpleString()
    rows = sound_rows(df, id_col, vector, dimension).where(F.exists("vector", lambda x: x != 0))
    total = rows.count()
    most = max(1, min(sample_rows, SAMPLE_BYTES // (8 * max(1, dimension))))
    sample = rows if total <= most else rows.orderBy(F.xxhash64("id", "vector"), "id").limit(most)
    taken = sample.select("vector").toArrow().column("vector")
    fitted = matrix(taken, dimension) if total else np.zeros((0, dimension))
    wanted = leaves or min(LEAVES, TREE_BYTES // (4 * max(1, dimension)), max(BINS, total // LEAF_ROWS))
    tree = fit_tree(fitted[np.lexsort(fitted.T)] if total else fitted, min(wanted, max(1, len(fitted) // BRANCHES)))
    sent = spark.sparkContext.broadcast(tree.parts)

    def assign(batches):
        tree = Tree(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = tree.leaves_of(matrix(part.column("vector"), dimension).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.array(found)], ["id", "vector", "leaf"])

    stored = cut_lineage(rows.mapInArrow(trimmed(assign), _out(kind)))
    counts = np.zeros(tree.leaves, np.int64)
    for leaf, n in stored.groupBy("leaf").count().collect():  # at most LEAVES rows
        counts[leaf] = n
    # leaves fill a bin one after the other; one that is larger than a bin has several of its own
    room = max(1, min(BIN_BYTES // (8 * max(1, dimension)), -(-total // BINS)))
    first_bin, bins, at, used = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if used and used + n > room:
            at, used = at + 1, 0
        first_bin[leaf], bins[leaf] = at, max(1, -(-n // room))
        used += n
        if n > room:
            at, used = at + int(bins[leaf]), 0
    return TreeIndex(stored, tree, dimension, kind, counts, first_bin, bins)


def _walk(tree: Tree, counts: np.ndarray, query: np.ndarray, visits: int, enough: int):
    """The leaves of a search: ``visits`` of them, and more while they hold fewer than ``enough`` rows."""
    seen = rows = 0
    for leaf in tree.visits(query):
        if seen >= visits and rows >= enough:
            return
        seen, rows = seen + 1, rows + int(counts[leaf])
        yield leaf


def calibrate(index: TreeIndex, queries: DataFrame, k: int, recall: float, queries_at_most: int = CALIBRATION) -> int:
    """Visits at which searches find ``recall`` of the true first ``k`` of a bounded set of queries.

    The set holds the queries with the smallest hashes of their ids. Their neighbours come
    from one scan of the whole index, of which every task keeps k rows per query.
    """
    rows = queries.orderBy(F.xxhash64("id"), "id").limit(queries_at_most).toArrow()
    if not rows.num_rows:
        return 1
    ids, vectors, dimension = rows.column("id").to_numpy(), matrix(rows.column("vector"), index.dimension), index.dimension
    sent = index.rows.sparkSession.sparkContext.broadcast((ids, vectors))

    def scan(batches):
        own, asked = sent.value
        wide, best = asked.astype(np.float64), [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(own)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                names, leaf = part.column("id").to_numpy(), part.column("leaf").to_numpy()
                scores = wide @ matrix(part.column("vector"), dimension).astype(np.float64).T
                scores[own[:, None] == names[None, :]] = -np.inf
                for i, (s, n, f) in enumerate(best):
                    near = np.argpartition(-scores[i], k)[:k] if len(names) > k else np.arange(len(names))
                    near = near[np.isfinite(scores[i][near])]
                    s, n, f = np.concatenate([s, scores[i][near]]), np.concatenate([n, names[near]]), np.concatenate([f, leaf[near]])
                    order = np.lexsort((n, -s))[:k]
                    best[i] = s[order], n[order], f[order]
        for i, (s, n, f) in enumerate(best):
            if len(s):
                columns = [pa.array(np.full(len(s), i, np.int32)), pa.array(n), pa.array(f.astype(np.int32)), pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "id", "leaf", "score"])

    near = index.rows.mapInArrow(trimmed(scan), "query int, id bigint, leaf int, score double")
    true = top_n_per_group(near, ["query"], [F.desc("score"), F.asc("id")], k).select("query", "leaf").toArrow()
    wanted = [[] for _ in ids]
    for query, leaf in zip(true.column("query").to_pylist(), true.column("leaf").to_pylist()):
        wanted[query].append(leaf)
    places = []
    for vector, leaves in zip(vectors, wanted):
        place = {leaf: i for i, leaf in enumerate(index.tree.visits(vector.astype(np.float32)))}
        places.extend(place[leaf] for leaf in leaves)
    places, visits = np.array(places), 1
    while visits < index.tree.leaves and len(places) and (places < visits).mean() < recall:
        visits = min(index.tree.leaves, visits + max(1, visits // 8))
    logging.getLogger(__name__).info("%d of %d leaves are visited", visits, index.tree.leaves)
    return visits


def search(index: TreeIndex, queries: DataFrame, k: int, visits: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the first ``k`` that a search with ``visits`` leaves finds for (id, vector)."""
    spark, dimension, kind = index.rows.sparkSession, index.dimension, index.kind
    sent = spark.sparkContext.broadcast((index.tree.parts, index.counts, index.first_bin, index.bins))

    def walk(batches):
        parts, counts, first_bin, bins = sent.value
        tree = Tree(*parts)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                owner, bin_of, leaves = [], [], []
                for i, query in enumerate(matrix(part.column("vector"), dimension).astype(np.float32)):
                    asked = {}
                    for leaf in _walk(tree, counts, query, visits, k + 1):
                        for b in range(first_bin[leaf], first_bin[leaf] + bins[leaf]):
                            asked.setdefault(b, []).append(leaf)
                    owner.extend([i] * len(asked))
                    bin_of.extend(asked)
                    leaves.extend(asked.values())
                rows = pa.array(owner, pa.int32())
                columns = [part.column("id").take(rows), part.column("vector").take(rows), pa.array(bin_of, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "bin", "leaves"])

    asked = queries.mapInArrow(trimmed(walk), f"id bigint, vector array<{kind}>, bin int, leaves array<int>")
    # one row per bin; a bin whose queries do not fit one group meets them in parts
    parts = cut_lineage(asked.groupBy("bin").agg(F.ceil(F.count("*") / BIN_QUERIES).cast("int").alias("parts")))
    pick = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    left = asked.join(parts, "bin").select("id", "vector", "leaves", "bin", pick.alias("part"))
    places = spark.createDataFrame(list(zip(range(len(index.bins)), index.first_bin.tolist(), index.bins.tolist())), "leaf int, first int, n int")
    right = index.rows.join(F.broadcast(places), "leaf")  # at most LEAVES rows of three numbers
    right = right.select("id", "vector", "leaf", (F.col("first") + F.pmod(F.xxhash64("id", "vector"), F.col("n")).cast("int")).alias("bin"))
    right = right.join(parts, "bin").select("id", "vector", "leaf", "bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and rows.num_rows:
            leaf = rows.column("leaf").to_numpy()
            order = np.argsort(leaf, kind="stable")
            ids, stored, leaf = rows.column("id").to_numpy()[order], matrix(rows.column("vector"), dimension)[order], leaf[order]
            wide, unique = stored.astype(np.float64), len(np.unique(ids)) == len(ids)
            own, vectors = asked.column("id").to_numpy(), matrix(asked.column("vector"), dimension)
            lists = asked.column("leaves").combine_chunks()
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            kinds, starts = np.unique(leaf, return_index=True)
            sizes = np.diff(np.append(starts, len(leaf)))
            step = max(1, SCORES // len(ids))
            for at in range(0, len(own), step):
                scores = vectors[at : at + step].astype(np.float64) @ wide.T
                for i, line in enumerate(scores, at):
                    visited = np.repeat(np.isin(kinds, flat[bounds[i] : bounds[i + 1]]), sizes)
                    some = np.flatnonzero(visited & (ids != own[i]))
                    names, exact = top_rows(vectors[i], line[some], stored[some], ids[some], k, unique) if len(some) else (ids[:0], line[:0])
                    found.append((np.full(len(names), own[i]), names, exact))
        columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
        return pa.Table.from_arrays(columns, ["query_id", "vec_id", "score"])

    hits = left.groupBy("bin", "part").cogroup(right.groupBy("bin", "part")).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = top_n_per_group(once, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return best.select("query_id", "rank", "vec_id", "score")


def tree_neighbours(
    df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", recall: float = 0.95, leaves: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for every row where ``is_query``.

    ``is_query`` is a condition on the id, under the name ``id``. Candidates are all rows
    but the query's own, nearest first, ties to the smaller id. Rows with a null id, and
    vectors that are null, empty, zero, of another length than most, or hold a null or
    non-finite component take no part. Rows that share an id count as one row with the
    best of their scores, on either side. A query finds fewer than ``k`` only where there
    are fewer candidates. An empty table gives no rows; other columns are ignored.
    ``recall`` is the share of true neighbours at which calibration stops widening; above 1
    every leaf is visited.
    """
    index = build_index(df, id_col, vector, leaves)
    queries = index.rows.where(is_query).select("id", "vector")
    return search(index, queries, k, calibrate(index, queries, k, recall))
