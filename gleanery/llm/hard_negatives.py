"""Hard negatives by score bounds along a spanning tree of the anchors.

Scores are integer inner products of vectors with components floor(SCALE * x). Anchors
are cut into groups of similar ones; each group is spanned by a tree of least total
length. Where the score of a row with a parent anchor is known to lie in an interval, its
score with the child lies in that interval widened on both ends by the length of the
edge times the norm of the row. Only rows whose interval reaches what is wanted are
scored again, and their interval becomes a point.

That is done twice. First for the positives: of the rows with the anchor's label, those
whose upper bound reaches the n-th lower bound. Then for the negatives: rows of other
labels whose interval meets the window of a positive and reaches the n-th lower bound of
those that are certainly inside. Rows come in blocks, every pair of a group of anchors and
a block of rows is one group of a task, and each sends only its first n. Integers
keep every comparison exact.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.vectors import common_dimension, matrix, sound_rows
from gleanery.operators.ordering import global_rank, top_n_per_group
from gleanery.session import cut_lineage

SCALE = 256
#: Anchors that one tree spans, and bytes of vectors in a block of rows.
TREE_ANCHORS, BLOCK_BYTES = 1 << 10, 1 << 24
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) in double precision; whole numbers of any size have an exact double."""
    return np.floor(vectors.astype(np.float64) * scale)


def products(rows: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, bool]:
    """Exact integer inner products as longs, and whether all could be had in double precision.

    Else they are summed as Python integers, and one beyond 64 bits becomes the nearest long.
    """
    if len(rows) == 0 or np.abs(rows).max(initial=0.0) * np.abs(anchor).max(initial=0.0) * max(1, rows.shape[1]) < EXACT:
        return (rows @ anchor).astype(np.int64), True
    mine = [int(x) for x in anchor]
    sums = (sum(int(x) * y for x, y in zip(row, mine)) for row in rows.tolist())
    return np.array([max(-LARGEST - 1, min(LARGEST, s)) for s in sums], np.int64), False


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and edge length of every point in a tree of least total length from point 0 (whose parent is -1)."""
    n = len(points)
    parent, length, open_ = np.full(n, -1), np.full(n, np.inf), np.ones(n, bool)
    length[0], squares = 0.0, (points * points).sum(axis=1)
    for _ in range(n):
        at = int(np.where(open_, length, np.inf).argmin())
        open_[at] = False
        away = np.sqrt(np.maximum(squares + squares[at] - 2 * (points @ points[at]), 0.0))
        nearer = open_ & (away < length)
        length[nearer], parent[nearer] = away[nearer], at
    edges = points - points[np.maximum(parent, 0)]
    edges[0] = 0.0
    return parent, np.sqrt((edges * edges).sum(axis=1))  # again from differences, which lose nothing


def tree_order(parent: np.ndarray) -> list[int]:
    """Parents before children and the largest subtree last, so that few nodes have children still to come."""
    children, size = [[] for _ in parent], np.ones(len(parent), int)
    for node, up in enumerate(parent.tolist()):
        if up >= 0:
            children[up].append(node)
    order, work = [], [0]
    while work:
        node = work.pop()
        order.append(node)
        work.extend(children[node])
    for node in reversed(order):
        if parent[node] >= 0:
            size[parent[node]] += size[node]
    order, work = [], [0]
    while work:
        node = work.pop()
        order.append(node)
        work.extend(sorted(children[node], key=lambda c: -size[c]))
    return order


def bounded_scores(rows: np.ndarray, anchors: np.ndarray, wanted):
    """Walks the tree; ``wanted(anchor, low, high)`` gives the rows to score, and (anchor, rows, scores) comes back.

    Yields only exact scores. Bounds are widened a little more than rounding can move them.
    """
    norms = np.sqrt((rows * rows).sum(axis=1))
    parent, length = spanning_tree(anchors)
    waiting = np.bincount(parent[parent >= 0], minlength=len(parent))
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for node in tree_order(parent):
        up = int(parent[node])
        if up < 0:
            low, high = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
            some = np.arange(len(rows))
        else:
            reach = (length[node] * (1 + 1e-9)) * norms * (1 + 1e-9)
            low, high = known[up][0] - reach, known[up][1] + reach
            slack = 1e-9 * np.maximum(np.abs(low), np.abs(high)) + 1e-6
            low, high = low - slack, high + slack
            waiting[up] -= 1
            if not waiting[up]:
                del known[up]
            some = wanted(node, low, high)
        scores, exact = products(rows[some], anchors[node])
        low[some] = scores if exact else -np.inf  # of huge numbers nothing is concluded
        high[some] = scores if exact else np.inf
        if waiting[node]:
            known[node] = low, high
        yield node, some, scores


def _first(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by score descending, id ascending."""
    return np.lexsort((ids, ~scores))[:n]


def _nth(bounds: np.ndarray, n: int) -> float:
    return np.partition(bounds, len(bounds) - n)[len(bounds) - n] if len(bounds) >= n else -np.inf


def _columns(table: pa.Table, dimension: int, scale: int):
    return table.column("id").to_numpy(), table.column("label").to_numpy(), whole(matrix(table.column("vector"), dimension), scale)


def _once(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
    """One row per id: that with the least label, then the least vector."""
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*rows.T[::-1], labels, ids))
        order = order[np.unique(ids[order], return_index=True)[1]]
        ids, labels, rows = ids[order], labels[order], rows[order]
    return ids, labels, rows


def _table(found: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*found) if found else [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _pairs(anchors: DataFrame, rows: DataFrame, groups: int, blocks: int, work, out: str) -> DataFrame:
    """``work(anchors, rows)`` for every group of anchors and block of rows."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("block", every(blocks))
    right = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("group", every(groups))
    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(work, out)


def hard_negatives(
    df: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector: str = "embedding", label="label", scale: int = SCALE,
    tree_anchors: int = TREE_ANCHORS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    ``is_anchor`` is a condition on the column ``id``; ``label`` is a column of ``df`` or an
    expression over it. Positives are the first rows of the anchor's label, negatives the
    first rows of another label with low * positive <= 100 * negative <= high * positive;
    both by score descending, then id. Rows with a null id or label and vectors that are
    null, empty, of another length than most, or hold a null or non-finite component take
    no part. Of rows that share an id the one with the least label, then vector, counts. An anchor
    without positives, and a positive without negatives, give no rows; an empty table
    gives none; other columns are ignored. Scores beyond 64 bits count as the nearest long. Every anchor is compared with every row, by its bounds at least:
    the work is the number of anchors times the rows, in blocks of bounded size.
    """
    dimension = common_dimension(df, vector)
    named = F.expr(label) if isinstance(label, str) else label
    rows = sound_rows(df, id_col, vector, dimension, named.cast("bigint").alias("label"))
    rows = rows.where("label IS NOT NULL")
    blocks = max(1, -(-rows.count() * 8 * max(1, dimension) // block_bytes))
    # near anchors get near places: by the signs of the first components
    signs = F.array_join(F.transform(F.slice("vector", 1, 16), lambda x: F.when(x < 0, "0").otherwise("1")), "")
    least = F.min(F.struct("label", "vector")).alias("r")
    anchors = rows.where(is_anchor).groupBy("id").agg(least).select("id", "r.label", "r.vector")
    anchors = global_rank(anchors, [signs, F.col("id")], "place").withColumn("group", F.floor((F.col("place") - 1) / tree_anchors).cast("int"))
    anchors = cut_lineage(anchors.drop("place"))
    groups = (anchors.agg(F.max("group")).first()[0] or 0) + 1

    def find_positives(asked: pa.Table, stored: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and stored.num_rows:
            own, own_label, points = _columns(asked, dimension, scale)
            ids, labels, vectors = _once(*_columns(stored, dimension, scale))

            def candidates(node):
                return (labels == own_label[node]) & (ids != own[node])

            def wanted(node, low, high):
                some = np.flatnonzero(candidates(node))
                return some[high[some] >= _nth(low[some], positives)]

            for node, some, scores in bounded_scores(vectors, points, wanted):
                mine = candidates(node)[some]
                some, scores = some[mine], scores[mine]
                for i in _first(ids[some], scores, positives).tolist():
                    found.append((own[node], ids[some[i]], scores[i]))
        return _table(found, ["anchor_id", "positive_id", "score"])

    shortlist = _pairs(anchors, rows, groups, blocks, find_positives, "anchor_id bigint, positive_id bigint, score bigint")
    chosen = top_n_per_group(shortlist, ["anchor_id"], [F.desc("score"), F.asc("positive_id")], positives)
    lists = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("asked"))  # of few rows each
    armed = cut_lineage(anchors.join(lists, anchors["id"] == lists["anchor_id"]).drop("anchor_id"))

    def find_negatives(asked: pa.Table, stored: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and stored.num_rows:
            own, own_label, points = _columns(asked, dimension, scale)
            ids, labels, vectors = _once(*_columns(stored, dimension, scale))
            asks = [[(p["positive_id"], int(p["score"])) for p in one] for one in asked.column("asked").to_pylist()]

            def wanted(node, least, most):
                other, needed = labels != own_label[node], np.zeros(len(ids), bool)
                for _, score in asks[node]:
                    floor, ceiling = low * score / 100, high * score / 100
                    slack = 1e-9 * abs(score) + 1e-6
                    sure = other & (least >= floor + slack) & (most <= ceiling - slack)
                    bar = max(floor - slack, _nth(least[sure], negatives))
                    needed |= other & (most >= bar) & (least <= ceiling + slack)
                return np.flatnonzero(needed)

            for node, some, scores in bounded_scores(vectors, points, wanted):
                other = labels[some] != own_label[node]
                some, scores = some[other], scores[other]
                for positive, score in asks[node]:
                    # 100 * negative between low and high times the positive, in integers
                    floor, ceiling = -(-low * score // 100), high * score // 100
                    inside = np.flatnonzero((scores >= floor) & (scores <= ceiling))
                    for i in inside[_first(ids[some[inside]], scores[inside], negatives)].tolist():
                        found.append((own[node], positive, ids[some[i]], score, scores[i]))
        return _table(found, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    out = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    near = _pairs(armed, rows, groups, blocks, find_negatives, out)
    best = top_n_per_group(near, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
