import numpy as np
import pytest

from gleanery.llm.kmeans_tree import build_index, calibrate, fit_tree, tree_neighbours
from gleanery.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, id int, score string, leaf string, bin int"


def clustered(rng, n, d=16, centres=12):
    middle = rng.normal(size=(centres, d)) * 3
    return (middle[rng.integers(centres, size=n)] + rng.normal(size=(n, d))).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], 1, "s", "l", 2) for i, v in rows], SCHEMA).repartition(4)


def brute(rows, k, query):
    """{query: [(id, score)]} over all sound rows; rows that share an id count by their best score."""
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v]
    sound = [(i, v) for i, v in sound if len(v) == 16 and np.isfinite(v).all() and v.any()]
    out = {}
    for q, x in sound:
        if query(q):
            best = out.setdefault(q, {})
            for i, y in sound:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float((x * y).sum()))
    return {q: sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k] for q, best in out.items()}


def found(df, k, **options):
    out = {}
    for r in sorted(tree_neighbours(df, "id % 20 = 0", k, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_with_all_leaves_it_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = clustered(rng, 900)
    vectors[100:400] = vectors[100]  # copies of one vector: a leaf that is cut into bins
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(20, None), (40, []), (60, [0.0] * 16), (80, [None] + [1.0] * 15), (2_000, [float("nan")] * 16), (2_020, [float("inf")] * 16)]
    rows += [(None, [1.0] * 16), (2_040, [1.0] * 3), (7, rows[8][1]), (20, rows[21][1]), (500, rows[500][1])]
    want = brute(rows, 20, lambda q: q % 20 == 0)
    got = found(frame(spark, rows), 20, recall=1.1)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        np.testing.assert_allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_recall_and_visits(spark):
    rows = [(int(i), v.tolist()) for i, v in enumerate(clustered(np.random.default_rng(2), 6_000))]
    df = frame(spark, rows)
    want, got = brute(rows, 10, lambda q: q % 20 == 0), found(df, 10)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and all(len(g) == 10 for g in got.values())
    index = build_index(df, "vec_id", "embedding")
    queries = index.rows.where("id % 20 = 0").select("id", "vector")
    few, many = (calibrate(index, queries, 10, share) for share in (0.5, 0.95))
    assert few <= many < index.tree.leaves / 2  # the data have clusters, so most leaves are passed over


def test_few_candidates_are_all_found(spark):
    rows = [(0, [1.0] * 16), (1, [2.0] * 16), (3, [-1.0] * 16)]
    assert found(frame(spark, rows), 20) == {0: [(1, 32.0), (3, -16.0)]}
    assert found(frame(spark, [(0, [1.0] * 16)]), 20) == {}
    assert found(frame(spark, []), 20) == {}
    assert found(frame(spark, [(20, None)]), 20) == {}


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0] * 16) for i in range(400)]
    got = found(frame(spark, rows), 20)
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[200]] == list(range(20))


def test_the_walk_visits_every_leaf_once():
    rows = clustered(np.random.default_rng(3), 500)
    tree = fit_tree(rows, 40)
    order = list(tree.visits(rows[0]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 8
    assert set(tree.leaves_of(rows).tolist()) <= set(order)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    vectors = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in QUERIES["op11_neighbours"](spark, sf).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(vectors[ids == r.query_id][0] @ vectors[ids == r.vec_id][0]), abs=1e-12)
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        scores = np.where(ids == q, -np.inf, vectors @ vectors[ids == q][0])
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]].tolist()) & set(got[q]))
    assert hits >= 0.9 * 20 * len(got)
