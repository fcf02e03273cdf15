import numpy as np

from gleanery.llm.hard_negatives import bounded_scores, hard_negatives, spanning_tree, tree_order, whole

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, score string, block int, _label int"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90, d=8):
    once = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or None in v or len(v) != d or not np.isfinite(v).all():
            continue
        key = (label, tuple(int(np.floor(256 * x)) for x in v))
        once[i] = min(once.get(i, key), key)
    out = []
    for a, (label, x) in once.items():
        if not anchor(a):
            continue
        scores = {i: max(-(1 << 63), min((1 << 63) - 1, sum(p * q for p, q in zip(x, y)))) for i, (_, y) in once.items() if i != a}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if once[i][0] == label][:positives]:
            inside = [i for i in order if once[i][0] != label and low * scores[p] <= 100 * scores[i] <= high * scores[p]]
            out += [(a, p, r, n, scores[p], scores[n]) for r, n in enumerate(inside[:negatives], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "clash", "clash", 1, 9) for i, v, label in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in hard_negatives(df, "id % 10 = 0", **options).collect())


def fixture(n=700, d=8):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(9, d))
    rows = [(i, (middle[rng.integers(9)] + 0.3 * rng.normal(size=d)).tolist(), int(rng.integers(4))) for i in range(n)]
    rows += [(10, None, 1), (20, [float("nan")] * d, 1), (30, [None] * d, 1), (1_000, [1.0] * d, None), (None, [1.0] * d, 1)]
    rows += [(1_010, [], 1), (1_020, [1.0] * 3, 1), (40, rows[41][1], 2), (51, rows[52][1], 0), (60, rows[60][1], rows[60][2])]
    rows += [(i, [0.0] * d, 2) for i in range(2_000, 2_025)] + [(i, [0.5] * d, i % 2) for i in range(3_000, 3_060)]  # ties
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    want = brute(rows, lambda i: i % 10 == 0)
    assert run(spark, rows) == want and len(want) > 1_000
    assert run(spark, rows, tree_anchors=16, block_bytes=8 * 8 * 100) == want
    assert run(spark, rows, positives=2, negatives=3, low=0, high=100) == brute(rows, lambda i: i % 10 == 0, 2, 3, 0, 100)


def test_huge_components_are_exact(spark):
    rows = [(i, [float(x) * 10.0 ** (i % 9) for x in v], label) for i, v, label in fixture(200) if v and None not in v and i is not None]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_empty_and_alone(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, None, 1)]) == []
    assert run(spark, [(0, [1.0] * 8, 1), (1, [1.0] * 8, 2)]) == []
    assert run(spark, [(0, [1.0] * 8, 1), (1, [1.0] * 8, 1), (2, [0.5] * 8, 2)]) == [(0, 1, 1, 2, 524_288, 262_144)]


def test_bounds_spare_scores():
    """On anchors in tight groups most rows are decided by their bounds alone."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(6, 12)) * 4
    anchors = whole(middle[rng.integers(6, size=120)] + 0.01 * rng.normal(size=(120, 12)))
    rows = whole(rng.normal(size=(2_000, 12)))
    scored = 0
    for node, some, scores in bounded_scores(rows, anchors, lambda node, low, high: np.flatnonzero(high >= np.partition(low, -5)[-5])):
        true = rows @ anchors[node]
        assert (scores == true[some]).all()
        assert set(np.argsort(-true, kind="stable")[:3].tolist()) <= set(some.tolist())
        scored += len(some)
    assert scored < 0.3 * len(rows) * len(anchors)


def test_spanning_tree_is_least_and_ordered():
    points = np.random.default_rng(7).normal(size=(60, 3))
    parent, length = spanning_tree(points)
    away = np.linalg.norm(points[:, None] - points[None], axis=2)
    joined, total = {0}, 0.0
    while len(joined) < 60:  # Prim, by sets
        cost, new = min((away[a, b], b) for a in joined for b in range(60) if b not in joined)
        joined.add(new)
        total += cost
    assert np.isclose(length.sum(), total)
    order = tree_order(parent)
    assert sorted(order) == list(range(60)) and all(order.index(p) < order.index(c) for c, p in enumerate(parent) if p >= 0)
