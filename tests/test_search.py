import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import embedding as E
from gleanery.operators import ivf
from gleanery.operators import search as S

RNG = np.random.default_rng(3)
VECTORS = RNG.normal(size=(300, 8)).astype(np.float32)
VECTORS[100:220] = VECTORS[7]  # a group of copies: 120 equal vectors
VECTORS[5] = 0


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"c{i:03d}", f"d{i // 3}", "python" if i % 2 else "text", f"text {i}", VECTORS[i].tolist(), (f"s{i % 4}",)) for i in range(300)]
    rows += [("short", "dx", "text", "short", [1.0], ("s",)), ("none", "dx", "text", "none", None, ("s",))]
    return spark.createDataFrame(
        rows, "chunk_id string, doc_id string, content_type string, content string, vector array<float>, metadata struct<source:string>"
    ).repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, VECTORS[7].tolist()), (2, VECTORS[40].tolist()), (3, RNG.normal(size=8).astype(np.float32).tolist())]
    return spark.createDataFrame(rows, "query_id int, vector array<float>")


def expected(queries, k, metric, rows=range(300)):
    out = set()
    for q in queries.collect():
        scores = S.exact_scores(np.array(q.vector, dtype=np.float32), VECTORS, metric)
        order = sorted(rows, key=lambda i: (scores[i] if metric == "L2" else -scores[i], i))
        out |= {(q.query_id, r + 1, f"c{i:03d}") for r, i in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("metric", S.METRICS)
@pytest.mark.parametrize("k", [1, 5, 100])
def test_exact_search_with_many_ties(corpus, queries, metric, k):
    hits = S.nearest(queries, corpus, k, metric, output=["doc_id"])
    assert {(h.query_id, h["rank"], h.chunk_id) for h in hits.collect()} == expected(queries, k, metric)


@pytest.mark.parametrize("metric", S.METRICS)
def test_block_plan_equals_scan_plan(corpus, queries, metric, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 2)
    small = corpus.where("chunk_id < 'c030' or chunk_id between 'c100' and 'c120'")
    scan = S.nearest(queries, small, 7, metric, output=["doc_id"]).collect()
    blocks = S.nearest(queries, small, 7, metric, output=["doc_id"], plan="blocks").collect()
    assert sorted(map(tuple, scan)) == sorted(map(tuple, blocks)) and len(scan) == 21


def test_filters_apply_before_ranking(corpus, queries, caplog):
    with caplog.at_level(logging.WARNING):
        hits = S.vector_search(queries, corpus, 5, {"content_type": ["python"], "colour": "red"})
    assert "colour" in caplog.text
    got = {(h.query_id, h["rank"], h.id) for h in hits.collect()}
    assert got == expected(queries, 5, "L2", range(1, 300, 2))
    assert set(hits.columns) == {"query_id", "rank", "id", "document_id", "content", "score", "metadata"}
    assert S.vector_search(queries, corpus, 5, {"source": "it's", "doc_id": "x"}).count() == 0
    totals = {r.query_id: r.total for r in S.search_totals(hits).collect()}
    assert totals == {1: 5, 2: 5, 3: 5}


def test_vectors_on_request(corpus, queries):
    hits = S.vector_search(queries, corpus, 1, include_metadata=False, include_vectors=True).orderBy("query_id").collect()
    assert hits[0].id == "c007" and np.allclose(hits[0].vector, VECTORS[7]) and hits[0].score == 0


@pytest.mark.parametrize("k", [0, 101, -1])
def test_k_bounds(corpus, queries, k):
    with pytest.raises(ValueError):
        S.nearest(queries, corpus, k)


def test_no_queries_no_hits(corpus, queries):
    assert S.nearest(queries.limit(0), corpus, 5).count() == 0


def test_candidate_summary(corpus, queries):
    rows = {r.query_id: r for r in S.candidate_summary(queries, corpus).collect()}
    blocks = S.candidate_summary(queries, corpus, plan="blocks").collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, rows.values()))
    scores = S.exact_scores(VECTORS[7], VECTORS, "L2")
    assert rows[1].pairs == 300 and rows[1].low == 0 and abs(rows[1].high - scores.max()) < 1e-9


def test_cells(corpus, queries):
    valid = corpus.where(E.has_dimension(F.col("vector"), 8))
    centers = ivf.train_cells(valid, 6)
    cells = ivf.ivf_assign(valid, centers)
    for row in cells.select("chunk_id", "_cell").collect():
        distance = ((centers - VECTORS[int(row.chunk_id[1:])]) ** 2).sum(axis=1)
        assert distance[row._cell] <= distance.min() + 1e-5
    exact = S.nearest(queries, valid, 5, output=["doc_id"]).collect()
    all_cells = ivf.ivf_search(queries, cells, centers, 5, 6, output=["doc_id"]).collect()
    assert sorted(map(tuple, exact)) == sorted(map(tuple, all_cells))
    some = ivf.ivf_search(queries, cells, centers, 5, 2, output=["doc_id"]).collect()
    blocks = ivf.ivf_search(queries, cells, centers, 5, 2, output=["doc_id"], plan="blocks").collect()
    assert sorted(map(tuple, some)) == sorted(map(tuple, blocks))


def test_more_cells_than_rows(spark):
    few = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "chunk_id string, vector array<float>")
    assert len(ivf.train_cells(few, 1024)) <= 2


def test_default_model_is_unit_length_and_stable(spark):
    model = E.hashed_bag_of_words(16)()
    a = model(["One two  TWO", "one two two", ""])
    assert np.allclose(a[0], a[1]) and abs(np.linalg.norm(a[0]) - 1) < 1e-9 and not a[2].any()


def test_missing_model_leaves_vectors_null(spark):
    def loader():
        raise ImportError("no such model")

    df = E.embed_chunks(spark.createDataFrame([("x",), ("y",)], "content string"), loader)
    assert [r.vector for r in df.collect()] == [None, None]


def test_batches_of_texts(spark):
    def loader():
        def embed(texts):
            assert len(texts) <= 3
            return np.array([[len(t)] for t in texts])

        return embed

    df = E.embed_chunks(spark.createDataFrame([("x" * i,) for i in range(20)], "content string"), loader, batch_size=3)
    assert all(r.vector == [float(len(r.content))] for r in df.collect())


def test_query_embedding(spark):
    texts = spark.createDataFrame([(1, "a b", None), (2, "c", [1.0, 2.0])], "query_id int, text string, vector array<float>")
    with pytest.raises(ValueError):
        E.embed_query(texts.drop("vector"))
    rows = {r.query_id: r.vector for r in E.embed_query(texts, E.hashed_bag_of_words(2)).collect()}
    assert rows[2] == [1.0, 2.0] and len(rows[1]) == 2


def test_dimension_check_reports_reasons(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, vector array<float>")
    good, bad = E.check_dimension(df, 2)
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.reason for r in bad.collect()} == {2: "expected 2 values, got 1", 3: "expected 2 values, got 0"}


def test_the_model_runs_once_per_chunk(spark):
    texts = spark.createDataFrame([("a b",), ("c",)], "content string")
    accepted, rejected = E.check_dimension(E.embed_chunks(texts, E.hashed_bag_of_words(4)), 4)
    plan = accepted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and accepted.count() == 2 and rejected.count() == 0
    centers = np.array([[0.0, 0, 0, 0], [1, 1, 1, 1]], dtype=np.float32)
    cells = ivf.ivf_assign(accepted, centers).where("_cell = 1")
    assert cells._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2


def test_bounded_search_is_exact_and_compares_fewer(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(20, 8)) * 10
    vectors = (middle[rng.integers(20, size=1_500)] + 0.3 * rng.normal(size=(1_500, 8))).astype(np.float32)
    corpus = spark.createDataFrame([(f"c{i:04d}", v.tolist(), "x") for i, v in enumerate(vectors)], "chunk_id string, vector array<float>, doc_id string")
    queries = spark.createDataFrame([(i, vectors[i * 7].tolist()) for i in range(30)], "query_id int, vector array<float>")
    centers = ivf.train_cells(corpus, 20)
    cells = ivf.ivf_assign(corpus, centers)
    sizes = ivf.cell_sizes(cells, centers)
    radii = np.array([r for r, _ in sizes])
    assert sum(n for _, n in sizes) == 1_500
    for metric in ("L2", "IP"):
        want = sorted(map(tuple, S.nearest(queries, corpus, 5, metric, output=["doc_id"]).collect()))
        assert sorted(map(tuple, ivf.bounded_search(queries, cells, centers, radii, 5, metric, output=["doc_id"]).collect())) == want
    asked = queries.withColumn("cells", ivf._nearest_cells(F.col("vector"), centers, 2))
    first = S.nearest(asked, cells, 5, output=[], dimension=8)
    left = ivf.open_cells(asked, first, centers, radii, 5)
    rows = {i: n for i, (_, n) in enumerate(sizes)}
    compared = sum(rows[c] for df in (asked, left) for r in df.collect() for c in r["cells"])
    assert compared < 0.5 * 30 * 1_500
    with pytest.raises(ValueError):
        ivf.bounded_search(queries, cells, centers, radii, 5, "COSINE")


def test_bounded_search_with_fewer_rows_than_asked(spark, queries):
    corpus = spark.createDataFrame([("a", VECTORS[1].tolist()), ("b", VECTORS[2].tolist())], "chunk_id string, vector array<float>")
    centers = VECTORS[1:4]
    cells = ivf.ivf_assign(corpus, centers)
    radii = np.array([r for r, _ in ivf.cell_sizes(cells, centers)])
    assert ivf.bounded_search(queries, cells, centers, radii, 5, output=[]).count() == 6
    empty = ivf.bounded_search(queries, cells.limit(0), centers, np.zeros(3), 5, output=[])
    assert empty.count() == 0


def test_training_takes_sound_vectors_only(spark, corpus):
    odd = [("n", [float("nan")] * 8), ("i", [float("inf")] * 8), ("x", [None] + [1.0] * 7), ("s", [1.0] * 3), ("0", None)]
    dirty = corpus.select("chunk_id", "vector").unionByName(spark.createDataFrame(odd, "chunk_id string, vector array<float>"))
    assert np.isfinite(ivf.train_cells(dirty, 4)).all() and ivf.train_cells(dirty, 4).shape == (4, 8)
    assert ivf.train_cells(dirty.limit(0), 4, dimension=8).tolist() == [[0.0] * 8]


def test_queries_of_another_length_hide_nothing(spark):
    corpus = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "chunk_id string, vector array<float>")
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0]), (3, [2.0])], "query_id int, vector array<float>")
    for plan in S.PLANS:
        assert [(h.query_id, h.chunk_id) for h in S.nearest(queries, corpus, 1, output=[], plan=plan).collect()] == [(1, "a")]
    assert {tuple(r) for r in S.vector_rejects(queries, corpus).collect()} == {("query", "expected 2 values, got 1", 2)}
