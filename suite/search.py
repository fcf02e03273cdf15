"""Vector search, filters, cells and text search (F5, G6, H4, K, L, C19)."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.operators import chunking as C
from gleanery.operators import embedding as E
from gleanery.operators import ivf
from gleanery.operators import search as S
from gleanery.session import cut_lineage, scratch_path
from gleanery.sources.collection import collection_rows
from suite import inputs as I
from suite import query
from suite.chunks import FIXED_CTE, bag_of_words_ctes

SQUARED = "pow(list_distance(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 2)"
DOT = "list_inner_product(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[]))"
COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[]))"


def _topk_sql(k: int, score: str = SQUARED, direction: str = "ASC", where: str = "true") -> str:
    return f"""
WITH {I.CENTROID_CTE}, {I.CHUNK_CTE},
scored AS (SELECT query_id, chunk_id, doc_id, content, source, {score} AS s FROM c, q WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s {direction}, chunk_id) AS rank FROM scored)
SELECT CAST(query_id AS BIGINT) AS query_id, rank, chunk_id AS id, doc_id AS document_id, content, round(s, 6) AS score
FROM ranked WHERE rank <= {k}"""


def _stored(spark, sf):
    return collection_rows(I.vector_chunks(spark, sf))


def _shown(hits):
    return hits.select(
        "query_id", I.big("rank").alias("rank"), "id", "document_id", "content", F.round("score", 6).alias("score")
    )


FILTERS = {"content_type": ["markdown", "python"], "tenant": "ignored"}
FILTERS_SQL = "content_type IN ('markdown', 'python')"


@query("vector_topk", _topk_sql(5, where=FILTERS_SQL))
def vector_topk(spark, sf):
    """Flagship: exact top 5 with a filter, for the mean vector of every label."""
    hits = S.vector_search(I.centroid_queries(spark, sf), _stored(spark, sf), 5, FILTERS, include_metadata=False, dimension=I.DIMENSION)
    return _shown(hits)


BROKEN = """CASE WHEN {id} % 11 = 0 THEN transform({v}, (x, i) -> IF(i = 3, CAST('NaN' AS FLOAT), x))
  WHEN {id} % 13 = 0 THEN transform({v}, (x, i) -> IF(i = 5, NULL, x)) WHEN {id} % 17 = 0 THEN NULL
  WHEN {id} % 19 = 0 THEN slice({v}, 1, 63) WHEN {id} % 23 = 0 THEN transform({v}, x -> CAST('Infinity' AS FLOAT)) ELSE {v} END"""
SOUND = "vec_id % 11 <> 0 AND vec_id % 13 <> 0 AND vec_id % 17 <> 0 AND vec_id % 19 <> 0 AND vec_id % 23 <> 0"


def _dirty(spark, sf):
    """Stored vectors and queries of which many have a NaN, a null or infinite entry, 63 values, or are null.

    Most queries have a length that no stored vector has.
    """
    stored = _stored(spark, sf).withColumn("vec_id", F.expr("CAST(substr(chunk_id, 4) AS BIGINT)"))
    queries = I.centroid_queries(spark, sf)
    wrong = queries.select((F.col("query_id") + 100_001).alias("query_id"), "vector").withColumn("n", F.row_number().over(Window.orderBy("query_id")))
    wrong = wrong.select("query_id", F.expr(BROKEN.format(id="array(11, 13, 17, 19, 23)[n % 5]", v="vector")).alias("vector"))
    other = queries.select(F.explode(F.array(*(F.lit(n) + F.col("query_id") for n in (200_001, 300_001)))).alias("query_id"), F.slice("vector", 1, 5).alias("vector"))
    return queries.unionByName(wrong).unionByName(other), stored.withColumn("vector", F.expr(BROKEN.format(id="vec_id", v="vector")))


@query("vector_topk_dirty", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, query_id, rank, id, score FROM ({_topk_sql(10, s, d, SOUND)})"
    for m, s, d in (("L2", SQUARED, "ASC"), ("IP", DOT, "DESC"), ("COSINE", COSINE, "DESC"))
))
def vector_topk_dirty(spark, sf):
    """Unsound vectors on both sides never hide or displace a sound hit, under any metric and in either plan."""
    queries, stored = _dirty(spark, sf)
    queries, found = cut_lineage(queries), []
    for metric, plan in zip(S.METRICS, ("scan", "blocks", "scan")):
        hits = S.vector_search(queries, stored, 10, metric=metric, include_metadata=False, plan=plan)
        found.append(_shown(hits).select(F.lit(metric).alias("metric"), "query_id", "rank", "id", "score"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("vector_rejects", f"""
WITH {I.CENTROID_CTE}, m AS (SELECT row_number() OVER (ORDER BY query_id) % 5 AS r FROM q),
r AS (
  SELECT 'query' AS side, CASE r WHEN 2 THEN 'expected 64 values, got 0' WHEN 3 THEN 'expected 64 values, got 63' ELSE 'null or non-finite value' END AS reason FROM m
  UNION ALL SELECT 'stored', CASE WHEN vec_id % 11 = 0 OR vec_id % 13 = 0 THEN 'null or non-finite value' WHEN vec_id % 17 = 0 THEN 'expected 64 values, got 0'
    WHEN vec_id % 19 = 0 THEN 'expected 64 values, got 63' ELSE 'null or non-finite value' END FROM embeddings WHERE NOT ({SOUND})
  UNION ALL SELECT 'query', 'expected 64 values, got 5' FROM q, (VALUES (1), (2)) AS twice
)
SELECT side, reason, count(*) AS n FROM r GROUP BY side, reason""")
def vector_rejects(spark, sf):
    return S.vector_rejects(*_dirty(spark, sf))


@query("vector_metrics", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, * FROM ({_topk_sql(10, s, d)})"
    for m, s, d in (("L2", SQUARED, "ASC"), ("IP", DOT, "DESC"), ("COSINE", COSINE, "DESC"))
))
def vector_metrics(spark, sf):
    queries, stored = cut_lineage(I.centroid_queries(spark, sf)), _stored(spark, sf)
    found = [
        _shown(S.vector_search(queries, stored, 10, metric=m, include_metadata=False)).select(F.lit(m).alias("metric"), "*")
        for m in S.METRICS
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


SELF_SQL = f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings), {I.CHUNK_CTE},
scored AS (SELECT query_id, chunk_id, {SQUARED} AS s FROM c, q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, chunk_id) AS rank FROM scored)
SELECT query_id, rank, chunk_id, round(s, 6) AS score FROM ranked WHERE rank <= 5"""


@query("topk_per_query", SELF_SQL)
def topk_per_query(spark, sf):
    """Every stored vector as a query: the shuffled block plan, no broadcast of the queries."""
    stored = _stored(spark, sf)
    queries = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = S.nearest(queries, stored, 5, output=[], plan="blocks", dimension=I.DIMENSION)
    return hits.select("query_id", I.big("rank").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query("cross_candidates", f"""
WITH {I.CENTROID_CTE}
SELECT CAST(query_id AS BIGINT) AS query_id, count(*) AS pairs, round(min({SQUARED}), 6) AS low, round(max({SQUARED}), 6) AS high
FROM embeddings, q GROUP BY query_id""")
def cross_candidates(spark, sf):
    s = S.candidate_summary(I.centroid_queries(spark, sf), _stored(spark, sf))
    return s.select("query_id", "pairs", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("project_hits", f"""
SELECT h.query_id, h.rank, h.id, h.document_id, h.content, h.score, concat('https://src', e.label, '.example.com/it', chr(39), 's') AS source,
       round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_value
FROM ({_topk_sql(3)}) h JOIN embeddings e ON h.id = concat('vec', e.vec_id)""")
def project_hits(spark, sf):
    hits = S.vector_search(I.centroid_queries(spark, sf), _stored(spark, sf), 3, include_vectors=True)
    return hits.select(
        "query_id", I.big("rank").alias("rank"), "id", "document_id", "content", F.round("score", 6).alias("score"),
        "metadata.source", F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"),
    )


@query("search_totals", f"SELECT query_id, count(*) AS total FROM ({_topk_sql(7, where=FILTERS_SQL)}) GROUP BY query_id")
def search_totals(spark, sf):
    hits = S.vector_search(I.centroid_queries(spark, sf), _stored(spark, sf), 7, FILTERS, include_metadata=False)
    return S.search_totals(hits)


def _filter_sql(where: str) -> str:
    return f"WITH {I.CHUNK_CTE} SELECT chunk_id, doc_id, content_type, source FROM c WHERE {where}"


def _filtered(spark, sf, condition):
    return _stored(spark, sf).where(condition).select("chunk_id", "doc_id", "content_type", "metadata.source")


@query("filter_content_type", _filter_sql("content_type IN ('python', 'text')"))
def filter_content_type(spark, sf):
    return _filtered(spark, sf, S.filter_content_type(["python", "text"]))


@query("filter_source", _filter_sql("source = concat('https://src4.example.com/it', chr(39), 's')"))
def filter_source(spark, sf):
    return _filtered(spark, sf, S.filter_source("https://src4.example.com/it's"))


@query("filter_doc_id", _filter_sql("doc_id = 'doc7'"))
def filter_doc_id(spark, sf):
    return _filtered(spark, sf, S.filter_doc_id("doc7"))


@query("combine_filters", _filter_sql("content_type = 'python' AND source = concat('https://src4.example.com/it', chr(39), 's')"))
def combine_filters(spark, sf):
    return _filtered(spark, sf, S.combine_filters(
        {"content_type": "python", "source": "https://src4.example.com/it's", "unknown": 1}
    ))


NLIST = 16


def _distance(vector, center):
    """Squared distance of two columns in double precision, by expressions."""
    squares = F.zip_with(vector, center, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def _center_column(centers):
    return F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centers))


@query("ivf_assign", "SELECT concat('vec', vec_id) AS chunk_id, true AS known, true AS is_nearest FROM embeddings")
def ivf_assign(spark, sf):
    """Every stored vector with its cell, and whether that is the nearest of all centres, recomputed by expressions."""
    stored = _stored(spark, sf)
    centers = ivf.train_cells(stored, NLIST)
    cells = cut_lineage(ivf.ivf_assign(stored, centers).select("chunk_id", "vector", "_cell"))
    distances = F.transform(_center_column(centers), lambda c: _distance(F.col("vector"), c))
    judged = cells.select("chunk_id", "_cell", distances.alias("d"))
    return judged.select(
        "chunk_id", F.col("_cell").between(0, len(centers) - 1).alias("known"),
        (F.get("d", F.col("_cell")) <= F.array_min("d") + 1e-4).alias("is_nearest"),
    )


def _cells(spark, sf):
    stored = _stored(spark, sf)
    centers = ivf.train_cells(stored, NLIST)
    return ivf.write_cells(ivf.ivf_assign(stored, centers), scratch_path(spark, "cells")), centers


@query("ivf_search", f"""
WITH {I.CENTROID_CTE}
SELECT CAST(query_id AS BIGINT) AS query_id, 5::BIGINT AS n_hits, true AS ranks_whole, true AS scores_exact, true AS all_probed, true AS in_order FROM q""")
def ivf_search(spark, sf):
    """Approximate, 4 of 16 cells probed; per query what the contract promises, recomputed by expressions."""
    cells, centers = _cells(spark, sf)
    queries = cut_lineage(I.centroid_queries(spark, sf))
    hits = ivf.ivf_search(queries, cells, centers, 5, 4, output=[])
    asked = queries.select("query_id", F.col("vector").alias("asked"))
    near = F.transform(_center_column(centers), lambda c, i: F.struct(_distance(F.col("asked"), c).alias("d"), i.alias("cell")))
    probed = F.transform(F.slice(F.array_sort(near), 1, 4), lambda x: x["cell"])
    # two cells within the rounding of the fourth may change places
    fourth = F.element_at(F.array_sort(near), 4)["d"]
    judged = hits.join(asked, "query_id").join(cells.select("chunk_id", "vector", "_cell"), "chunk_id").select(
        "query_id", "rank", "score", (F.abs(_distance(F.col("asked"), F.col("vector")) - F.col("score")) < 1e-6).alias("exact"),
        (F.array_contains(probed, F.col("_cell")) | (F.get(near, F.col("_cell"))["d"] <= fourth + 1e-4)).alias("probed"),
    )
    return judged.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), (F.sort_array(F.collect_list("rank")) == F.sequence(F.lit(1), F.count("*").cast("int"))).alias("ranks_whole"),
        F.bool_and("exact").alias("scores_exact"), F.bool_and("probed").alias("all_probed"),
        (F.array_sort(F.collect_list("score")) == F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])).alias("in_order"),
    ).withColumn("query_id", F.col("query_id").cast("bigint"))


@query("ivf_search_all_cells", _topk_sql(5))
def ivf_search_all_cells(spark, sf):
    """All cells probed, which must give the exact result."""
    cells, centers = _cells(spark, sf)
    hits = ivf.ivf_search(I.centroid_queries(spark, sf), cells, centers, 5, NLIST, output=["doc_id", "content"])
    return _shown(S.project_hits(hits, include_metadata=False))


@query("ivf_search_dirty", _topk_sql(5, where=SOUND))
def ivf_search_dirty(spark, sf):
    """Cells trained and filled from a table with unsound vectors; all of them probed by a query set that is mostly unsound."""
    queries, stored = _dirty(spark, sf)
    stored = cut_lineage(stored)
    centers = ivf.train_cells(stored, NLIST)
    cells = ivf.write_cells(ivf.ivf_assign(stored, centers), scratch_path(spark, "cells"))
    hits = ivf.ivf_search(cut_lineage(queries), cells, centers, 5, NLIST, output=["doc_id", "content"])
    return _shown(S.project_hits(hits, include_metadata=False))


@query("vector_topk_bounded", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, * FROM ({_topk_sql(10, s, d)})" for m, s, d in (("L2", SQUARED, "ASC"), ("IP", DOT, "DESC"))
))
def vector_topk_bounded(spark, sf):
    """Exact search that passes over the cells whose centre and radius rule out a better hit."""
    cells, centers = _cells(spark, sf)
    radii = np.array([r for r, _ in ivf.cell_sizes(cells, centers)])
    queries, found = cut_lineage(I.centroid_queries(spark, sf)), []
    for metric in ("L2", "IP"):
        hits = ivf.bounded_search(queries, cells, centers, radii, 10, metric, output=["doc_id", "content"])
        found.append(_shown(S.project_hits(hits, include_metadata=False)).select(F.lit(metric).alias("metric"), "*"))
    return found[0].unionByName(found[1])


LABEL_CELLS_CTE = f"""
{I.CENTROID_CTE}, {I.CHUNK_CTE},
near AS (SELECT chunk_id, query_id AS cell, row_number() OVER (PARTITION BY chunk_id ORDER BY {SQUARED}, query_id) AS n FROM c, q),
cells AS (SELECT chunk_id, cell FROM near WHERE n = 1)"""


def _label_centers(spark, sf):
    """The mean vector of every label as cell centres, ordered by label: known cells, so SQL can follow."""
    rows = I.centroid_queries(spark, sf).orderBy("query_id").collect()
    return np.array([r["vector"] for r in rows], dtype=np.float32)


@query("ivf_assign_label_cells", f"WITH {LABEL_CELLS_CTE} SELECT chunk_id, CAST(cell AS BIGINT) AS cell FROM cells")
def ivf_assign_label_cells(spark, sf):
    return ivf.ivf_assign(_stored(spark, sf), _label_centers(spark, sf)).select("chunk_id", I.big("_cell").alias("cell"))


@query("ivf_search_label_cells", f"""
WITH {LABEL_CELLS_CTE},
probes AS (SELECT a.query_id, b.query_id AS cell, row_number() OVER (PARTITION BY a.query_id
   ORDER BY list_distance(CAST(a.qv AS DOUBLE[]), CAST(b.qv AS DOUBLE[])), b.query_id) AS n FROM q a, q b),
scored AS (SELECT q.query_id, chunk_id, {SQUARED} AS s FROM c JOIN cells USING (chunk_id) JOIN probes p USING (cell)
           JOIN q ON q.query_id = p.query_id WHERE p.n <= 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, chunk_id) AS rank FROM scored)
SELECT CAST(query_id AS BIGINT) AS query_id, rank, chunk_id, round(s, 6) AS score FROM ranked WHERE rank <= 20""")
def ivf_search_label_cells(spark, sf):
    """4 of the label cells probed by every query."""
    centers = _label_centers(spark, sf)
    cells = ivf.write_cells(ivf.ivf_assign(_stored(spark, sf), centers), scratch_path(spark, "cells"))
    hits = ivf.ivf_search(I.centroid_queries(spark, sf), cells, centers, 20, 4, output=[])
    return hits.select("query_id", I.big("rank").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query("text_search", f"""
WITH {FIXED_CTE},
src AS (SELECT concat('d', doc_id, '_', i) AS id, content AS text FROM fixed UNION ALL SELECT concat('q', item_id), text FROM benchmark),
{bag_of_words_ctes('src', 'id', 384)},
norms AS (SELECT id, sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS sq FROM v GROUP BY id),
dots AS (SELECT q.id AS qid, d.id AS did, sum(CAST(q.x AS DOUBLE) * CAST(d.x AS DOUBLE)) AS dot
         FROM v q JOIN v d USING (dim) WHERE starts_with(q.id, 'q') AND starts_with(d.id, 'd') GROUP BY ALL),
scored AS (SELECT qid, nq.sq + nd.sq - 2 * dot AS s FROM dots JOIN norms nq ON nq.id = qid JOIN norms nd ON nd.id = did),
ranked AS (SELECT qid, s, row_number() OVER (PARTITION BY qid ORDER BY s) AS rank FROM scored)
SELECT CAST(substr(qid, 2) AS BIGINT) AS query_id, rank, round(s, 5) AS score FROM ranked WHERE rank <= 5""")
def text_search(spark, sf):
    """Benchmark passages as text queries over the embedded chunks of all documents."""
    chunks = C.chunk_fixed(I.documents(spark, sf))
    loader = E.hashed_bag_of_words()
    stored = collection_rows(E.embed_chunks(chunks.withColumn("content_type", F.lit("text")), loader))
    queries = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = S.text_search(queries, stored, loader, k=5, include_metadata=False, dimension=384)
    return hits.select("query_id", I.big("rank").alias("rank"), F.round("score", 5).alias("score"))
