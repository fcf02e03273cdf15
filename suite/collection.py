"""The stored collection (A8, B1, B2, B4-B6, G1, G2, I3, O4)."""

from pyspark.sql import functions as F

from gleanery.operators import summaries as G
from gleanery.operators.validation import validate_rows
from gleanery.session import scratch_path
from gleanery.sources.collection import Collection, collection_rows
from suite import inputs as I
from suite import query
from suite.search import FILTERS, FILTERS_SQL, _shown as shown_hits, _topk_sql


def stored(spark, sf, **options) -> Collection:
    """A fresh collection in the shared folder holding all embeddings."""
    collection = Collection(spark, scratch_path(spark, "collection"), I.DIMENSION).create()
    collection.append(I.vector_chunks(spark, sf), **options)
    return collection


def _shown(rows):
    return rows.select(
        "doc_id", "chunk_id", "content", "content_type", "embedding_model", "metadata.source",
        I.big("metadata.chunk_index").alias("chunk_index"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vector_sum"),
    )


SHOWN = "doc_id, chunk_id, content, content_type, 'minilm' AS embedding_model, source, CAST(chunk_index AS BIGINT) AS chunk_index, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vector_sum"


@query("append_chunks", f"""
WITH {I.CHUNK_CTE} SELECT coalesce(CASE WHEN vec_id % 9 <> 0 THEN doc_id END, '') AS doc_id, chunk_id, content, content_type,
  'minilm' AS embedding_model, source, CAST(chunk_index AS BIGINT) AS chunk_index, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vector_sum
FROM c WHERE vec_id % 10 <> 0 AND content_type IN ('python', 'text')""")
def append_chunks(spark, sf):
    """Some vectors too short, some document ids missing, one content type not admitted; read back."""
    chunks = I.vector_chunks(spark, sf).withColumn(
        "vector", F.expr("CASE WHEN vec_id % 10 = 0 THEN slice(vector, 1, 63) ELSE vector END")
    ).withColumn("doc_id", F.expr("CASE WHEN vec_id % 9 <> 0 THEN doc_id END"))
    collection = Collection(spark, scratch_path(spark, "collection"), I.DIMENSION).create()
    collection.append(chunks, embedding_model="minilm", content_types=["python", "text"])
    return _shown(collection.read())


@query("append_documents", f"""
WITH {I.CHUNK_CTE}, d AS (SELECT doc_id, count(*) FILTER (vec_id % 2 = 0) AS n_stored FROM c GROUP BY doc_id)
SELECT doc_id, n_stored FROM d""")
def append_documents(spark, sf):
    """Documents with nested chunks, every second vector missing: all ids come back, only valid chunks are stored."""
    c = I.vector_chunks(spark, sf).withColumn("vector", F.expr("CASE WHEN vec_id % 2 = 0 THEN vector END"))
    documents = c.groupBy("doc_id").agg(
        F.min("content_type").alias("content_type"), F.min("source").alias("source"),
        F.collect_list(F.struct("chunk_id", "content", "vector", "chunk_index")).alias("chunks"),
    )
    collection = Collection(spark, scratch_path(spark, "collection"), I.DIMENSION).create()
    ids = collection.append_documents(documents)
    counts = collection.read().groupBy("doc_id").agg(F.count("*").alias("n"))
    return ids.join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_stored"))


@query("scan_collection", f"WITH {I.CHUNK_CTE} SELECT doc_id, chunk_id, content FROM c WHERE content_type = 'python' AND doc_id LIKE 'doc1%'")
def scan_collection(spark, sf):
    return stored(spark, sf).scan(F.col("doc_id").like("doc1%"), ["doc_id", "chunk_id", "content"], {"content_type": "python"})


@query("create_collection", "SELECT (SELECT count(*) FROM embeddings) AS kept, CAST(0 AS BIGINT) AS after_drop, CAST(9 AS BIGINT) AS n_columns")
def create_collection(spark, sf):
    """Creating an existing collection keeps it; ``drop_old`` replaces it."""
    collection = stored(spark, sf)
    kept = collection.create().read().agg(F.count("*").alias("kept")).first()["kept"]
    columns = len(collection.read().columns)
    dropped = collection.create(drop_old=True).read()
    return dropped.agg(F.count("*").alias("after_drop")).select(
        F.lit(kept).cast("bigint").alias("kept"), "after_drop", F.lit(columns).cast("bigint").alias("n_columns")
    )


@query("delete_document", f"""
WITH {I.CHUNK_CTE} SELECT 'row' AS kind, chunk_id AS id, true AS flag FROM c WHERE label <> 3
UNION ALL SELECT DISTINCT 'asked', doc_id, true FROM (SELECT concat('label', label) AS doc_id FROM embeddings WHERE label = 3)
UNION ALL SELECT 'asked', 'no such document', false""")
def delete_document(spark, sf):
    """Delete one of ten documents that hold everything, and one that does not exist."""
    collection = Collection(spark, scratch_path(spark, "collection"), I.DIMENSION).create()
    collection.append(I.vector_chunks(spark, sf).withColumn("doc_id", F.concat(F.lit("label"), "label")))
    asked = spark.createDataFrame([("label3",), ("no such document",)], "doc_id string")
    outcome = collection.delete(asked)
    return collection.read().select(F.lit("row").alias("kind"), F.col("chunk_id").alias("id"), F.lit(True).alias("flag")).unionByName(
        outcome.select(F.lit("asked").alias("kind"), F.col("doc_id").alias("id"), F.col("deleted").alias("flag"))
    )


@query("clear_collection", "SELECT (SELECT count(*) FROM embeddings) AS before, CAST(0 AS BIGINT) AS after")
def clear_collection(spark, sf):
    collection = stored(spark, sf)
    before = collection.read().count()
    collection.clear()
    return collection.read().agg(F.count("*").alias("after")).select(F.lit(before).cast("bigint").alias("before"), "after")


DYNAMIC_WHERE = "label IN (3, 4) AND vec_id % 2 = 0 AND vec_id * 0.5 <> 6 AND doc_id <> 'doc7'"


@query("filter_dynamic", f"SELECT 'scan' AS way, chunk_id, NULL::BIGINT AS rank FROM (WITH {I.CHUNK_CTE} SELECT chunk_id FROM c WHERE {DYNAMIC_WHERE}) "
       f"UNION ALL SELECT 'search', id, rank FROM ({_topk_sql(4, where=DYNAMIC_WHERE)})")  # fmt: skip
def filter_dynamic(spark, sf):
    """Filters on keys that no schema names, of numbers, strings and booleans, in a scan and before a search."""
    fields = F.expr("named_struct('label', label, 'parity', IF(vec_id % 2 = 0, 'even', 'odd'), 'it\\'s seven', doc_id = 'doc7', 'half', vec_id * 0.5D)")
    collection = Collection(spark, scratch_path(spark, "collection"), I.DIMENSION, dynamic=True).create()
    collection.append(I.vector_chunks(spark, sf).withColumn("dynamic", fields))
    wanted = {"label": [3, 4.0, "4"], "parity": "even", "it's seven": False}
    other = F.expr("try_variant_get(dynamic, '$.half', 'double') <> 6")
    rows = collection.scan(other, ["chunk_id"], wanted).select(F.lit("scan").alias("way"), "chunk_id", F.lit(None).cast("bigint").alias("rank"))
    queries = I.centroid_queries(spark, sf)
    found = Collection(spark, scratch_path(spark, "collection"), I.DIMENSION, dynamic=True).create()
    found.append(collection.scan(other))
    hits = found.search(queries, k=4, filters=wanted, include_metadata=False)
    return rows.unionByName(hits.select(F.lit("search").alias("way"), F.col("id").alias("chunk_id"), I.big("rank").alias("rank")))


def _with_cells(spark, sf) -> Collection:
    """Cells over most rows; then more rows, a deleted document, and a batch written again with fewer rows."""
    chunks = I.vector_chunks(spark, sf)
    collection = Collection(spark, scratch_path(spark, "collection"), I.DIMENSION).create()
    collection.append(chunks.where("vec_id % 10 < 5"), batch="first")
    collection.append(chunks.where("vec_id % 10 IN (5, 6)"), batch="second")
    collection.build_cells(8)
    collection.append(chunks.where("vec_id % 10 IN (7, 8)"), batch="third")
    collection.delete_document("doc7")
    collection.append(chunks.where("vec_id % 10 = 5"), batch="second")
    return collection


CELLS_WHERE = "vec_id % 10 NOT IN (6, 9) AND doc_id <> 'doc7'"


@query("collection_cells", f"SELECT 'bounds' AS way, * FROM ({_topk_sql(5, where=CELLS_WHERE)}) UNION ALL "
       f"SELECT 'cells', * FROM ({_topk_sql(7, where=f'{CELLS_WHERE} AND {FILTERS_SQL}')})")  # fmt: skip
def collection_cells(spark, sf):
    """The stored cells with what changed after they were built: all cells probed, and exact search by their bounds."""
    collection, queries = _with_cells(spark, sf), I.centroid_queries(spark, sf)
    bounds = collection.search(queries, using="bounds", k=5, include_metadata=False)
    cells = collection.search(queries, using="cells", nprobe=8, k=7, filters=FILTERS, include_metadata=False)
    return shown_hits(bounds).select(F.lit("bounds").alias("way"), "*").unionByName(shown_hits(cells).select(F.lit("cells").alias("way"), "*"))


@query("collection_versions", f"""
WITH {I.CHUNK_CTE}, v AS (
  SELECT 1 AS version, vec_id, doc_id, chunk_id FROM c WHERE false
  UNION ALL SELECT 2, vec_id, doc_id, chunk_id FROM c WHERE vec_id % 3 <> 0
  UNION ALL SELECT 3, vec_id, doc_id, chunk_id FROM c WHERE vec_id % 3 <> 0 AND doc_id <> 'doc7'
  UNION ALL SELECT 4, vec_id, doc_id, chunk_id FROM c WHERE vec_id % 3 = 1 AND doc_id <> 'doc7'
) SELECT CAST(version AS BIGINT) AS version, doc_id, chunk_id FROM v""")
def collection_versions(spark, sf):
    """Every version as a reader that is pinned to it sees it: created, filled, a document deleted, the batch written again."""
    chunks = I.vector_chunks(spark, sf)
    collection = Collection(spark, scratch_path(spark, "collection"), I.DIMENSION).create()
    collection.append(chunks.where("vec_id % 3 <> 0"), batch="a/b: 1")
    collection.delete_document("doc7")
    collection.append(chunks.where("vec_id % 3 = 1"), batch="a/b: 1")
    seen = [collection.at(v).read().select(F.lit(v).cast("bigint").alias("version"), "doc_id", "chunk_id") for v in collection.versions.numbers()]
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])


@query("collection_stats", f"""
WITH {I.CHUNK_CTE} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, CAST(64 AS BIGINT) AS dimension,
 'IVF_FLAT' AS index_type, 'L2' AS metric_type FROM c""")
def collection_stats(spark, sf):
    return G.collection_stats(collection_rows(I.vector_chunks(spark, sf)), I.DIMENSION).withColumn("dimension", I.big("dimension"))


@query("collection_sketches", f"""
WITH {I.CHUNK_CTE}, k AS (SELECT * FROM c WHERE vec_id % 10 NOT IN (6, 9) AND doc_id <> 'doc7' OR vec_id % 10 = 9 AND doc_id = 'doc7')
SELECT count(*) AS chunks, count(DISTINCT doc_id) AS exact_documents, true AS close FROM k""")
def collection_sketches(spark, sf):
    """Counts from stored sketches after deletions, a batch written again, and rows that come back; no row is read for them."""
    chunks = I.vector_chunks(spark, sf)
    collection = _with_cells(spark, sf)
    collection.append(chunks.where("vec_id % 10 = 9 AND doc_id = 'doc7'"))
    exact = collection.stats().select(F.col("documents").alias("exact_documents"))
    close = F.abs(F.col("documents") - F.col("exact_documents")) <= 0.05 * F.col("exact_documents")
    return collection.stats(approximate=True).join(exact, F.lit(True)).select("chunks", "exact_documents", close.alias("close"))


@query("reassemble_document", f"""
WITH {I.CHUNK_CTE} SELECT doc_id, string_agg(content, concat(chr(10), chr(10)) ORDER BY chunk_index, chunk_id) AS content,
 arg_min(source, chunk_index) AS source, count(*) AS n_chunks FROM c GROUP BY doc_id""")
def reassemble_document(spark, sf):
    return stored(spark, sf).documents().select("doc_id", "content", "metadata.source", "n_chunks")


@query("chunks_in_order", f"""
WITH {I.CHUNK_CTE} SELECT row_number() OVER (ORDER BY doc_id, chunk_index, chunk_id) AS position, chunk_id FROM c""")
def chunks_in_order(spark, sf):
    """The order, made visible as a position."""
    from gleanery.operators.ordering import global_rank

    ordered = G.chunks_in_order(I.vector_chunks(spark, sf).select("doc_id", "chunk_index", "chunk_id"))
    ranked = global_rank(ordered, [F.asc("doc_id"), F.asc("chunk_index"), F.asc("chunk_id")], "position")
    return ranked.select(I.big("position").alias("position"), "chunk_id")


@query("validate_rows", """
SELECT doc_id, concat_ws(',', CASE WHEN strlen(text) > 65535 THEN 'content_too_long' END,
  CASE WHEN strlen(concat(source, substr(text, 1, 45))) > 50 THEN 'content_type_too_long' END) AS reasons FROM documents""")
def validate_rows_query(spark, sf):
    rows = I.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("c").alias("chunk_id"), F.col("text").alias("content"),
        F.concat("source", F.substring("text", 1, 45)).alias("content_type"), F.lit("m").alias("embedding_model"),
    )
    return validate_rows(rows).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.array_join("reasons", ",").alias("reasons"))
