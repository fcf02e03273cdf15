"""Ingest sources, jobs, validation and streams (A1, A2, G4, G5, M, O1-O3)."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from gleanery.operators import summaries as G
from gleanery.operators import validation as V
from gleanery.plans.ingest import ingest_documents, ingest_requests
from gleanery.session import scratch_path
from gleanery.sources import direct as D
from gleanery.sources.collection import Collection
from gleanery.streaming import ingest as M
from suite import inputs as I
from suite import query
from suite.chunks import DOCS_CTE
from suite.splitter_sql import splitter_query

from gleanery import schema


@query("source_direct", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' ELSE 'text' END AS content_type,
       md5(text) AS content_md5, 'alpha' AS project FROM documents""")
def source_direct(spark, sf):
    sources = I.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("content"), "source",
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'Python' ELSE 'application/x-unknown' END").alias("content_type"),
    )
    docs = D.direct_documents(sources, F.create_map(F.lit("project"), F.lit("alpha")))
    return docs.select("doc_id", "source", "content_type", F.md5("content").alias("content_md5"), F.col("extra")["project"].alias("project"))


@query("source_files", """
SELECT doc_id // 500 AS block, 'text' AS content_type, md5(string_agg(concat(text, chr(10)), '' ORDER BY doc_id)) AS content_md5
FROM documents GROUP BY doc_id // 500""")
def source_files(spark, sf):
    """The documents as text files of at most 500 documents, read back as whole files."""
    path = scratch_path(spark, "files")
    blocks = I.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 500).alias("block"), "doc_id", F.col("text").alias("value"))
    blocks.repartition("block").sortWithinPartitions("block", "doc_id").drop("doc_id").write.partitionBy("block").text(path)
    docs = D.file_documents(spark, path)
    return docs.select(
        F.regexp_extract("source", "block=([0-9]+)", 1).cast("bigint").alias("block"), "content_type", F.md5("content").alias("content_md5")
    )


@query("ingest_results", f"""
WITH {I.CHUNK_CTE} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_id, vec_id % 4 <> 0 AS accepted FROM c""")
def ingest_results(spark, sf):
    chunks = I.vector_chunks(spark, sf).withColumn("vector", F.expr("CASE WHEN vec_id % 4 <> 0 THEN vector END"))
    return G.ingest_results(chunks, I.DIMENSION).withColumn("chunk_index", I.big("chunk_index"))


def _job_log(spark, sf):
    return I.table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id"), F.to_date("ts")).alias("job_id"),
        F.col("event_id").cast("string").alias("document_id"),
        F.when(F.col("event_type") == "error", "could not read source").alias("error"),
    )


@query("ingest_job_summary", """
WITH e AS (SELECT concat(user_id, '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS job_id, event_id, event_type = 'error' AS bad FROM events)
SELECT job_id, CASE WHEN bool_or(bad) THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN bool_or(bad) THEN 'could not read source' ELSE concat('Ingested ', count(DISTINCT event_id), ' documents') END AS message
FROM e GROUP BY job_id""")
def ingest_job_summary(spark, sf):
    """A user's events of one day as one job; an error event fails it."""
    return G.ingest_job_summary(_job_log(spark, sf))


@query("ingest_job_documents", """
WITH e AS (SELECT concat(user_id, '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS job_id, event_id, event_type = 'error' AS bad FROM events),
f AS (SELECT DISTINCT job_id FROM e WHERE bad)
SELECT DISTINCT job_id, CAST(event_id AS VARCHAR) AS document_id FROM e WHERE job_id NOT IN (SELECT job_id FROM f)""")
def ingest_job_documents(spark, sf):
    return G.ingest_job_documents(_job_log(spark, sf))


@query("ingest_one_job", """
SELECT 'all' AS job_id, 'completed' AS status, concat('Ingested ', count(DISTINCT l_orderkey * 10 + l_linenumber), ' documents') AS message FROM lineitem""")
def ingest_one_job(spark, sf):
    """All lines of all orders as the documents of one job, which is one row whatever its size."""
    lines = I.table(spark, sf, "lineitem").select(
        F.lit("all").alias("job_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("document_id"),
        F.lit(None).cast("string").alias("error"),
    )
    return G.ingest_job_summary(lines)


CHUNKED_SQL = splitter_query(DOCS_CTE, "docs", schema.TEXT_SEPARATORS, 1000, 200)
STORED_SQL = f"SELECT concat(doc_id, '_chunk_', chunk_index) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, content_md5 FROM ({CHUNKED_SQL})"


def _as_documents(frame):
    return frame.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), "source",
        F.lit("text").alias("content_type"),
    )


def _stored_chunks(collection):
    return collection.read().select("chunk_id", "doc_id", F.md5("content").alias("content_md5"))


@query("ingest_documents", STORED_SQL)
def ingest_documents_query(spark, sf):
    """Whole batch plan: documents -> chunks -> vectors -> collection, read back."""
    collection = Collection(spark, scratch_path(spark, "collection")).create()
    ingest_documents(_as_documents(I.spread(I.table(spark, sf, "documents"))), collection, "job-1")
    return _stored_chunks(collection)


@query("ingest_requests", f"""
WITH h AS (SELECT {I.HOST} AS job_id, bool_or({I.PAGE_STATUS} <> 200) AS bad, count(*) AS n FROM pages GROUP BY 1),
d AS (SELECT source AS job_id, count(DISTINCT text) AS n FROM documents GROUP BY 1)
SELECT job_id, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN bad THEN 'status 404' ELSE concat('Ingested ', n, ' documents') END AS message FROM h
UNION ALL SELECT job_id, 'completed', concat('Ingested ', n, ' documents') FROM d""")
def ingest_requests_query(spark, sf):
    """Pages by URL, one job per host, and documents as direct content, one job per source."""
    none = F.lit(None).cast("string")
    urls = I.table(spark, sf, "pages").select(F.expr(I.HOST).alias("job_id"), "url", none.alias("content"))
    texts = I.table(spark, sf, "documents").select(F.col("source").alias("job_id"), none.alias("url"), F.col("text").alias("content"))
    sources = urls.unionByName(texts).select(
        "job_id", "url", none.alias("file_path"), "content", none.alias("content_type"), F.lit(1000).alias("chunk_size"),
        F.lit(200).alias("chunk_overlap"), F.lit(None).cast("int").alias("max_tokens"), F.create_map(F.lit("by"), F.lit("suite")).alias("metadata"),
    )
    files = spark.createDataFrame([], "source string, content string, content_type string")
    collection = Collection(spark, scratch_path(spark, "collection")).create()
    log = ingest_requests(I.spread(sources), I.page_responses(spark, sf).drop("page_id"), files, collection)
    return G.ingest_job_summary(log).select("job_id", "status", "message")


_THIRD = "docs AS (SELECT doc_id, 0 AS section_index, text FROM documents WHERE doc_id % 3 = 0)"


@query("ingest_request_options", f"""
WITH d AS (SELECT doc_id, text, 300 + 100 * (doc_id % 5) AS size, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ts, 40 + doc_id % 7 AS m FROM documents),
fixed AS (SELECT i, substr(text, CAST(i * (size - 50) + 1 AS BIGINT), size) AS content
  FROM d, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / (size - 50.0)) AS BIGINT), 1))) AS g(i) WHERE doc_id % 3 = 1 AND text <> ''),
tokens AS (SELECT i, array_to_string(ts[i * m + 1 : (i + 1) * m], ' ') AS content
  FROM d, unnest(range(0, CAST(ceil(len(ts) / CAST(m AS DOUBLE)) AS BIGINT))) AS g(i) WHERE doc_id % 3 = 2),
recursive_ AS ({splitter_query(_THIRD, "docs", schema.TEXT_SEPARATORS, 1000, 200)})
SELECT 'chunk' AS kind, CAST(chunk_index AS BIGINT) AS chunk_index, content_md5 FROM recursive_
UNION ALL SELECT 'chunk', i, md5(content) FROM fixed UNION ALL SELECT 'chunk', i, md5(content) FROM tokens
UNION ALL SELECT 'original', NULL, CASE WHEN doc_id % 2 = 0 THEN md5(text) END FROM documents""")
def ingest_request_options(spark, sf):
    """Every request with its own strategy, sizes, token limit and wish about the original; chunks and originals as stored."""
    none = F.lit(None).cast("string")
    i, text = F.col("doc_id"), I.table(spark, sf, "documents")
    sources = text.select(
        i.cast("string").alias("job_id"), none.alias("url"), none.alias("file_path"), F.col("text").alias("content"), none.alias("content_type"),
        F.when(i % 3 == 1, 300 + 100 * (i % 5)).alias("chunk_size"), F.when(i % 3 == 1, 50).alias("chunk_overlap"),
        F.when(i % 3 == 2, 40 + i % 7).alias("max_tokens"), F.when(i % 3 == 1, "fixed").alias("strategy"),
        F.when(i % 2 == 1, False).alias("store_original"), F.create_map(F.lit("by"), F.lit("suite")).alias("metadata"),
    )
    files = spark.createDataFrame([], "source string, content string, content_type string")
    collection, originals = Collection(spark, scratch_path(spark, "collection")).create(), scratch_path(spark, "originals")
    ingest_requests(I.spread(sources), I.page_responses(spark, sf).drop("page_id"), files, collection, originals=originals)
    chunks = collection.read().select(F.lit("chunk").alias("kind"), I.big("metadata.chunk_index").alias("chunk_index"), F.md5("content").alias("content_md5"))
    kept = spark.read.schema("content string").parquet(originals)
    return chunks.unionByName(kept.select(F.lit("original").alias("kind"), F.lit(None).cast("bigint").alias("chunk_index"), F.md5("content").alias("content_md5")))


@query("stream_ingest", STORED_SQL)
def stream_ingest(spark, sf):
    """The same plan as a stream, which must store the same chunks."""
    path = f"{sf}/documents.parquet"
    source = M.stream_table(spark, path, spark.read.parquet(path).schema)
    collection = Collection(spark, scratch_path(spark, "collection")).create()
    stream = M.stream_ingest(
        _as_documents(source), collection, scratch_path(spark, "job-log"), scratch_path(spark, "checkpoint"), "stream-1"
    )
    stream.awaitTermination()
    return _stored_chunks(collection)


@query("stream_seen_urls", "SELECT DISTINCT props AS url FROM events")
def stream_seen_urls(spark, sf):
    path = f"{sf}/events.parquet"
    source = M.stream_table(spark, path, spark.read.parquet(path).schema)
    out = scratch_path(spark, "seen")
    M.write_table(M.seen_urls(source.select(F.col("props").alias("url"))), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("url string").parquet(out)


@query("stream_seen_urls_watermark", "SELECT DISTINCT concat(user_id, '/', props) AS url FROM events")
def stream_seen_urls_watermark(spark, sf):
    """Bounded memory: the delay covers the table's whole time range, so the result is the same."""
    path = f"{sf}/events.parquet"
    source = M.stream_table(spark, path, spark.read.parquet(path).schema).select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", F.col("user_id"), F.col("props")).alias("url")
    )
    out = scratch_path(spark, "seen")
    M.write_table(M.seen_urls(source, "ts", "3650 days").select("url"), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("url string").parquet(out)


@contextmanager
def _rocksdb(spark):
    """The state store that streams with a state of their own need."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


@query("stream_seen_urls_cleared", """
WITH e AS (SELECT event_id, user_id % 7 AS scope, props AS url, event_id % 40 = 0 AS clear FROM events),
s AS (SELECT *, count(*) FILTER (clear) OVER (PARTITION BY scope ORDER BY event_id) AS epoch FROM e)
SELECT scope, url, min(event_id) AS at FROM s WHERE NOT clear AND url IS NOT NULL GROUP BY scope, url, epoch""")
def stream_seen_urls_cleared(spark, sf):
    """Every 40th event clears the memory of its scope; URLs are new again after it."""
    path = f"{sf}/events.parquet"
    source = M.stream_table(spark, path, spark.read.parquet(path).schema).select(
        (F.col("user_id") % 7).alias("scope"), F.col("props").alias("url"), F.col("event_id").alias("at"), (F.col("event_id") % 40 == 0).alias("clear")
    )
    out = scratch_path(spark, "seen")
    with _rocksdb(spark):
        M.write_table(M.seen_since_cleared(source), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("scope bigint, url string, at bigint").parquet(out)


@query("stream_job_progress", """
WITH e AS (SELECT concat(user_id, '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS job_id, event_id, event_type = 'error' AS bad FROM events),
j AS (SELECT job_id, bool_or(bad) AS bad, count(DISTINCT event_id) AS n FROM e GROUP BY job_id)
SELECT job_id, 'pending' AS status, CAST(0 AS BIGINT) AS n_documents, CAST(NULL AS VARCHAR) AS message FROM j
UNION ALL SELECT job_id, 'processing', n, NULL FROM j WHERE NOT bad
UNION ALL SELECT job_id, 'completed', n, concat('Ingested ', n, ' documents') FROM j WHERE NOT bad
UNION ALL SELECT job_id, 'failed', 0, 'could not read source' FROM j WHERE bad""")
def stream_job_progress(spark, sf):
    """All jobs are accepted, then their documents come, each twice, then their ends; every state on the way, the last one that of the summary."""
    log, folder, files = _job_log(spark, sf), scratch_path(spark, "events"), 4
    none = F.lit(None).cast("string")
    jobs = log.select("job_id").distinct()
    steps = [
        jobs.select("job_id", F.lit("accepted").alias("kind"), none.alias("document_id"), none.alias("error")),
        log.union(log).select("job_id", F.lit("document").alias("kind"), "document_id", "error"),
        jobs.select("job_id", F.lit("end").alias("kind"), none.alias("document_id"), none.alias("error")),
    ]
    for step in steps:
        step.repartition(files).write.mode("append").parquet(folder)
    source = M.stream_table(spark, folder, steps[0].schema, files_per_batch=files)
    out = scratch_path(spark, "trail")
    with _rocksdb(spark):
        M.write_table(M.job_progress(source), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("job_id string, status string, n_documents bigint, message string").parquet(out)


@query("stream_batches", """
SELECT 'completed' AS status, count(*) AS n_documents, CAST(ceil(count(DISTINCT doc_id // 100) / 4.0) AS BIGINT) AS n_batches FROM documents""")
def stream_batches(spark, sf):
    """Files of 100 documents, four files per micro-batch."""
    files = scratch_path(spark, "files")
    docs = I.table(spark, sf, "documents")
    blocks = docs.withColumn("block", F.floor(F.col("doc_id") / 100))
    blocks.repartition("block").write.partitionBy("block").parquet(files)
    collection = Collection(spark, scratch_path(spark, "collection")).create()
    log = scratch_path(spark, "job-log")
    source = M.stream_table(spark, files, docs.schema, files_per_batch=4)
    M.stream_ingest(_as_documents(source), collection, log, scratch_path(spark, "checkpoint"), "batches").awaitTermination()
    rows = spark.read.schema("job_id string, document_id string, error string, batch string").parquet(log)
    return rows.agg(
        F.when(F.bool_or(F.col("error").isNotNull()), "failed").otherwise("completed").alias("status"),
        F.count("document_id").alias("n_documents"), F.countDistinct("batch").alias("n_batches"),
    )


@query("validate_sources", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'exclusive' WHEN 1 THEN 'empty' ELSE '' END AS reasons FROM documents""")
def validate_sources(spark, sf):
    pick = lambda *rests: F.when((F.col("doc_id") % 4).isin(*rests), F.col("source"))
    sources = I.table(spark, sf, "documents").select(
        "doc_id", pick(0, 2).alias("url"), pick(0).alias("file_path"), F.when(F.col("doc_id") % 4 == 3, F.col("text")).alias("content")
    )
    return V.validate_sources(sources).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("validate_chunking", """
WITH r AS (SELECT doc_id, n_chars % 2300 AS s, doc_id % 600 AS o, doc_id % 3 AS t FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN s < 100 OR s > 2000 THEN 'chunk_size_range' END, CASE WHEN o > 500 THEN 'chunk_overlap_range' END,
  CASE WHEN t = 0 THEN 'max_tokens_positive' END, CASE WHEN o > s THEN 'overlap_exceeds_size' END) AS reasons FROM r""")
def validate_chunking(spark, sf):
    requests = I.table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 2300).alias("chunk_size"), (F.col("doc_id") % 600).alias("chunk_overlap"),
        (F.col("doc_id") % 3).alias("max_tokens"),
    )
    return V.validate_chunking(requests).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("validate_search", """
SELECT event_id, CASE WHEN user_id BETWEEN 1 AND 100 THEN 'accepted' ELSE 'k_range' END AS outcome FROM events""")
def validate_search(spark, sf):
    requests = I.table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"))
    accepted, rejected = V.split_valid(V.validate_search(requests))
    return accepted.select("event_id", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("event_id", F.array_join("reasons", ",").alias("outcome"))
    )
