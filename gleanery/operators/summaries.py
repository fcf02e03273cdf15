"""Aggregations over chunks and jobs. Lists are long tables, so they have one shape at every size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.embedding import is_sound

_BLOCK = 1024


def collection_stats(
    chunks: DataFrame, dimension: int, index_type: str = "IVF_FLAT", metric_type: str = "L2", approximate: bool = False
) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return stats_row(chunks.agg(F.count("*").alias("chunks"), distinct("doc_id").alias("documents")), dimension, index_type, metric_type)


def stats_row(counts: DataFrame, dimension: int, index_type: str = "IVF_FLAT", metric_type: str = "L2") -> DataFrame:
    """Counts of chunks and documents with what describes the collection."""
    return counts.select(
        "chunks", "documents",
        F.lit(dimension).alias("dimension"), F.lit(index_type).alias("index_type"), F.lit(metric_type).alias("metric_type"),
    )


def chunks_in_order(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("doc_id", "chunk_index", "chunk_id")


def reassemble_documents(chunks: DataFrame) -> DataFrame:
    """Content of every document: chunks by index, joined by a blank line.

    Chunks are first joined in blocks of neighbours, in one scan, so no task gathers
    all the rows of a very long document.
    """
    rows = chunks.select(
        "doc_id", F.col("metadata.chunk_index").alias("index"), "chunk_id", "content", "content_type", "metadata"
    )
    key = F.struct("index", "chunk_id")

    def joined(df: DataFrame, *keys: str) -> DataFrame:
        texts = F.array_sort(F.collect_list(F.struct("index", "chunk_id", "content")))
        return df.groupBy(*keys).agg(
            F.array_join(F.transform(texts, lambda t: t.getField("content")), "\n\n").alias("content"),
            F.min("index").alias("index"),
            F.min_by("chunk_id", key).alias("chunk_id"),
            F.min_by("content_type", key).alias("content_type"),
            F.min_by("metadata", key).alias("metadata"),
            F.sum("_n").alias("_n"),
        )

    rows = rows.withColumn("_n", F.lit(1).cast("bigint")).withColumn("_block", F.floor(F.coalesce("index", F.lit(0)) / _BLOCK))
    blocks = joined(rows, "doc_id", "_block").drop("_block")
    return joined(blocks, "doc_id").select("doc_id", "content", "content_type", "metadata", F.col("_n").alias("n_chunks"))


def ingest_results(chunks: DataFrame, dimension: int) -> DataFrame:
    """Every chunk of every document in a long table, and whether the store accepts it."""
    return chunks.select("doc_id", "chunk_index", "chunk_id", is_sound(F.col("vector"), dimension).alias("accepted"))


def _per_document(log: DataFrame) -> DataFrame:
    """Documents of a job once each, which also spreads a job with very many of them."""
    return log.groupBy("job_id", "document_id").agg(F.max("error").alias("error"))


def ingest_job_summary(log: DataFrame) -> DataFrame:
    """One row per job: status and message; any error fails the job.

    ``log`` has job_id, document_id, error (null when fine).
    """
    counted = _per_document(log).groupBy("job_id").agg(F.count("document_id").alias("_documents"), F.max("error").alias("error"))
    fine = F.col("error").isNull()
    return counted.select(
        "job_id",
        F.when(fine, "completed").otherwise("failed").alias("status"),
        F.when(fine, F.format_string("Ingested %d documents", "_documents")).otherwise(F.col("error")).alias("message"),
    )


def ingest_job_documents(log: DataFrame) -> DataFrame:
    """(job_id, document_id) of all jobs without an error; a failed job has none."""
    documents = _per_document(log)
    failed = documents.where("error IS NOT NULL").select("job_id").distinct()
    return documents.where("document_id IS NOT NULL").join(failed, "job_id", "left_anti").select("job_id", "document_id")
