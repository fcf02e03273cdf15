"""Ingest sources: rows with url, file_path or content, and a content type."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.content_types import ExtractorRegistry, extension_to_mime, infer_document_type, type_of_mime
from gleanery.functions.html import html_to_text, page_description, page_language, page_title
from gleanery.functions.metadata import attach_metadata
from gleanery.functions.urls import document_id
from gleanery.schema import DEFAULT_LANGUAGE


def default_extractors() -> ExtractorRegistry:
    registry = ExtractorRegistry()
    registry.register("text/html", html_to_text)
    return registry


def direct_documents(sources: DataFrame, extra=None) -> DataFrame:
    """Documents from inline content. A supplied ``doc_id`` is kept, else it is derived.

    Input columns: content, content_type and optionally doc_id, source, extra.
    """
    columns = set(sources.columns)
    source = F.coalesce(F.col("source"), F.lit("direct_content")) if "source" in columns else F.lit("direct_content")
    derived = document_id(F.concat_ws("#", source, F.sha2("content", 256)))
    given = F.col("doc_id").cast("string") if "doc_id" in columns else F.lit(None).cast("string")
    own = F.col("extra") if "extra" in columns else F.create_map().cast("map<string,string>")
    return sources.where(F.col("content").isNotNull()).select(
        F.coalesce(given, derived).alias("doc_id"),
        source.alias("source"),
        type_of_mime(F.col("content_type")).alias("content_type"),
        F.col("content"),
        (own if extra is None else attach_metadata(own, extra)).alias("extra"),
    )


def file_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One document per file, typed by extension. Spark lists and reads the files."""
    files = spark.read.text(paths, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    mime = extension_to_mime(F.col("path"))
    return files.select(
        document_id(F.col("path")).alias("doc_id"),
        F.col("path").alias("source"),
        type_of_mime(mime).alias("content_type"),
        F.col("value").alias("content"),
        F.create_map().cast("map<string,string>").alias("extra"),
    )


def page_documents(results: DataFrame, extractors: ExtractorRegistry | None = None) -> DataFrame:
    """Documents from successful crawl results (see ``responses.crawl_results``), with what is known of the page.

    HTML becomes text and gives title, description and language; of other types the
    language is the default. Sitemap fields are there if the results have them (see
    ``discovery.join_sitemap_metadata``), the time of crawling if they have ``fetched_at``.
    """
    extractors = extractors or default_extractors()
    have = set(results.columns)
    html = F.lower("content_type").contains("text/html")
    filled = lambda value: F.when(html & (value != ""), value)
    kept = [c for c in ("sitemap_lastmod", "sitemap_changefreq", "sitemap_priority", "images", "videos", "source_type") if c in have]
    return results.where((F.col("status") == 200) & F.col("error").isNull()).select(
        document_id(F.col("url")).alias("doc_id"),
        F.col("url").alias("source"),
        infer_document_type(F.col("content_type"), F.col("url")).alias("content_type"),
        extractors.extract(F.col("content_type"), F.col("body")).alias("content"),
        filled(page_title(F.col("body"))).alias("title"),
        filled(page_description(F.col("body"))).alias("description"),
        F.coalesce(filled(page_language(F.col("body"))), F.lit(DEFAULT_LANGUAGE)).alias("language"),
        F.col("status").cast("int").alias("status_code"),
        *([F.col("fetched_at").cast("timestamp").alias("last_crawled")] if "fetched_at" in have else []),
        *kept,
        F.create_map().cast("map<string,string>").alias("extra"),
    )


def drop_original(documents: DataFrame, store_original: bool | Column = True) -> DataFrame:
    """Remove the whole text once it has been chunked, where it is not to be stored."""
    stored = store_original if isinstance(store_original, Column) else F.lit(store_original)
    return documents.withColumn("content", F.when(stored, F.col("content")))
