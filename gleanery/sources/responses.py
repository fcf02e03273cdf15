"""Stored HTTP responses stand in for the network: url, status, content_type, body."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import file_extension, safe_filename
from gleanery.operators.ordering import top_n_per_group


def newest_responses(responses: DataFrame) -> DataFrame:
    """One response per URL: the newest by ``fetched_at`` where that column is there, then by its own values.

    Only keys are compared; the body breaks ties by its hash.
    """
    order = [F.desc_nulls_last("fetched_at")] if "fetched_at" in responses.columns else []
    order += [F.desc_nulls_last("status"), F.desc_nulls_last("content_type"), F.desc(F.xxhash64("body"))]
    return top_n_per_group(responses, ["url"], order, 1).drop("rank")


def crawl_results(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """One result per distinct URL, from its newest response; a URL without one gets status 0 and an error.

    The URL list is reduced before the join, so a URL repeated very often is
    one row by then, and responses nobody asked for are not ranked.
    """
    wanted = urls.select("url").distinct()
    known = newest_responses(responses.join(wanted, "url", "left_semi")).withColumn("_found", F.lit(True))
    return wanted.join(known, "url", "left").select(
        "url",
        F.coalesce("status", F.lit(0)).alias("status"),
        F.coalesce("content_type", F.lit("")).alias("content_type"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.when(F.col("_found").isNull(), "no response").alias("error"),
        *(["fetched_at"] if "fetched_at" in responses.columns else []),
    )


def crawl_success(results: DataFrame) -> DataFrame:
    return results.where((F.col("status") == 200) & F.col("error").isNull())


def named_pages(results: DataFrame, position: str = "position") -> DataFrame:
    """File name, extension and content of every result; of equal names the last stays."""
    named = results.select(
        safe_filename(F.col("url"), F.col(position)).alias("filename"),
        file_extension(F.col("content_type")).alias("ext"),
        F.col("body").alias("content"),
        F.col(position).alias("_p"),
    )
    return top_n_per_group(named, ["filename", "ext"], [F.desc("_p")], 1).drop("_p", "rank")


def save_pages(results: DataFrame, path: str, position: str = "position") -> None:
    """Write results as rows keyed by file name, one directory per extension."""
    named_pages(results, position).write.mode("overwrite").partitionBy("ext").parquet(path)
