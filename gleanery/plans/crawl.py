"""Sitemap crawl from end to end over stored responses."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import is_sitemap_body, is_sitemap_index_body
from gleanery.operators.discovery import (
    answering_sitemaps,
    cap_per_domain,
    dedup_first,
    discover_sitemaps,
    expand_sitemap_index,
    join_sitemap_metadata,
    robots_sitemaps,
    sitemap_candidates,
    union_sitemaps,
)
from gleanery.operators.chunking import chunk_as_asked
from gleanery.operators.embedding import Loader, embed_chunks, hashed_bag_of_words
from gleanery.schema import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE
from gleanery.session import cut_lineage, scratch_path
from gleanery.sources.collection import Collection
from gleanery.sources.direct import page_documents
from gleanery.sources.responses import crawl_results, newest_responses
from gleanery.sources.sitemaps import scan_sitemap, scan_sitemap_index


def sitemap_entries(bases: DataFrame, responses: DataFrame) -> DataFrame:
    """Entries of all sitemaps of the sites, each location once."""
    found = discover_sitemaps(bases, responses).select("sitemap_url")
    bodies = responses.where((F.col("status") == 200) & is_sitemap_body(F.col("body"))).select(
        F.col("url").alias("sitemap_url"), "body"
    )
    reached = expand_sitemap_index(found, scan_sitemap_index(bodies))
    leaves = bodies.join(reached.where("is_leaf").select("sitemap_url"), "sitemap_url", "left_semi")
    return dedup_first(scan_sitemap(leaves))


def crawl_sites(bases: DataFrame, responses: DataFrame, max_pages: int = 0) -> DataFrame:
    """Crawl results of every page the sites' sitemaps name, with sitemap metadata."""
    entries = cut_lineage(sitemap_entries(bases, responses))
    wanted = cap_per_domain(entries, max_pages).select(F.col("loc").alias("url"))
    return join_sitemap_metadata(crawl_results(wanted, responses), entries)


def routed_responses(responses: DataFrame) -> DataFrame:
    """The newest response of every URL in one stored table, by ``kind``: index, sitemap, robots or page.

    Bodies are looked at once; each later step reads the directory of its kind only.
    """
    good = F.col("status") == 200
    kind = (
        F.when(good & is_sitemap_body(F.col("body")) & is_sitemap_index_body(F.col("body")), "index")
        .when(good & is_sitemap_body(F.col("body")), "sitemap")
        .when(F.col("url").rlike(r"^[^/]*//[^/]*/robots\.txt$"), "robots")
        .otherwise("page")
    )
    routed, path = newest_responses(responses).withColumn("kind", kind), scratch_path(responses.sparkSession, "routed")
    routed.write.partitionBy("kind").parquet(path)
    return responses.sparkSession.read.schema(routed.schema).parquet(path)


def crawl_pages(routed: DataFrame, bases: DataFrame | None = None, urls: DataFrame | None = None, max_pages: int = 0) -> DataFrame:
    """Crawl results with sitemap metadata for sites and for a list of URLs.

    ``routed`` comes from ``routed_responses``. Of sites (``base_url``) the sitemaps are
    looked for; of listed URLs (``url``) those that answered with a sitemap or an index
    are opened, and the others are pages themselves. ``max_pages`` caps what sitemaps
    name per domain, listed pages are all taken.
    """
    spark = routed.sparkSession
    of_kind = lambda *kinds: routed.where(F.col("kind").isin(*kinds))
    nothing = lambda name: spark.createDataFrame([], f"{name} string")
    bases = (nothing("base_url") if bases is None else bases.select("base_url")).distinct()
    urls = (nothing("url") if urls is None else urls.select("url")).distinct()
    maps = of_kind("index", "sitemap").select("url")
    found = union_sitemaps(
        answering_sitemaps(sitemap_candidates(bases), routed.drop("body")).select("sitemap_url"),
        robots_sitemaps(bases, of_kind("robots")).select("sitemap_url"),
        urls.join(maps, "url", "left_semi").select(F.col("url").alias("sitemap_url")),
    )
    bodies = lambda kind: of_kind(kind).select(F.col("url").alias("sitemap_url"), "body")
    reached = expand_sitemap_index(found, scan_sitemap_index(bodies("index")))
    leaves = bodies("sitemap").join(reached.where("is_leaf").select("sitemap_url"), "sitemap_url", "left_semi")
    entries = cut_lineage(dedup_first(scan_sitemap(leaves)))
    named = cap_per_domain(entries, max_pages).select(F.col("loc").alias("url"))
    wanted = named.unionByName(urls.join(maps, "url", "left_anti"))
    return join_sitemap_metadata(crawl_results(wanted, of_kind("page").drop("kind")), entries)


def crawl_to_collection(
    responses: DataFrame, collection: Collection, bases: DataFrame | None = None, urls: DataFrame | None = None, max_pages: int = 0,
    strategy: str = "semantic", size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP, max_tokens: int | None = None,
    loader: Loader | None = None, **storing,
) -> DataFrame:
    """Crawl sites and listed URLs and store the pages' chunks with their metadata; (url, status, error, source_type) of every page.

    Chunks are made by ``strategy``, or of ``max_tokens`` tokens; ``storing`` goes to ``Collection.append``.
    """
    results = cut_lineage(crawl_pages(routed_responses(responses), bases, urls, max_pages))
    documents = page_documents(results).drop("source_type").withColumns({
        "strategy": F.lit(strategy), "chunk_size": F.lit(size), "chunk_overlap": F.lit(overlap), "max_tokens": F.lit(max_tokens).cast("int"),
    })
    loader = loader or hashed_bag_of_words(collection.dimension)
    collection.append(embed_chunks(chunk_as_asked(documents), loader), **storing)
    return results.select("url", "status", "error", "source_type")
