"""Sitemap discovery, index expansion, bounded crawls, dedup, order and caps."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import resolve_url, url_domain
from gleanery.operators.ordering import global_rank, top_n_per_group
from gleanery.schema import COMMON_SITEMAP_PATHS, DEFAULT_MAX_DEPTH, DEFAULT_MAX_PAGES, SITEMAP_MIME_TYPES
from gleanery.session import append_rows, cut_lineage, scratch_path
from gleanery.sources.sitemaps import scan_robots


def sitemap_candidates(bases: DataFrame) -> DataFrame:
    """Base URLs x common sitemap paths."""
    paths = F.explode(F.array(*[F.lit(p) for p in COMMON_SITEMAP_PATHS]))
    return bases.select("base_url", paths.alias("_path")).select(
        "base_url", resolve_url(F.col("base_url"), F.col("_path")).alias("sitemap_url")
    )


def answering_sitemaps(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidates that answered 200 with an XML content type."""
    is_xml = F.lit(False)
    for mime in SITEMAP_MIME_TYPES:
        is_xml = is_xml | F.col("content_type").startswith(mime)
    good = responses.where((F.col("status") == 200) & is_xml).select(F.col("url").alias("sitemap_url"))
    return candidates.join(good, "sitemap_url", "left_semi").select("base_url", "sitemap_url")


def robots_sitemaps(bases: DataFrame, responses: DataFrame) -> DataFrame:
    files = bases.select("base_url", resolve_url(F.col("base_url"), F.lit("/robots.txt")).alias("url"))
    found = scan_robots(responses.where(F.col("status") == 200).select("url", "body").join(files, "url", "left_semi"))
    return files.join(found, "url").select("base_url", "sitemap_url")


def union_sitemaps(*found: DataFrame) -> DataFrame:
    """Set union of discovery results."""
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result.distinct()


def flatten_entries(*entries: DataFrame) -> DataFrame:
    """Bag union of the entries of several sitemaps."""
    result = entries[0]
    for other in entries[1:]:
        result = result.unionByName(other)
    return result


def discover_sitemaps(bases: DataFrame, responses: DataFrame) -> DataFrame:
    """Distinct (base_url, sitemap_url): probed common paths and robots directives."""
    bases = bases.select("base_url").distinct()
    return union_sitemaps(
        answering_sitemaps(sitemap_candidates(bases), responses), robots_sitemaps(bases, responses)
    )


def expand_sitemap_index(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """All sitemaps reachable from ``roots(sitemap_url)``, each once, with its depth and leaf flag.

    ``edges`` holds (sitemap_url, child_url). One join per level; visited
    sitemaps are one growing table that levels are anti-joined with, so cycles end.
    """
    edges = cut_lineage(edges.select("sitemap_url", "child_url").distinct())
    path, depth = scratch_path(edges.sparkSession, "visited"), 0
    visited = append_rows(roots.select("sitemap_url").distinct().withColumn("depth", F.lit(0)), path)
    while not (level := visited.where(F.col("depth") == depth)).isEmpty():
        reached = (
            level.join(edges, "sitemap_url")
            .select(F.col("child_url").alias("sitemap_url"), (F.col("depth") + 1).alias("depth"))
            .distinct()
            .join(visited.select("sitemap_url"), "sitemap_url", "left_anti")
        )
        visited, depth = append_rows(reached, path), depth + 1
    parents = edges.select("sitemap_url").distinct().withColumn("_parent", F.lit(True))
    return visited.join(parents, "sitemap_url", "left").select(
        "sitemap_url", "depth", F.col("_parent").isNull().alias("is_leaf")
    )


def skip_seen(urls: DataFrame, seen: DataFrame, position: str = "position") -> DataFrame:
    """First occurrence of every URL that was not seen before."""
    first = urls.groupBy("url").agg(F.min(position).alias(position))
    return first.join(seen.select("url").distinct(), "url", "left_anti")


def dedup_first(entries: DataFrame) -> DataFrame:
    """First entry of every location, in the order (sitemap_url, pos)."""
    return top_n_per_group(entries, ["loc"], [F.asc("sitemap_url"), F.asc("pos")], 1).drop("rank")


def priority_order() -> list[Column]:
    """Priority descending, newest first, then location; missing values last."""
    return [
        F.desc_nulls_last("priority"),
        F.desc_nulls_last(F.try_to_timestamp("lastmod")),
        F.asc("loc"),
    ]


def sort_by_priority(entries: DataFrame) -> DataFrame:
    """Entries with their 1-based global rank in priority order.

    Copies of a location are told apart by where they stand, which also keeps
    the sort's ranges even when one location makes up much of the input.
    """
    place = [F.asc(c) for c in ("sitemap_url", "pos") if c in entries.columns]
    return global_rank(entries, priority_order() + place)


def cap_pages(entries: DataFrame, max_pages: int) -> DataFrame:
    """First ``max_pages`` entries in priority order; no cap when it is not positive."""
    return entries.orderBy(*priority_order()).limit(max_pages) if max_pages > 0 else entries


def cap_per_domain(entries: DataFrame, max_pages: int = DEFAULT_MAX_PAGES) -> DataFrame:
    """First ``max_pages`` entries of every domain in priority order, with their rank."""
    domained = entries.withColumn("domain", url_domain(F.col("loc")))
    if max_pages <= 0:
        return domained
    return top_n_per_group(domained, ["domain"], priority_order(), max_pages, "domain_rank")


def bounded_crawl(
    seeds: DataFrame,
    links: DataFrame,
    pages: DataFrame,
    max_depth: int = DEFAULT_MAX_DEPTH,
    max_pages: int = DEFAULT_MAX_PAGES,
) -> DataFrame:
    """Pages within ``max_depth`` links of the seeds, at most ``max_pages`` per domain.

    ``seeds(url)``, ``links(url, target)``, ``pages(url, ...)``. A page belongs
    to the first level that reaches it; within a domain nearer pages come
    first, then URLs in order.
    """
    links = cut_lineage(links.select("url", "target").distinct())
    known = cut_lineage(pages.select("url").distinct())
    path = scratch_path(links.sparkSession, "reached")
    reached = append_rows(seeds.select("url").distinct().join(known, "url", "left_semi").withColumn("depth", F.lit(0)), path)
    for depth in range(1, max_depth + 1):
        targets = (
            reached.where(F.col("depth") == depth - 1).join(links, "url")
            .select(F.col("target").alias("url"))
            .distinct()
            .join(reached.select("url"), "url", "left_anti")
            .join(known, "url", "left_semi")
        )
        reached = append_rows(targets.withColumn("depth", F.lit(depth)), path)
    domained = reached.withColumn("domain", url_domain(F.col("url")))
    if max_pages <= 0:
        return domained
    return top_n_per_group(domained, ["domain"], [F.asc("depth"), F.asc("url")], max_pages, "domain_rank")


def crawl_website(sites: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages of every site: its sitemap entries, or the homepage when it has none.

    ``sites(base_url)``, ``entries(base_url, loc)``.
    """
    found = entries.join(sites.select("base_url").distinct(), "base_url", "left_semi").select(
        "base_url", F.col("loc").alias("url"), F.lit("sitemap").alias("source_type")
    ).distinct()
    without = sites.select("base_url").distinct().join(entries.select("base_url").distinct(), "base_url", "left_anti")
    homepages = without.select("base_url", F.col("base_url").alias("url"), F.lit("direct").alias("source_type"))
    return found.unionByName(homepages)


def join_sitemap_metadata(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Attach sitemap fields to crawl results; ``entries`` must be unique by loc."""
    fields = entries.select(
        F.col("loc").alias("url"),
        F.col("lastmod").alias("sitemap_lastmod"),
        F.col("changefreq").alias("sitemap_changefreq"),
        F.col("priority").alias("sitemap_priority"),
        "images", "videos",
        F.lit(True).alias("_matched"),
    )
    return results.join(fields, "url", "left").withColumn(
        "source_type", F.when(F.col("_matched"), "sitemap").otherwise("direct")
    ).drop("_matched")


SUMMARY_LINES = 100


def sitemap_summary(entries: DataFrame, sitemaps: DataFrame | None = None) -> DataFrame:
    """Text summary per sitemap: total and the first 100 entries.

    ``sitemaps(sitemap_url)`` names all that were read, so that one without entries
    has its summary too.

    Counting is partial before the shuffle and only ranked heads are gathered,
    so a sitemap with very many entries costs no more than one with a hundred.
    The full URL list is ``sitemap_url_lists``. The wording is a fixed value.
    """
    totals = entries.groupBy("sitemap_url").agg(F.count("*").alias("url_count"))
    if sitemaps is not None:
        read = sitemaps.select("sitemap_url").distinct()
        totals = read.join(totals, "sitemap_url", "left").select("sitemap_url", F.coalesce("url_count", F.lit(0)).alias("url_count"))
    head = top_n_per_group(entries, ["sitemap_url"], [F.asc("pos")], SUMMARY_LINES)
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("loc"),
        F.coalesce(F.concat(F.lit(" (lastmod: "), F.col("lastmod"), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" [priority: "), F.col("priority").cast("string"), F.lit("]")), F.lit("")),
        F.lit("\n"),
    )
    lines = head.select("sitemap_url", F.struct("rank", line.alias("line")).alias("l")).groupBy("sitemap_url").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l.getField("line")), "").alias("_lines")
    )
    more = F.when(
        F.col("url_count") > SUMMARY_LINES,
        F.format_string("\n... and %d more URLs", F.col("url_count") - SUMMARY_LINES),
    ).otherwise("")
    return totals.join(lines, "sitemap_url", "left").select(
        "sitemap_url",
        "url_count",
        F.concat(
            F.format_string("Sitemap: %s\nTotal URLs: %d\n\n", "sitemap_url", "url_count"), F.coalesce("_lines", F.lit("")), more
        ).alias("content"),
    )


def sitemap_url_lists(entries: DataFrame) -> DataFrame:
    """URL list of every sitemap: one row per URL with its position, whatever the list's length."""
    return entries.select("sitemap_url", F.col("pos").alias("position"), F.col("loc").alias("url"))
