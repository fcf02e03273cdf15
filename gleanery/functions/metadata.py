"""Metadata maps: keep the known keys, fill defaults, merge caller-supplied keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.content_types import coerce_content_type
from gleanery.schema import DEFAULT_LANGUAGE, IMAGE, METADATA_KEYS, VIDEO


def project_metadata(raw: Column, content_type: Column) -> Column:
    """Struct of all known keys of a string map; an explicit content type wins.

    Images, videos and the extra map are JSON texts in the map; what does not parse is null.
    """
    known = F.map_filter(raw, lambda key, _: key.isin(METADATA_KEYS))
    picked = lambda key: F.try_element_at(known, F.lit(key))
    stamp = lambda key: F.coalesce(F.try_to_timestamp(picked(key)), F.current_timestamp())
    return F.struct(
        picked("source").alias("source"),
        coerce_content_type(F.coalesce(content_type, picked("content_type"))).alias("content_type"),
        picked("title").alias("title"),
        picked("description").alias("description"),
        F.coalesce(picked("language"), F.lit(DEFAULT_LANGUAGE)).alias("language"),
        stamp("created_at").alias("created_at"),
        stamp("updated_at").alias("updated_at"),
        F.try_to_timestamp(picked("last_crawled")).alias("last_crawled"),
        picked("status_code").try_cast("int").alias("status_code"),
        picked("last_modified").alias("last_modified"),
        picked("change_frequency").alias("change_frequency"),
        picked("priority").try_cast("double").alias("priority"),
        picked("sitemap_lastmod").alias("sitemap_lastmod"),
        picked("sitemap_changefreq").alias("sitemap_changefreq"),
        picked("sitemap_priority").try_cast("double").alias("sitemap_priority"),
        F.from_json(picked("images"), f"array<{IMAGE.simpleString()}>").alias("images"),
        F.from_json(picked("videos"), f"array<{VIDEO.simpleString()}>").alias("videos"),
        F.from_json(picked("extra"), "map<string,string>").alias("extra"),
    )


def attach_metadata(derived: Column, supplied: Column) -> Column:
    """Union of two string maps; on a shared key the caller-supplied value wins."""
    derived = F.coalesce(derived, F.create_map().cast("map<string,string>"))
    supplied = F.coalesce(supplied, F.create_map().cast("map<string,string>"))
    return F.map_zip_with(supplied, derived, lambda _, mine, theirs: F.coalesce(mine, theirs))
