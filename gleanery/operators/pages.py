"""Rows out of stored pages: metadata and links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions.urls import link_allowed, resolve_url


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, description, language and encoding of every page, in place of its text."""
    text = F.col(html)
    return pages.select(
        *[c for c in pages.columns if c != html],
        H.page_title(text).alias("title"), H.page_description(text).alias("description"),
        H.page_language(text).alias("language"), H.page_encoding(text).alias("encoding"),
    )


def page_link_rows(
    pages: DataFrame, include: list[str] = (), exclude: list[str] = (), url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per anchor: pos, href as written, absolute link; filtered by patterns on the link."""
    keep = [c for c in pages.columns if c != html]
    # outer, so that no "not empty" filter parses every page a second time
    rows = pages.select(*keep, F.posexplode_outer(H.page_links(F.col(html))).alias("pos", "href")).where("pos is not null")
    linked = rows.withColumn("link", resolve_url(F.col(url), F.col("href")))
    return linked.where(link_allowed(F.col("link"), include, exclude))
