"""Sitemap XML, sitemap indexes and robots.txt, parsed by Spark's own XML reader."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import blank_to_null, strip
from gleanery.functions.urls import is_sitemap_index_body, normalize_url
from gleanery.schema import IMAGE, VIDEO

_IMAGE_FIELDS = [f.name for f in IMAGE.fields]
_VIDEO_FIELDS = [f.name for f in VIDEO.fields]


def _xml_struct(prefix: str, names: list[str]) -> str:
    return "struct<" + ",".join(f"`{prefix}:{n}`:string" for n in names) + ">"


_URLSET = (
    "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string,"
    f"`image:image`:array<{_xml_struct('image', _IMAGE_FIELDS)}>,"
    f"`video:video`:array<{_xml_struct('video', _VIDEO_FIELDS)}>>>"
)
_INDEX = "sitemap array<struct<loc:string,lastmod:string>>"
# A document that does not parse gives null, hence no rows.
_LENIENT = {"mode": "PERMISSIVE"}


def _text(value: Column) -> Column:
    return blank_to_null(strip(value))


#: The public namespaces, and the prefix this reader expects for each.
_NAMESPACES = {
    "http://www.sitemaps.org/schemas/sitemap/0.9": "",
    "http://www.google.com/schemas/sitemap-image/1.1": "image:",
    "http://www.google.com/schemas/sitemap-video/1.1": "video:",
}


def standard_prefixes(body: Column) -> Column:
    """Elements under the expected prefixes, whatever prefix a document declares for a namespace."""
    for name, wanted in _NAMESPACES.items():
        declared = F.regexp_extract(body, r"""xmlns:([A-Za-z_][\w.-]*)\s*=\s*["']""" + name.replace(".", r"\.") + """["']""", 1)
        tags = F.concat(F.lit("(</?)"), F.replace(declared, F.lit("."), F.lit("\\.")), F.lit(":"))
        differs = (declared != "") & (declared != wanted.rstrip(":"))
        body = F.when(differs, F.regexp_replace(body, tags, F.lit(f"$1{wanted}"))).otherwise(body)
    return body


def _images(raw: Column) -> Column:
    shaped = F.transform(
        raw, lambda i: F.struct(*[_text(i.getField(f"image:{n}")).alias(n) for n in _IMAGE_FIELDS])
    )
    return F.coalesce(F.filter(shaped, lambda i: i.getField("loc").isNotNull()), F.array().cast(f"array<{IMAGE.simpleString()}>"))


def _videos(raw: Column) -> Column:
    def shape(v: Column) -> Column:
        texts = [_text(v.getField(f"video:{n}")).alias(n) for n in _VIDEO_FIELDS[:-1]]
        return F.struct(*texts, _text(v.getField("video:duration")).try_cast("int").alias("duration"))

    def filled(v: Column) -> Column:
        return F.coalesce(*[v.getField(n).cast("string") for n in _VIDEO_FIELDS]).isNotNull()

    return F.coalesce(F.filter(F.transform(raw, shape), filled), F.array().cast(f"array<{VIDEO.simpleString()}>"))


def scan_sitemap(sitemaps: DataFrame, body: str = "body", normalize_loc: bool = False) -> DataFrame:
    """Rows of URL sets: sitemap_url, pos, loc, lastmod, changefreq, priority, images, videos.

    Entries without a location are dropped, and so is a body that is an index.
    With ``normalize_loc`` locations are normalized and changefreq keeps its case.
    """
    parsed = sitemaps.where(~is_sitemap_index_body(F.col(body))).select(
        "sitemap_url", F.from_xml(standard_prefixes(F.col(body)), _URLSET, _LENIENT).alias("x")
    )
    rows = parsed.select("sitemap_url", F.posexplode("x.url").alias("pos", "u"))
    return parse_sitemap_fields(rows.select(
        "sitemap_url", "pos", "u.loc", "u.lastmod", "u.changefreq", "u.priority",
        _images(F.col("u.`image:image`")).alias("images"),
        _videos(F.col("u.`video:video`")).alias("videos"),
    ), normalize_loc)


def parse_sitemap_fields(raw: DataFrame, normalize_loc: bool = False) -> DataFrame:
    """Trim, lower-case and type the text fields of sitemap entries."""
    loc, freq = _text(F.col("loc")), _text(F.col("changefreq"))
    return (
        raw.withColumn("loc", normalize_url(loc) if normalize_loc else loc)
        .withColumn("lastmod", _text(F.col("lastmod")))
        .withColumn("changefreq", freq if normalize_loc else F.lower(freq))
        .withColumn("priority", _text(F.col("priority")).try_cast("double"))
        .where(F.col("loc").isNotNull())
    )


def scan_sitemap_index(sitemaps: DataFrame, body: str = "body") -> DataFrame:
    """Children of sitemap indexes: sitemap_url (parent), pos, child_url, normalized."""
    parsed = sitemaps.where(is_sitemap_index_body(F.col(body))).select(
        "sitemap_url", F.from_xml(standard_prefixes(F.col(body)), _INDEX, _LENIENT).alias("x")
    )
    rows = parsed.select("sitemap_url", F.posexplode("x.sitemap").alias("pos", "s"))
    return rows.select("sitemap_url", "pos", normalize_url(_text(F.col("s.loc"))).alias("child_url")).where(
        F.col("child_url").isNotNull()
    )


def scan_robots(robots: DataFrame, body: str = "body") -> DataFrame:
    """``Sitemap:`` directives of robots files: url, sitemap_url."""
    lines = robots.select("url", F.explode_outer(F.split(F.col(body), r"\R")).alias("line"))
    trimmed = strip(F.col("line"))
    return lines.where(trimmed.rlike("(?i)^sitemap:")).select(
        "url", strip(F.regexp_replace(trimmed, "(?i)^sitemap:", "")).alias("sitemap_url")
    )


def sitemap_documents(entries: DataFrame, include_images: bool = True, include_videos: bool = True) -> DataFrame:
    """Entries as documents with empty content, to be filled by a crawl."""

    def switched(on: bool, name: str) -> Column:
        return F.when(F.lit(on) & (F.size(name) > 0), F.col(name))

    return entries.select(
        F.col("loc").alias("doc_id"),
        F.col("loc").alias("source"),
        F.lit("web_page").alias("content_type"),
        F.lit("").alias("content"),
        F.col("lastmod").alias("last_modified"),
        F.col("changefreq").alias("change_frequency"),
        "priority",
        switched(include_images, "images").alias("images"),
        switched(include_videos, "videos").alias("videos"),
    )


def sitemap_entry_json(entries: DataFrame) -> DataFrame:
    """Entry as a JSON object; missing lists are ``[]``, missing values null."""
    entry = F.struct(
        "loc", "lastmod", "changefreq", "priority",
        F.coalesce("images", F.array().cast(f"array<{IMAGE.simpleString()}>")).alias("images"),
        F.coalesce("videos", F.array().cast(f"array<{VIDEO.simpleString()}>")).alias("videos"),
    )
    return entries.withColumn("entry_json", F.to_json(entry, {"ignoreNullFields": "false"}))
