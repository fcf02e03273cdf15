"""URL functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import blank_to_null

# scheme://netloc/path, with query and fragment left out of the last group
_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)"
_ORIGIN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"

# RFC 4122 namespace for URLs (fixed value)
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def normalize_url(url: Column) -> Column:
    """Lower-case scheme, keep netloc, strip trailing slashes, drop params, query, fragment.

    A URL without a scheme is taken to start with its host and gets ``https``
    when it is written ``//host/path``; anything else without a scheme is null.
    """
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    scheme = F.lower(F.regexp_extract(full, _PARTS, 1))
    netloc = F.regexp_extract(full, _PARTS, 2)
    path = F.regexp_extract(full, _PARTS, 3)
    path = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), r"/+$", "")
    joined = F.concat(scheme, F.lit("://"), netloc, F.coalesce(blank_to_null(path), F.lit("/")))
    return F.when(full.rlike(_PARTS), joined)


def _without_dots(path: Column) -> Column:
    """An absolute path with its ``.`` and ``..`` segments carried out; those above the root are dropped."""
    segments = F.split(F.regexp_replace(path, r"/(\.{1,2})$", "/$1/"), "/")
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)), F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute URL of a reference: relative paths start at the base's directory, ``?`` and ``#`` at the base itself."""
    origin, path = F.regexp_extract(base, _ORIGIN, 0), F.regexp_extract(base, _PARTS, 3)
    bare = F.regexp_replace(base, "#.*$", "")
    ref_path, ref_rest = F.regexp_extract(ref, "^[^?#]*", 0), F.regexp_extract(ref, "[?#].*$", 0)
    directory = F.coalesce(blank_to_null(F.regexp_replace(path, "[^/]*$", "")), F.lit("/"))
    return (
        F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", 0), ref))
        .when(ref == "", base)
        .when(ref.startswith("#"), F.concat(bare, ref))
        .when(ref.startswith("?"), F.concat(origin, path, ref))
        .when(ref.startswith("/"), F.concat(origin, _without_dots(ref_path), ref_rest))
        .otherwise(F.concat(origin, _without_dots(F.concat(directory, ref_path)), ref_rest))
    )


def url_domain(url: Column) -> Column:
    """Network location of a URL; '' when there is none. Tolerates characters a strict parser rejects."""
    return F.regexp_extract(url, _PARTS, 2)


def document_id(url: Column) -> Column:
    """Name-based (version 5) UUID of a URL, computed natively."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(url, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_chunk_"), index.cast("string"))


def safe_filename(url: Column, position: Column) -> Column:
    """File name of a page; ``page_{position}`` when nothing of the URL is left."""
    trimmed = F.regexp_replace(url, r"^/+|/+$", "")
    name = F.regexp_replace(F.replace(trimmed, F.lit("://"), F.lit("_")), r"[^\p{L}\p{N}._-]", "_")
    return F.coalesce(blank_to_null(name), F.concat(F.lit("page_"), position.cast("string")))


def file_extension(content_type: Column) -> Column:
    """Extension of a stored page; the rules and their order are fixed values."""
    ct = F.coalesce(content_type, F.lit(""))
    return (
        F.when(ct.contains("html"), ".html")
        .when(ct.contains("markdown"), ".md")
        .when(ct.contains("python"), ".py")
        .when(ct.contains("csharp"), ".cs")
        .otherwise(".txt")
    )


def link_allowed(url: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Include/exclude regex lists: empty include admits everything, exclude wins."""
    admitted = F.lit(True)
    if include:
        admitted = F.lit(False)
        for pattern in include:
            admitted = admitted | url.rlike(pattern)
    for pattern in exclude:
        admitted = admitted & ~url.rlike(pattern)
    return admitted


def is_sitemap_url(url: Column) -> Column:
    """A URL whose path ends in ``.xml`` and mentions ``sitemap``."""
    path = F.lower(F.regexp_extract(url, _PARTS, 3))
    return path.endswith(".xml") & path.contains("sitemap")


def is_sitemap_body(body: Column) -> Column:
    return (body.startswith("<?xml") & body.rlike(r"<([A-Za-z_][\w.-]*:)?sitemap")) | body.rlike(r"<([A-Za-z_][\w.-]*:)?urlset")


def is_sitemap_index_body(body: Column) -> Column:
    return F.lower(body).contains("sitemapindex")
