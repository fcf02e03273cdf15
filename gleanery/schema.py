"""Explicit schemas and fixed values. Nothing in the engine infers a schema."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must be equal everywhere for results to agree)
# ---------------------------------------------------------------------------
DOCUMENT_TYPES = [
    "markdown", "python", "csharp", "html", "text",
    "web_page", "pdf", "json", "xml",
]
MIME_BY_TYPE = {
    "markdown": "text/markdown",
    "python": "text/x-python",
    "csharp": "text/x-csharp",
    "text": "text/plain",
    "html": "text/html",
}
MIME_BY_EXTENSION = {
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".py": "text/x-python",
    ".cs": "text/x-csharp",
    ".html": "text/html",
    ".htm": "text/html",
    ".txt": "text/plain",
}
COMMON_SITEMAP_PATHS = [
    "/sitemap.xml",
    "/sitemap_index.xml",
    "/sitemap/sitemap.xml",
    "/sitemap-index.xml",
    "/sitemap/sitemap_index.xml",
]
SITEMAP_MIME_TYPES = ["application/xml", "text/xml"]
METADATA_KEYS = [
    "source", "content_type", "title", "description", "language",
    "created_at", "updated_at", "last_crawled", "status_code",
    "last_modified", "change_frequency", "priority",
    "sitemap_lastmod", "sitemap_changefreq", "sitemap_priority",
    "images", "videos", "extra",
]
DEFAULT_LANGUAGE = "en"
DEFAULT_CHUNK_SIZE = 1000
DEFAULT_CHUNK_OVERLAP = 200
DEFAULT_DIMENSION = 384
DEFAULT_MODEL_NAME = "unknown"
DEFAULT_K = 5
MIN_K, MAX_K = 1, 100
DEFAULT_NLIST = 1024
DEFAULT_NPROBE = 16
DEFAULT_MAX_PAGES = 10
DEFAULT_MAX_DEPTH = 2
CHUNK_SIZE_BOUNDS = (100, 2000)
CHUNK_STRATEGIES = ("semantic", "recursive", "fixed")
CHUNK_OVERLAP_BOUNDS = (0, 500)
BYTE_LIMITS = {
    "doc_id": 255,
    "chunk_id": 255,
    "content": 65535,
    "content_type": 50,
    "embedding_model": 255,
}
TEXT_SEPARATORS = ["\n\n", "\n", " ", ""]
MARKDOWN_SEPARATORS = ["\n# ", "\n## ", "\n### ", "\n\n", "\n", " ", ""]
PYTHON_SEPARATORS = ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""]
CODE_SEPARATORS = ["\n\n\n", "\n\n", "\n", " ", ""]

# ---------------------------------------------------------------------------
# Struct types
# ---------------------------------------------------------------------------
IMAGE = T.StructType([
    T.StructField("loc", T.StringType()),
    T.StructField("caption", T.StringType()),
    T.StructField("geo_location", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("license", T.StringType()),
])
VIDEO = T.StructType([
    T.StructField("thumbnail_loc", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content_loc", T.StringType()),
    T.StructField("player_loc", T.StringType()),
    T.StructField("duration", T.IntegerType()),
])
METADATA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("last_crawled", T.TimestampType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("last_modified", T.StringType()),
    T.StructField("change_frequency", T.StringType()),
    T.StructField("priority", T.DoubleType()),
    T.StructField("sitemap_lastmod", T.StringType()),
    T.StructField("sitemap_changefreq", T.StringType()),
    T.StructField("sitemap_priority", T.DoubleType()),
    T.StructField("images", T.ArrayType(IMAGE)),
    T.StructField("videos", T.ArrayType(VIDEO)),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])
# What a stored chunk's metadata column keeps: all of its document's and its own place.
CHUNK_METADATA = T.StructType([
    *METADATA.fields[:-1],
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("chunk_count", T.IntegerType()),
    T.StructField("header_level", T.IntegerType()),
    T.StructField("header_text", T.StringType()),
    METADATA.fields[-1],
])
COLLECTION = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding_model", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("metadata", CHUNK_METADATA),
    T.StructField("added_at", T.LongType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("batch", T.StringType()),
])
