"""Inputs derived from the given tables.

The tables hold no sitemaps, robots files, Markdown or stored chunks, so these
are built from `pages`, `conversations`, `documents` and `embeddings` by Spark,
over whole tables. Everything gathered into one text is bounded by an id range.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import spread



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content of the documents table, over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


# --- responses -------------------------------------------------------------

PAGE_STATUS = "CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END"
PAGE_TYPE = (
    "CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN '' "
    "WHEN 2 THEN 'application/XML' WHEN 3 THEN 'text/markdown' ELSE 'application/json' END"
)


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a stored response with a status and a content type."""
    return table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.expr(PAGE_STATUS).alias("status"),
        F.expr(PAGE_TYPE).alias("content_type"),
        F.col("html").alias("body"),
    )


# --- sitemaps --------------------------------------------------------------
# The same expressions are valid in Spark SQL and DuckDB.

HOST = "regexp_extract(url, '^[a-z]+://[^/]+', 0)"
ENTRY_SQL = {
    "sitemap_url": f"concat({HOST}, '/sitemap-', CAST(floor(page_id / 500.0) AS BIGINT), '.xml')",
    "loc": "url",
    "lastmod": "concat('2024-', lpad(CAST(1 + page_id % 12 AS VARCHAR(9)), 2, '0'), '-', lpad(CAST(1 + page_id % 28 AS VARCHAR(9)), 2, '0'))",
    "changefreq": "CASE page_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END",
    "priority": "CASE WHEN page_id % 11 = 10 THEN NULL ELSE CAST((page_id % 11) AS DOUBLE) / 10 END",
}
INDEX_URL = f"concat({HOST}, '/sitemap_index-', CAST(floor(page_id / 250000.0) AS BIGINT), '.xml')"


def _xml(name: str, value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.coalesce(F.concat(F.lit(f"<{name}>"), escaped, F.lit(f"</{name}>")), F.lit(""))


def _joined(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    gathered = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(gathered, lambda e: e.getField(text)), "").alias(text)
    )


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sitemap_url, body: URL sets of at most 500 pages of one host.

    Fields come padded, in capitals and partly unusable (a priority in words,
    images without location), and every sitemap has an entry without location.
    """
    p = table(spark, sf_dir, "pages").select(
        "page_id", *[F.expr(sql).alias(name) for name, sql in ENTRY_SQL.items()]
    )
    third, fifth = F.col("page_id") % 3 == 0, F.col("page_id") % 5 == 0
    image = F.concat(
        F.lit("<image:image>"), _xml("image:loc", F.concat("loc", F.lit("/cover.png"))),
        _xml("image:title", F.concat(F.lit("Cover "), F.col("page_id").cast("string"))), F.lit("</image:image>"),
        F.lit("<image:image><image:title>no location</image:title></image:image>"),
    )
    video = F.concat(
        F.lit("<video:video>"), _xml("video:title", F.concat(F.lit("Clip "), F.col("page_id").cast("string"))),
        _xml("video:duration", F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).otherwise("long")),
        F.lit("</video:video><video:video></video:video>"),
    )
    entry = F.concat(
        F.lit("<url>"), _xml("loc", F.concat(F.lit("\n  "), "loc", F.lit(" "))),
        _xml("lastmod", F.concat(F.lit(" "), "lastmod")), _xml("changefreq", F.upper("changefreq")),
        _xml("priority", F.coalesce(F.col("priority").cast("string"), F.lit("high"))),
        F.when(third, image).otherwise(""), F.when(fifth, video).otherwise(""), F.lit("</url>"),
    )
    body = _joined(p.select("sitemap_url", "page_id", entry.alias("body")), ["sitemap_url"], "page_id", "body")
    return body.select("sitemap_url", F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        "body", F.lit("<url><lastmod>2020-01-01</lastmod></url></urlset>"),
    ).alias("body"))


def sitemap_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sitemap_url, body of two levels of indexes: by top-level domain, then by host.

    A host index also names the index above it, so the graph has cycles. An
    index covers one range of page ids and stays bounded.
    """
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.expr(HOST).alias("host"), F.expr(ENTRY_SQL["sitemap_url"]).alias("sitemap_url"),
        F.expr(INDEX_URL).alias("index_url"),
    )
    first = p.groupBy("host", "index_url").agg(F.min("page_id").alias("page_id"))
    tops = first.select("index_url", "page_id", top_index_url().alias("top_url"))

    def child(url: str) -> Column:
        return F.concat(F.lit("<sitemap>"), _xml("loc", F.col(url)), F.lit("</sitemap>"))

    leaves = p.select("index_url", "sitemap_url").distinct().select(
        F.col("index_url").alias("parent"), F.col("sitemap_url").alias("child")
    )
    edges = (
        leaves.unionByName(tops.select(F.col("top_url").alias("parent"), F.col("index_url").alias("child")))
        .unionByName(tops.select(F.col("index_url").alias("parent"), F.col("top_url").alias("child")))
    )
    body = _joined(edges.select("parent", "child", child("child").alias("body")), ["parent"], "child", "body")
    return body.select(F.col("parent").alias("sitemap_url"), F.concat(
        F.lit('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        "body", F.lit("</sitemapindex>"),
    ).alias("body"))


def top_index_url() -> Column:
    return F.expr(
        "concat('https://index.example.', regexp_extract(host, '[a-z]+$', 0), '/', "
        "CAST(floor(page_id / 500.0) AS BIGINT), '/sitemap_index.xml')"
    )


# DuckDB view of the same edges
INDEX_CTE = f"""
p AS (SELECT page_id, {HOST} AS host, {ENTRY_SQL['sitemap_url']} AS sitemap_url, {INDEX_URL} AS index_url FROM pages),
tops AS (SELECT index_url, concat('https://index.example.', regexp_extract(host, '[a-z]+$', 0), '/',
         CAST(floor(min(page_id) / 500.0) AS BIGINT), '/sitemap_index.xml') AS top_url
         FROM p GROUP BY host, index_url)
"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap entries parsed from the built sitemaps."""
    from gleanery.sources.sitemaps import scan_sitemap

    return scan_sitemap(sitemaps(spark, sf_dir))


ENTRY_CTE = "e AS (SELECT page_id, html, " + ", ".join(f"{sql} AS {name}" for name, sql in ENTRY_SQL.items()) + " FROM pages)"


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.expr(HOST).alias("base_url")).distinct()


PROBE_SQL = """
SELECT concat(base_url, CASE length(base_url) % 4 WHEN 1 THEN '/sitemap_index.xml' ELSE '/sitemap.xml' END) AS url,
       CASE length(base_url) % 4 WHEN 3 THEN 404 ELSE 200 END AS status,
       CASE length(base_url) % 4 WHEN 0 THEN 'text/xml; charset=utf-8' WHEN 1 THEN 'application/xml'
            WHEN 2 THEN 'text/html' ELSE 'text/xml' END AS content_type
FROM bases
"""


def site_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every host to a sitemap probe and for robots.txt."""
    probes = spark.sql(PROBE_SQL.replace("FROM bases", "FROM {bases}"), bases=bases(spark, sf_dir)).withColumn(
        "body", F.lit("")
    )
    indexes = table(spark, sf_dir, "pages").select(
        F.expr(HOST).alias("host"), F.expr(INDEX_URL).alias("index_url")
    ).distinct()
    listed = indexes.select(
        "host", "index_url", F.concat(F.lit("  sitemap: "), "index_url", F.lit(" \nDisallow: /x\n")).alias("body")
    )
    robots = _joined(listed, ["host"], "index_url", "body").select(
        F.concat("host", F.lit("/robots.txt")).alias("url"), F.lit(200).alias("status"),
        F.lit("text/plain").alias("content_type"),
        F.concat(F.lit("User-agent: *\r\n"), "body", F.lit("SITEMAP:"), "host", F.lit("/sitemap.xml\n# Sitemap: none")).alias("body"),
    )
    return probes.unionByName(robots)


# --- links -----------------------------------------------------------------

def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between pages: page n links to pages 2n+1, 2n+2 and n+7."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    targets = p.select("url", F.explode(F.array(
        F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2, F.col("page_id") + 7
    )).alias("page_id"))
    return targets.join(p.withColumnRenamed("url", "target"), "page_id").select("url", "target")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of every host."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(HOST).alias("host"))
    return p.groupBy("host").agg(F.min_by("url", "page_id").alias("url")).select("url")


# --- Markdown and code -----------------------------------------------------

TURNS_PER_DOCUMENT = 200


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown document per conversation (at most 200 turns each).

    A preamble, then a section per turn; what an assistant says stands in a
    code fence together with a line that only looks like a header.
    """
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    shown = F.when(
        F.col("role") == "assistant", F.concat(F.lit("```\n# not a header\n"), "text", F.lit("\n```\n"))
    ).otherwise(F.concat("text", F.lit("\n")))
    turns = c.select(
        F.concat_ws("-", F.col("conv_id"), F.floor(F.col("turn") / TURNS_PER_DOCUMENT)).alias("doc_id"),
        "turn",
        F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), shown).alias("content"),
    )
    return _joined(turns, ["doc_id"], "turn", "content").withColumn(
        "content", F.concat(F.lit("Conversation "), "doc_id", F.lit("\n\n"), "content")
    )


MARKDOWN_CTE = """
turns AS (
  SELECT concat(conv_id, '-', CAST(floor(turn / 200.0) AS BIGINT)) AS doc_id, turn, role,
         concat('## ', role, ' ', turn, chr(10), chr(10),
                CASE WHEN role = 'assistant' THEN concat('```', chr(10), '# not a header', chr(10), text, chr(10), '```', chr(10))
                     ELSE concat(text, chr(10)) END) AS section_text
  FROM conversations WHERE text IS NOT NULL),
sections AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS section_index, 2 AS header_level,
         concat(role, ' ', turn) AS header_text, section_text FROM turns
  UNION ALL
  SELECT DISTINCT doc_id, 0, NULL, NULL, concat('Conversation ', doc_id, chr(10), chr(10)) FROM turns)
"""


def code_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as code: every line of text becomes the body of a function."""
    body = F.array_join(
        F.transform(
            F.split("content", "\n"),
            lambda line, i: F.concat(
                F.when(i % 5 == 0, F.concat(F.lit("\nclass C"), i.cast("string"), F.lit(":\n"))).otherwise(""),
                F.lit("\ndef f"), i.cast("string"), F.lit("():\n    return '"), line, F.lit("'\n"),
            ),
        ),
        "",
    )
    return documents(spark, sf_dir).withColumn("content", body)


# --- stored chunks ---------------------------------------------------------

CHUNK_SQL = {
    "doc_id": "concat('doc', CAST(floor(vec_id / 3.0) AS BIGINT))",
    "chunk_id": "concat('vec', vec_id)",
    "chunk_index": "CAST(vec_id % 3 AS INTEGER)",
    "content": "concat('text of vector ', vec_id)",
    "content_type": "CASE label % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' ELSE 'text' END",
    "source": "concat('https://src', label, '.example.com/it', chr(39), 's')",
}
CHUNK_CTE = "c AS (SELECT vec_id, label, embedding, " + ", ".join(
    f"{sql} AS {name}" for name, sql in CHUNK_SQL.items()
) + " FROM embeddings)"
DIMENSION = 64


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as chunks with a vector, flat columns."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        *[F.expr(sql).alias(name) for name, sql in CHUNK_SQL.items()], F.lit(3).alias("chunk_count"),
        F.col("embedding").alias("vector"), "vec_id", "label",
    )


def centroid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, vector: the mean vector of every label."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = F.array_sort(F.collect_list(F.struct("pos", F.col("x").cast("float").alias("x"))))
    return means.groupBy(big("label").alias("query_id")).agg(
        F.transform(vectors, lambda v: v.getField("x")).alias("vector")
    )


CENTROID_CTE = """
parts AS (SELECT label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, generate_series(1, 64) AS g(i)),
means AS (SELECT label, i, CAST(avg(x) AS FLOAT) AS x FROM parts GROUP BY label, i),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS qv FROM means GROUP BY label)
"""
