"""Scalar functions and predicates over pages, responses and sitemap entries (C)."""

from pyspark.sql import functions as F

from gleanery.functions import content_types as ct
from gleanery.functions import html as H
from gleanery.functions import metadata as M
from gleanery.functions import urls as U
from gleanery.operators.pages import page_link_rows, page_metadata
from gleanery.sources.responses import crawl_success
from gleanery.sources.sitemaps import parse_sitemap_fields, sitemap_documents, sitemap_entry_json
from suite import inputs as I
from suite import query

NORMALIZED = """concat(lower(split_part(url, '://', 1)), '://', split_part(split_part(url, '://', 2), '/', 1),
 coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(split_part(url, '://', 2), '[?#].*$', ''), '^[^/]*', ''), '/+$', ''), ''), '/'))"""


@query("project_metadata", """
SELECT event_id, CAST(user_id AS VARCHAR) AS source, 'text' AS content_type, 'en' AS language,
       CAST(value AS DOUBLE) AS priority, event_type AS title, CAST(NULL AS VARCHAR) AS description FROM events""")
def project_metadata(spark, sf):
    raw = F.create_map(
        F.lit("source"), F.col("user_id").cast("string"), F.lit("title"), F.col("event_type"),
        F.lit("priority"), F.col("value").cast("string"), F.lit("props"), F.col("props"),
    )
    e = I.table(spark, sf, "events").select("event_id", M.project_metadata(raw, F.lit("Presentation")).alias("m"))
    return e.select("event_id", "m.source", "m.content_type", "m.language", "m.priority", "m.title", "m.description")


@query("attach_metadata", """
SELECT doc_id, source, lang, 'caller' AS origin FROM documents""")
def attach_metadata(spark, sf):
    d = I.table(spark, sf, "documents")
    derived = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("origin"), F.lit("derived"))
    merged = M.attach_metadata(derived, F.create_map(F.lit("origin"), F.lit("caller")))
    return d.select("doc_id", merged.alias("m")).select("doc_id", "m.source", "m.lang", "m.origin")


@query("coerce_content_type", f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'web_page' ELSE 'text' END AS content_type FROM pages""")
def coerce_content_type(spark, sf):
    given = F.expr("CASE page_id % 4 WHEN 0 THEN 'MarkDown' WHEN 1 THEN 'web_page' WHEN 2 THEN 'docx' END")
    return I.table(spark, sf, "pages").select("page_id", ct.coerce_content_type(given).alias("content_type"))


@query("infer_document_type", f"""
WITH r AS (SELECT page_id, url, lower({I.PAGE_TYPE}) AS ct FROM pages)
SELECT page_id, CASE
  WHEN contains(ct, 'text/html') OR (ct = '' AND starts_with(url, 'http')) THEN 'web_page'
  WHEN contains(ct, 'markdown') THEN 'markdown' WHEN contains(ct, 'json') THEN 'json'
  WHEN contains(ct, 'xml') THEN 'xml' ELSE 'text' END AS document_type FROM r""")
def infer_document_type(spark, sf):
    return I.page_responses(spark, sf).select(
        "page_id", ct.infer_document_type(F.col("content_type"), F.col("url")).alias("document_type")
    )


ROUTED = {
    0: ("Text/HTML; charset=utf-8", "text/html"), 1: (None, "text/plain"), 2: ("application/x-python", "text/plain"),
    3: ("text", "text/markdown"), 4: ("; q=1", "text/markdown"), 5: ("notes.PY", "text/x-python"),
    6: ("vnd.text/x-csharp+v2", "text/x-csharp"), 7: ("image/png", "text/plain"),
}


def _case(column: str, values: dict) -> str:
    quoted = {k: "NULL" if v is None else f"'{v}'" for k, v in values.items()}
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}" for k, v in quoted.items()) + " END"


@query("route_extractor", f"SELECT page_id, {_case('page_id % 8', {k: v[1] for k, v in ROUTED.items()})} AS extractor FROM pages")
def route_extractor(spark, sf):
    given = F.expr(_case("page_id % 8", {k: v[0] for k, v in ROUTED.items()}))
    return I.table(spark, sf, "pages").select("page_id", ct.route_extractor(given).alias("extractor"))


@query("extension_to_mime", """
SELECT page_id, CASE WHEN contains(p, '.html') THEN 'text/html' END AS mime
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)""")
def extension_to_mime(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    return I.table(spark, sf, "pages").select("page_id", ct.extension_to_mime(path).alias("mime"))


@query("register_extractor", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN upper(url) WHEN 2 THEN reverse(url) ELSE url END AS content FROM pages""")
def register_extractor(spark, sf):
    registry = ct.ExtractorRegistry()
    registry.register("text/html", F.upper)
    registry.register("application/xml", F.reverse)
    return I.page_responses(spark, sf).select(
        "page_id", registry.extract(F.col("content_type"), F.col("url")).alias("content")
    )


@query("normalize_url", f"SELECT page_id, {NORMALIZED} AS normalized FROM pages")
def normalize_url(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


@query("resolve_url", f"""
WITH b AS (SELECT page_id, {I.HOST} AS host, regexp_replace(url, '#.*$', '') AS bare, regexp_replace(url, '[?#].*$', '') AS page FROM pages),
d AS (SELECT *, coalesce(nullif(regexp_extract(page, '^[a-z]+://[^/]+(.*/)', 1), ''), '/') AS dir FROM b)
SELECT page_id, CASE page_id % 8 WHEN 0 THEN concat(host, '/robots.txt') WHEN 1 THEN 'https://other.example/x'
  WHEN 2 THEN concat(host, dir, 'page/', page_id) WHEN 3 THEN concat(host, coalesce(nullif(regexp_replace(dir, '[^/]*/$', ''), ''), '/'), 'up?a=../b')
  WHEN 4 THEN concat(page, '?q=', page_id) WHEN 5 THEN concat(bare, '#f') WHEN 6 THEN concat(host, dir, 'b/') ELSE concat(host, '/b') END AS resolved
FROM d""")
def resolve_url(spark, sf):
    ref = F.expr("""CASE page_id % 8 WHEN 0 THEN '/robots.txt' WHEN 1 THEN 'https://other.example/x' WHEN 2 THEN concat('page/', page_id)
      WHEN 3 THEN '../up?a=../b' WHEN 4 THEN concat('?q=', page_id) WHEN 5 THEN '#f' WHEN 6 THEN './a/../b/.' ELSE '/a/../../b' END""")
    return I.table(spark, sf, "pages").select("page_id", U.resolve_url(F.col("url"), ref).alias("resolved"))


@query("url_domain", "SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS domain FROM pages")
def url_domain(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", U.url_domain(F.col("url")).alias("domain"))


@query("document_id", """
WITH h AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS d FROM pages)
SELECT page_id, concat(substr(d, 1, 8), '-', substr(d, 9, 4), '-5', substr(d, 14, 3), '-',
  translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(d, 18, 3), '-', substr(d, 21, 12)) AS doc_id FROM h""")
def document_id(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", U.document_id(F.col("url")).alias("doc_id"))


@query("chunk_id", "SELECT vec_id, concat(label, '_chunk_', vec_id % 3) AS chunk_id FROM embeddings")
def chunk_id(spark, sf):
    return I.table(spark, sf, "embeddings").select(
        "vec_id", U.chunk_id(F.col("label"), F.col("vec_id") % 3).alias("chunk_id")
    )


DECODED_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
for _entity, _char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    DECODED_TITLE = f"replace({DECODED_TITLE}, '{_entity}', '{_char}')"


@query("extract_page_metadata", f"""
SELECT page_id, trim({DECODED_TITLE}) AS title, '' AS description,
       regexp_extract(html, 'html lang="([a-z]+)"', 1) AS language, 'utf-8' AS encoding FROM pages""")
def extract_page_metadata(spark, sf):
    return page_metadata(I.pages(spark, sf)).drop("url")


LINKS_CTE = """
hrefs AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
          generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)"""


@query("extract_links", f"WITH {LINKS_CTE} SELECT page_id, CAST(pos AS BIGINT) AS pos, href, concat({I.HOST}, href) AS link FROM hrefs")
def extract_links(spark, sf):
    return page_link_rows(I.pages(spark, sf)).select("page_id", I.big("pos").alias("pos"), "href", "link")


@query("filter_links", f"""
WITH {LINKS_CTE}, l AS (SELECT page_id, concat({I.HOST}, href) AS link FROM hrefs)
SELECT page_id, link FROM l
WHERE (contains(link, '.com/') OR contains(link, '.org/')) AND NOT regexp_matches(link, '/[A-Z]')""")
def filter_links(spark, sf):
    return page_link_rows(I.pages(spark, sf), [r"\.com/", r"\.org/"], [r"/[A-Z]"]).select("page_id", "link")


@query("strip_html_elements", r"""
WITH s AS (SELECT page_id, html,
  regexp_replace(regexp_replace(regexp_replace(html, '<!--[^>]*-->', '', 'g'), '<script>.*?</script>', '', 'gs'), '<style>[^<]*</style>', '', 'g') AS kept FROM pages)
SELECT page_id, md5(kept) AS default_md5, CAST(length(kept) AS BIGINT) AS default_length,
       md5(regexp_replace(regexp_replace(kept, '<meta[^>]*>', '', 'g'), '</?a(\s[^>]*)?>', '', 'g')) AS bare_md5 FROM s""")
def strip_html_elements(spark, sf):
    p = I.pages(spark, sf).select(
        "page_id", H.strip_html_elements(F.col("html")).alias("kept"),
        H.strip_html_elements(F.col("html"), keep=set()).alias("bare"),
    )
    return p.select(
        "page_id", F.md5("kept").alias("default_md5"), I.big(F.length("kept")).alias("default_length"),
        F.md5("bare").alias("bare_md5"),
    )


def _chain(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'gs')"
    return text


_NL = "chr(10)"
_BODY = _chain("html", [("<!--.*?-->", "''"), ("<script>.*?</script>", "''"), ("<style>.*?</style>", "''"), ("<head>.*?</head>", "''")])
_AS_MARKDOWN = [
    ("<h1>", f"concat({_NL}, {_NL}, ''# '')".replace("''", "'")), ("</h1>", f"concat({_NL}, {_NL})"),
    ('<a href="([^"]*)">(.*?)</a>', r"'[\2](\1)'"), ("</?b>", "'**'"), ("<li>", f"concat({_NL}, '- ')"), ("<br>", _NL),
]
_BLOCKS = [(r"</?(p|div|article|ul|nav|footer)(\s[^>]*)?>", f"concat({_NL}, {_NL})")]
_PLAIN = [(r"</?(p|div|h1|article|ul|nav|footer)(\s[^>]*)?>", f"concat({_NL}, {_NL})"), ("<(br|li)>", _NL)]
_TIDY = [("<[^>]*>", "''"), (r"[ \t]+", "' '"), (r" ?\n ?", _NL), (r"\n\n\n+", f"concat({_NL}, {_NL})")]


def _finished(text: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return _chain(text, [(r"^\s+", "''"), (r"\s+$", "''")])


MARKDOWN_SQL, TITLE_SQL = _finished(_chain(_BODY, _AS_MARKDOWN + _BLOCKS + _TIDY)), DECODED_TITLE


@query("html_to_text", f"""
WITH t AS (SELECT page_id, {MARKDOWN_SQL} AS m,
                  {_finished(_chain(_BODY, _PLAIN + _TIDY))} AS p FROM pages)
SELECT page_id, md5(m) AS content_md5, CAST(length(m) AS BIGINT) AS content_length,
       md5(p) AS plain_md5, CAST(length(p) AS BIGINT) AS plain_length FROM t""")
def html_to_text(spark, sf):
    p = I.pages(spark, sf).select(
        "page_id", H.html_to_text(F.col("html")).alias("m"), H.html_to_plain_text(F.col("html")).alias("p")
    )
    return p.select(
        "page_id", F.md5("m").alias("content_md5"), I.big(F.length("m")).alias("content_length"),
        F.md5("p").alias("plain_md5"), I.big(F.length("p")).alias("plain_length"),
    )


_FILENAME = r"regexp_replace(replace(regexp_replace(url, '/+$', ''), '://', '_'), '[^\p{L}\p{N}._-]', '_', 'g')"
_EXTENSION = "CASE page_id % 5 WHEN 0 THEN '.html' WHEN 3 THEN '.md' ELSE '.txt' END"


@query("safe_filename", f"SELECT page_id, concat({_FILENAME}, {_EXTENSION}) AS filename FROM pages")
def safe_filename(spark, sf):
    return I.page_responses(spark, sf).select(
        "page_id",
        F.concat(U.safe_filename(F.col("url"), F.col("page_id")), U.file_extension(F.col("content_type"))).alias("filename"),
    )


@query("is_sitemap", f"""
WITH {I.INDEX_CTE}, s AS (
  SELECT DISTINCT sitemap_url AS url, true AS is_sitemap, false AS is_index, true AS url_says_sitemap FROM p
  UNION SELECT DISTINCT index_url, true, true, true FROM p UNION SELECT DISTINCT top_url, true, true, true FROM tops
  UNION ALL SELECT url, false, false, false FROM pages)
SELECT * FROM s""")
def is_sitemap(spark, sf):
    bodies = I.sitemaps(spark, sf).unionByName(I.sitemap_indexes(spark, sf)).select(F.col("sitemap_url").alias("url"), "body")
    every = bodies.unionByName(I.table(spark, sf, "pages").select("url", F.col("html").alias("body")))
    return every.select(
        "url", U.is_sitemap_body(F.col("body")).alias("is_sitemap"),
        U.is_sitemap_index_body(F.col("body")).alias("is_index"), U.is_sitemap_url(F.col("url")).alias("url_says_sitemap"),
    )


@query("parse_sitemap_fields", f"WITH {I.ENTRY_CTE} SELECT loc, lastmod, changefreq, priority FROM e")
def parse_sitemap_fields_query(spark, sf):
    p = I.table(spark, sf, "pages").select(*[F.expr(sql).alias(name) for name, sql in I.ENTRY_SQL.items()])
    raw = p.select(
        F.concat(F.lit("\n\t"), "loc").alias("loc"), F.concat(F.lit(" "), "lastmod").alias("lastmod"),
        F.upper("changefreq").alias("changefreq"),
        F.coalesce(F.col("priority").cast("string"), F.lit("high")).alias("priority"),
    )
    return parse_sitemap_fields(raw)


@query("sitemap_to_documents", f"""
WITH {I.ENTRY_CTE}
SELECT loc AS doc_id, loc AS source, 'web_page' AS content_type, '' AS content, lastmod AS last_modified,
       changefreq AS change_frequency, priority,
       CASE WHEN page_id % 3 = 0 THEN concat(loc, '/cover.png') END AS image_loc, CAST(NULL AS VARCHAR) AS video_title FROM e""")
def sitemap_to_documents(spark, sf):
    return sitemap_documents(I.entries(spark, sf), include_videos=False).select(
        "doc_id", "source", "content_type", "content", "last_modified", "change_frequency", "priority",
        F.get("images", F.lit(0)).getField("loc").alias("image_loc"),
        F.get("videos", F.lit(0)).getField("title").alias("video_title"),
    )


@query("sitemap_entry_json", f"""
WITH {I.ENTRY_CTE}
SELECT loc, concat('{{"loc":"', replace(loc, '/', '/'), '","lastmod":"', lastmod, '","changefreq":"', changefreq, '","priority":',
  coalesce(CAST(priority AS VARCHAR), 'null'), ',"images":',
  CASE WHEN page_id % 3 = 0 THEN concat('[{{"loc":"', loc, '/cover.png","caption":null,"geo_location":null,"title":"Cover ', page_id, '","license":null}}]') ELSE '[]' END,
  ',"videos":',
  CASE WHEN page_id % 5 = 0 THEN concat('[{{"thumbnail_loc":null,"title":"Clip ', page_id, '","description":null,"content_loc":null,"player_loc":null,"duration":',
    CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE 'null' END, '}}]') ELSE '[]' END, '}}') AS entry_json FROM e""")
def sitemap_entry_json_query(spark, sf):
    return sitemap_entry_json(I.entries(spark, sf)).select("loc", "entry_json")


@query("crawl_success", f"SELECT url FROM pages WHERE {I.PAGE_STATUS} = 200")
def crawl_success_query(spark, sf):
    responses = I.page_responses(spark, sf).select("url", "status", "content_type", F.lit(None).cast("string").alias("error"))
    return crawl_success(responses).select("url")


@query("save_pages", f"""
SELECT {_FILENAME} AS filename, {_EXTENSION} AS ext, md5(html) AS content_md5 FROM pages""")
def save_pages_query(spark, sf):
    from gleanery.session import scratch_path
    from gleanery.sources.responses import save_pages

    path = scratch_path(spark, "pages")
    save_pages(I.page_responses(spark, sf), path, position="page_id")
    return spark.read.schema("filename string, content string, ext string").parquet(path).select(
        "filename", "ext", F.md5("content").alias("content_md5")
    )
