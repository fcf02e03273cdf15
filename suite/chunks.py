"""Chunking and embedding (D, E, H3, N2)."""

from pyspark.sql import functions as F

from gleanery import schema
from gleanery.operators import chunking as C
from gleanery.operators import embedding as E
from gleanery.session import cut_lineage
from gleanery.functions.sql import register_chunkers
from suite import inputs as I
from suite import query
from suite.splitter_sql import splitter_query

SIZE, OVERLAP = schema.DEFAULT_CHUNK_SIZE, schema.DEFAULT_CHUNK_OVERLAP
DOCS_CTE = "docs AS (SELECT doc_id, 0 AS section_index, text FROM documents)"


def _shown(chunks):
    return chunks.select(
        "doc_id", I.big("chunk_index").alias("chunk_index"), I.big("chunk_count").alias("chunk_count"),
        I.big("start").alias("start"), I.big(F.length("content")).alias("n_chars"), F.md5("content").alias("content_md5"),
    )


@query("route_chunker", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'code' WHEN 2 THEN 'sections' ELSE 'text' END AS semantic,
       CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'code' WHEN 2 THEN 'markdown' ELSE 'text' END AS fixed FROM documents""")
def route_chunker(spark, sf):
    kind = F.expr("CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'csharp' WHEN 2 THEN 'markdown' WHEN 3 THEN 'html' ELSE 'text' END")
    return I.table(spark, sf, "documents").select(
        "doc_id", C.route_chunker(kind).alias("semantic"), C.route_chunker(kind, "fixed").alias("fixed")
    )


@query("chunk_text", splitter_query(DOCS_CTE, "docs", schema.TEXT_SEPARATORS, SIZE, OVERLAP))
def chunk_text(spark, sf):
    return _shown(C.chunk_documents(I.documents(spark, sf), "text"))


@query("chunk_offsets", splitter_query(DOCS_CTE, "docs", schema.TEXT_SEPARATORS, 300, 60))
def chunk_offsets(spark, sf):
    return _shown(C.chunk_documents(I.documents(spark, sf), "text", 300, 60))


CODE_CTE = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
docs AS (SELECT doc_id, 0 AS section_index, string_agg(concat(
    CASE WHEN i % 5 = 0 THEN concat(chr(10), 'class C', i, ':', chr(10)) ELSE '' END,
    chr(10), 'def f', i, '():', chr(10), '    return ''', line, '''', chr(10)), '' ORDER BY i) AS text FROM lines GROUP BY doc_id)"""


@query("chunk_python", splitter_query(CODE_CTE, "docs", schema.PYTHON_SEPARATORS, 400, 80))
def chunk_python(spark, sf):
    return _shown(C.chunk_documents(I.code_documents(spark, sf), "python", 400, 80))


@query("chunk_code_generic", splitter_query(CODE_CTE, "docs", schema.CODE_SEPARATORS, 400, 80))
def chunk_code_generic(spark, sf):
    return _shown(C.chunk_documents(I.code_documents(spark, sf), "code", 400, 80))


WHOLE_MARKDOWN_CTE = f"""{I.MARKDOWN_CTE},
docs AS (SELECT doc_id, 0 AS section_index, string_agg(section_text, '' ORDER BY sections.section_index) AS text
         FROM sections GROUP BY doc_id)"""


@query("chunk_markdown", splitter_query(WHOLE_MARKDOWN_CTE, "docs", schema.MARKDOWN_SEPARATORS, 300, 60))
def chunk_markdown(spark, sf):
    return _shown(C.chunk_documents(I.markdown_documents(spark, sf), "markdown", 300, 60))


@query("chunk_custom", splitter_query(DOCS_CTE, "docs", [". ", ", ", " ", ""], 500, 100))
def chunk_custom(spark, sf):
    return _shown(C.chunk_documents(I.documents(spark, sf), "text", 500, 100, separators=[". ", ", ", " ", ""]))


@query("split_sections", f"""
WITH {I.MARKDOWN_CTE}
SELECT doc_id, CAST(section_index AS BIGINT) AS section_index, CAST(header_level AS BIGINT) AS header_level, header_text,
       md5(section_text) AS section_md5 FROM sections""")
def split_sections(spark, sf):
    return C.split_sections(I.markdown_documents(spark, sf)).select(
        "doc_id", I.big("section_index").alias("section_index"), I.big("header_level").alias("header_level"),
        "header_text", F.md5("section_text").alias("section_md5"),
    )


SECTION_CHUNKS_SQL = splitter_query(
    I.MARKDOWN_CTE + ", docs AS (SELECT doc_id, section_index, section_text AS text FROM sections)",
    "docs", schema.MARKDOWN_SEPARATORS, 300, 60,
)


@query("chunk_sections", SECTION_CHUNKS_SQL)
def chunk_sections(spark, sf):
    return _shown(C.chunk_documents(I.markdown_documents(spark, sf), "sections", 300, 60))


@query("renumber_chunks", SECTION_CHUNKS_SQL)
def renumber_chunks(spark, sf):
    chunks = C.chunk_documents(I.markdown_documents(spark, sf), "sections", 300, 60)
    return _shown(C.renumber_chunks(cut_lineage(chunks.drop("chunk_id", "chunk_index", "chunk_count"))))


@query("number_chunks", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) - 1 AS chunk_index, len(ls) AS chunk_count FROM l)
SELECT doc_id, concat(doc_id, '_chunk_', chunk_index) AS chunk_id, CAST(chunk_index AS BIGINT) AS chunk_index,
       CAST(chunk_count AS BIGINT) AS chunk_count, md5(content) AS content_md5 FROM x""")
def number_chunks(spark, sf):
    lines = I.documents(spark, sf).select("doc_id", F.split("content", "\n").alias("pieces"))
    return C.number_chunks(lines).select(
        "doc_id", "chunk_id", I.big("chunk_index").alias("chunk_index"), I.big("chunk_count").alias("chunk_count"),
        F.md5("content").alias("content_md5"),
    )


FIXED_CTE = f"""
fixed AS (SELECT doc_id, i, substr(text, CAST(i * {SIZE - OVERLAP} + 1 AS BIGINT), {SIZE}) AS content,
                 ceil(greatest(length(text) - {OVERLAP}, 1) / {SIZE - OVERLAP}.0) AS n
          FROM documents, generate_series(0, (SELECT coalesce(max(length(text)) // 800, 0) FROM documents)) AS g(i)
          WHERE text <> '' AND i * {SIZE - OVERLAP} <= greatest(length(text) - {OVERLAP} - 1, 0))"""


@query("chunk_fixed", f"""
WITH {FIXED_CTE}
SELECT doc_id, concat(doc_id, '_chunk_', i) AS chunk_id, i AS chunk_index, CAST(n AS BIGINT) AS chunk_count,
       CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS content_md5 FROM fixed""")
def chunk_fixed(spark, sf):
    return C.chunk_fixed(I.documents(spark, sf)).select(
        "doc_id", "chunk_id", I.big("chunk_index").alias("chunk_index"), I.big("chunk_count").alias("chunk_count"),
        I.big(F.length("content")).alias("n_chars"), F.md5("content").alias("content_md5"),
    )


@query("chunk_by_tokens", """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ts FROM documents),
w AS (SELECT doc_id, ts, unnest(range(0, greatest(len(ts) - 20, 1), 80)) AS p FROM t WHERE len(ts) > 0)
SELECT doc_id, p // 80 AS chunk_index, md5(array_to_string(ts[p + 1 : p + 100], ' ')) AS content_md5 FROM w""")
def chunk_by_tokens(spark, sf):
    return C.chunk_by_tokens(I.documents(spark, sf), 100, 20).select(
        "doc_id", I.big("chunk_index").alias("chunk_index"), F.md5("content").alias("content_md5")
    )


def bag_of_words_ctes(source: str, keys: str, dimension: int) -> str:
    """CTEs ending in ``v(keys, dim, x)``: nonzero vector entries of ``source(keys, text)``."""
    return f"""
tok AS (SELECT {keys}, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+')) AS token FROM {source}),
cnt AS (SELECT {keys}, CAST(concat('0x', substr(md5(token), 1, 8)) AS BIGINT) % {dimension} AS dim, count(*) AS n
        FROM tok WHERE token <> '' GROUP BY ALL),
v AS (SELECT {keys}, dim, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS FLOAT) AS x FROM cnt)"""


@query("embed_chunks", f"""
WITH {FIXED_CTE}, src AS (SELECT concat(doc_id, '_chunk_', i) AS chunk_id, content AS text FROM fixed),
{bag_of_words_ctes('src', 'chunk_id', 384)}
SELECT chunk_id, count(dim) AS n_nonzero, CAST(384 AS BIGINT) AS dimension,
       round(coalesce(sum(CAST(x AS DOUBLE) * (dim + 1)), 0), 5) AS fingerprint FROM src LEFT JOIN v USING (chunk_id) GROUP BY chunk_id""")
def embed_chunks(spark, sf):
    """Summary of every chunk's vector, over all its entries; a chunk of blanks has a vector of zeros."""
    vectors = E.embed_chunks(C.chunk_fixed(I.documents(spark, sf)).select("chunk_id", "content"))
    return vectors.select("chunk_id", "vector").select(
        "chunk_id",
        I.big(F.size(F.filter("vector", lambda x: x != 0))).alias("n_nonzero"),
        I.big(F.size("vector")).alias("dimension"),
        F.round(F.aggregate(
            F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b
        ), 5).alias("fingerprint"),
    )


@query("check_dimension", """
SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN 'expected 64 values, got 0' WHEN vec_id % 10 = 0 THEN 'expected 64 values, got 63' ELSE 'accepted' END AS outcome
FROM embeddings""")
def check_dimension(spark, sf):
    e = I.table(spark, sf, "embeddings").select(
        "vec_id",
        F.expr("CASE WHEN vec_id % 17 = 0 THEN NULL WHEN vec_id % 10 = 0 THEN slice(embedding, 1, 63) ELSE embedding END").alias("vector"),
    )
    accepted, rejected = E.check_dimension(e, 64)
    return accepted.select("vec_id", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("vec_id", F.col("reason").alias("outcome"))
    )


@query("embed_query", f"""
WITH src AS (SELECT item_id AS query_id, text FROM benchmark), {bag_of_words_ctes('src', 'query_id', 384)}
SELECT query_id, count(*) AS n_nonzero, round(sum(CAST(x AS DOUBLE)), 5) AS total FROM v GROUP BY query_id""")
def embed_query(spark, sf):
    q = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return E.embed_query(q, E.hashed_bag_of_words()).select(
        "query_id",
        I.big(F.size(F.filter("vector", lambda x: x != 0))).alias("n_nonzero"),
        F.round(F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b), 5).alias("total"),
    )


def letter_counts():
    """A caller's own model: how often each vowel occurs, as a share of the text."""
    import numpy as np

    def embed(texts):
        return np.array([[t.count(c) / max(len(t), 1) for c in "aeiou"] for t in texts])

    return embed


@query("custom_embedder", """
SELECT item_id, """ + ", ".join(
    f"round(CAST(CAST((length(text) - length(replace(text, '{c}', ''))) / CAST(length(text) AS DOUBLE) AS FLOAT) AS DOUBLE), 6) AS share_{c}" for c in "aeiou"
) + " FROM benchmark")
def custom_embedder(spark, sf):
    v = E.embed_chunks(I.table(spark, sf, "benchmark"), letter_counts, text="text")
    return v.select("item_id", *[F.round(F.col("vector")[i].cast("double"), 6).alias(f"share_{c}") for i, c in enumerate("aeiou")])


@query("chunk_by_sql", f"""
SELECT 'text' AS kind, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, content_md5 FROM ({splitter_query(DOCS_CTE, "docs", schema.TEXT_SEPARATORS, SIZE, OVERLAP)})
UNION ALL SELECT 'custom', doc_id, CAST(chunk_index AS BIGINT), content_md5 FROM ({splitter_query(DOCS_CTE, "docs", [". ", ", ", " ", ""], 500, 100)})
UNION ALL SELECT 'windows', doc_id, i, md5(substr(text, i * 250 + 1, 300))
  FROM documents, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 250.0) AS BIGINT), 1))) AS g(i) WHERE text <> ''
UNION ALL SELECT 'tokens', doc_id, i, md5(array_to_string(ts[i * 40 + 1 : (i + 1) * 40], ' '))
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ts FROM documents),
    unnest(range(0, CAST(ceil(len(ts) / 40.0) AS BIGINT))) AS g(i)""")
def chunk_by_sql(spark, sf):
    """The chunkers called from Spark SQL."""
    register_chunkers(spark)
    I.documents(spark, sf).createOrReplaceTempView("gleanery_documents")
    exploded = "FROM (SELECT doc_id, {} AS cs FROM gleanery_documents) LATERAL VIEW OUTER posexplode(cs) t AS chunk_index, c WHERE c IS NOT NULL"
    calls = {
        "text": ("c.content", "chunk_recursive(content, 'text', 1000, 200, NULL)"),
        "custom": ("c.content", "chunk_recursive(content, NULL, 500, 100, array('. ', ', ', ' ', ''))"),
        "windows": ("c", "chunk_windows(content, 300, 50)"),
        "tokens": ("c", "chunk_tokens(content, 40, 0)"),
    }
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{kind}' AS kind, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, md5({shown}) AS content_md5 " + exploded.format(call)
        for kind, (shown, call) in calls.items()
    ))
