"""The registered queries of the operators, with their SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import functions as F

from gleanery.llm import licenses as L
from gleanery.llm.chats import chat_packs
from gleanery.llm.collocations import collocations
from gleanery.llm.common import LOWER, UPPER, table
from gleanery.llm.contamination import contamination
from gleanery.llm.exact_duplicates import exact_duplicates
from gleanery.llm.hard_negatives import hard_negatives
from gleanery.llm.kmeans_tree import tree_neighbours
from gleanery.llm.languages import fit_languages, identify_languages
from gleanery.llm.near_duplicates import near_duplicates
from gleanery.llm.pieces import encode_pieces, load_pieces
from gleanery.llm.secrets import joined_spans, secrets
from gleanery.llm.token_shards import token_shards
from gleanery.llm.url_rules import url_rules

#: Files of public tokenizers.
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECE_MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


@query("op1_token_shards")
def op1_token_shards(spark, sf):
    return token_shards(table(spark, sf, "documents"), BYTE_BPE)


@query("op2_near_duplicates", f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({folded('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS t
  FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM p JOIN n AS x ON p.a = x.doc_id JOIN n AS y ON p.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, edge.b FROM reach JOIN edge ON reach.y = edge.a),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON d.doc_id = c.x LEFT JOIN n ON d.doc_id = n.doc_id""")
def op2_near_duplicates(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


@query("op3_pieces")
def op3_pieces(spark, sf):
    return encode_pieces(table(spark, sf, "documents"), load_pieces(PIECE_MODEL))


#: The contract's rules: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("op4_url_rules", f"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(h, p, action) AS (VALUES {', '.join(map(str, URL_RULES))}),
m AS (
  SELECT r, h || p AS rule, action, row_number() OVER (PARTITION BY r ORDER BY len(h) + len(p) DESC, len(h) DESC, action DESC) AS k
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) AS b USING (r)""")
def op4_url_rules(spark, sf):
    return url_rules(table(spark, sf, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, action string"))


@query("op5_contamination", f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({folded('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({folded('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t
  FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), occ AS (SELECT r, i, n, item_id FROM place JOIN win USING (n, t)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, i, n FROM occ), unnest(range(i, i + n)) AS u(j) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""")
def op5_contamination(spark, sf):
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query("op6_exact_duplicates", f"""
WITH d AS (SELECT doc_id, sha256({folded('text')}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op6_exact_duplicates(spark, sf):
    return exact_duplicates(table(spark, sf, "documents"), keep="largest")


@query("op7_secrets")
def op7_secrets(spark, sf):
    found = secrets(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["layer"] == "")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans("spans").alias("spans"),
    )


def remainder(column: str):
    return F.crc32(F.col(column).cast("string")) % 5


@query("op8_languages")
def op8_languages(spark, sf):
    docs = table(spark, sf, "documents")
    model = fit_languages(docs.filter((remainder("doc_id") != 0) & F.col("lang").isNotNull()))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select(
        "row.doc_id", (F.coalesce(remainder("row.doc_id"), F.lit(0)) == 0).alias("held_out"), "lang_pred", "score", "rejected"
    )


def _escaped(column: str) -> str:
    return rf"replace(replace(replace({column}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"


SAID = r"\### Assistant: </turn> ok"


@query("op9_chats", rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({_escaped('text')}) + length(replace({_escaped('role')}, ': ', '\: ')) + 15) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""")
def op9_chats(spark, sf):
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], "conv_id bigint, turn bigint, role string, text string")
    found = chat_packs(talks.unionByName(added), BYTE_BPE)
    turns = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return found.select(
        "conv_id", F.size("roles").cast("bigint").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


_BIGRAMS = """CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"""


@query("op10_licenses", f"""
WITH tpl AS (
  SELECT license, {_BIGRAMS} AS b FROM (
    SELECT license, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM (VALUES {', '.join(map(str, L.TEMPLATES.items()))}) AS v(license, t))
), line AS (
  SELECT r, i, {_BIGRAMS} AS b FROM (
    SELECT r, i, regexp_extract_all(lower(c), '[a-z0-9]+') AS w FROM (
      SELECT r, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM (SELECT row_number() OVER () AS r, coalesce(text, '') AS text FROM documents)))
), shared AS (
  SELECT r, i, license, len(l.b) AS m, len(t.b) AS n, len(list_intersect(l.b, t.b)) AS c
  FROM line AS l JOIN tpl AS t ON len(l.b) BETWEEN len(t.b) * 0.6 AND len(t.b) / 0.6
  WHERE len(l.b) > 0
), best AS (
  SELECT *, 2 * c / (m + n) AS dice, row_number() OVER (PARTITION BY r, i ORDER BY 2 * c / (m + n) DESC, license) AS k
  FROM shared WHERE 2 * c / (m + n) >= 0.75
), found AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
    max(dice) AS best_dice, arg_min(license, (-dice, license)) AS best_license
  FROM best WHERE k = 1 GROUP BY r
)
SELECT doc_id, coalesce(n, 0) AS n_matches, licenses, best_license, best_dice
FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN found USING (r)""")
def op10_licenses(spark, sf):
    return L.licenses(table(spark, sf, "documents"))


@query("op11_neighbours")
def op11_neighbours(spark, sf):
    return tree_neighbours(table(spark, sf, "embeddings"), "id % 20 = 0")


@query("op12_collocations", f"""
WITH piece AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(c, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({folded('text')}, '[.,;:!?\\x0A-\\x0D]')) AS c FROM documents)
), f AS (
  SELECT lang, phrase, m, count(*) AS f FROM (
    SELECT lang, m, w[i : i + m - 1] AS phrase FROM piece, unnest([1, 2, 3, 4, 5]) AS s(m), unnest(range(1, len(w) - m + 2)) AS u(i) WHERE len(w) >= m
  ) GROUP BY ALL HAVING count(*) >= 100
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang),
held AS (
  SELECT DISTINCT lang, phrase[i : i + k - 1] AS phrase, f FROM f, unnest([2, 3, 4]) AS s(k), unnest(range(1, m - k + 2)) AS u(i) WHERE m > k
), longest AS (SELECT lang, phrase, max(f) AS f FROM held GROUP BY ALL),
cut AS (
  SELECT c.lang, c.phrase, k, c.f AS a, x.f AS l, y.f AS r, n,
    (1000 * CAST(c.f AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM f AS c JOIN total USING (lang), unnest(range(1, c.m)) AS u(k)
  JOIN f AS x ON x.lang = c.lang AND x.phrase = c.phrase[1 : k] JOIN f AS y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1 :]
  WHERE c.m >= 2
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM cut
), ranked AS (
  SELECT b.lang, array_to_string(b.phrase, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM best AS b LEFT JOIN longest AS g ON g.lang = b.lang AND g.phrase = b.phrase WHERE j = 1 AND (g.f IS NULL OR g.f < a)
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) WHERE rank <= 2000""")
def op12_collocations(spark, sf):
    return collocations(table(spark, sf, "documents"))


@query("op13_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
    CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10""")
def op13_hard_negatives(spark, sf):
    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return hard_negatives(table(spark, sf, "embeddings"), "id % 100 = 0", label=label)
