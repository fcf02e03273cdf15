"""The recursive splitter's contract in SQL, written without looking at the Spark side.

Every separator level turns segments into pieces; pieces shorter than the size
form runs, longer ones go to the next level. A run is packed by a recursive
query that finds the furthest edge within the size, then the first edge that
respects overlap and room for the next piece.
"""


def _literal(text: str) -> str:
    parts = text.replace("\n", "\x00n").replace("\t", "\x00t").split("\x00")
    out = [f"'{parts[0]}'"] if parts[0] else []
    for part in parts[1:]:
        out.append("chr(10)" if part[0] == "n" else "chr(9)")
        if part[1:]:
            out.append(f"'{part[1:]}'")
    return f"concat({', '.join(out)})"


def splitter_ctes(source: str, separators: list[str], size: int, overlap: int) -> str:
    """CTEs ending in ``chunked(doc_id, section_index, lo, start, content)``.

    ``source`` is a CTE with (doc_id, section_index, text), one row per text
    that is split on its own. The last separator must be the empty string.
    """
    levels = [s for s in separators if s]
    ctes = [f"seg0 AS (SELECT doc_id, section_index, CAST(0 AS BIGINT) AS lo, text FROM {source} WHERE text <> '')"]
    for i, separator in enumerate(levels):
        sep = _literal(separator)
        width = len(separator)
        ctes.append(f"""
parts{i} AS (SELECT doc_id, section_index, lo, unnest(string_split(text, {sep})) AS part,
    generate_subscripts(string_split(text, {sep}), 1) AS n FROM seg{i} WHERE contains(text, {sep})),
pieces{i} AS (SELECT doc_id, section_index, lo AS seg, n,
    CASE WHEN n = 1 THEN part ELSE concat({sep}, part) END AS piece,
    lo + coalesce(sum(length(part) + CASE WHEN n = 1 THEN 0 ELSE {width} END) OVER
      (PARTITION BY doc_id, section_index, lo ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM parts{i}),
marked{i} AS (SELECT *, length(piece) >= {size} AS long,
    sum(CASE WHEN length(piece) >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section_index, seg ORDER BY n) AS run
    FROM pieces{i} WHERE piece <> ''),
runs{i} AS (SELECT doc_id, section_index, list_append(list(CAST(lo AS BIGINT) ORDER BY n), CAST(max(lo + length(piece)) AS BIGINT)) AS edges
    FROM marked{i} WHERE NOT long GROUP BY doc_id, section_index, seg, run),
seg{i + 1} AS (SELECT doc_id, section_index, CAST(lo AS BIGINT) AS lo, piece AS text FROM marked{i} WHERE long
    UNION ALL SELECT doc_id, section_index, lo, text FROM seg{i} WHERE NOT contains(text, {sep}))""")
    last = len(levels)
    runs = [f"SELECT * FROM runs{i}" for i in range(last)]
    runs.append(f"SELECT doc_id, section_index, range(lo, lo + length(text) + 1) AS edges FROM seg{last}")
    ctes.append("runs AS (" + " UNION ALL ".join(runs) + ")")
    within = "len(list_filter(edges, lambda e: e <= edges[{at}] + " + str(size) + "))"
    ctes.append(f"""
packed AS (
  SELECT doc_id, section_index, edges, CAST(1 AS BIGINT) AS first, {within.format(at='1')} AS last FROM runs
  UNION ALL
  SELECT doc_id, section_index, edges, first, {within.format(at='first')} AS last FROM (
    SELECT doc_id, section_index, edges,
      len(list_filter(edges, lambda e: e < greatest(edges[last] - {overlap}, edges[last + 1] - {size}))) + 1 AS first
    FROM packed WHERE last < len(edges)) AS advanced),
spans AS (SELECT p.doc_id, p.section_index, edges[first] AS lo,
    substr(s.text, CAST(edges[first] + 1 AS BIGINT), CAST(edges[last] - edges[first] AS BIGINT)) AS raw
    FROM packed p JOIN {source} s ON p.doc_id = s.doc_id AND p.section_index = s.section_index),
chunked AS (SELECT doc_id, section_index, lo, lo + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start,
    regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') AS content
    FROM spans WHERE regexp_replace(raw, '\\s+', '', 'g') <> '')""")
    return ",\n".join(ctes)


def splitter_query(source_ctes: str, source: str, separators: list[str], size: int, overlap: int) -> str:
    """Chunks with document-wide numbering, start and content hash."""
    return f"""
WITH RECURSIVE {source_ctes},
{splitter_ctes(source, separators, size, overlap)},
base AS (SELECT doc_id, section_index, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY section_index
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source})
SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.section_index, c.lo) - 1 AS chunk_index,
       count(*) OVER (PARTITION BY c.doc_id) AS chunk_count, CAST(b.before + c.start AS BIGINT) AS start,
       CAST(length(c.content) AS BIGINT) AS n_chars, md5(c.content) AS content_md5
FROM chunked c JOIN base b ON b.doc_id = c.doc_id AND b.section_index = c.section_index"""
