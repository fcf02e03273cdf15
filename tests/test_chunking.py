import pytest
from pyspark.sql import functions as F

from gleanery.operators import chunking as C

MARKDOWN = (
    "# Title\n\nSome opening words about the document.\n\n"
    "## Section 1\n\nThe first section has some `inline code` in it.\n\n"
    "## Section 2\n\nThe second section closes the document.\n"
)


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, content string, title string")


def test_sections_keep_their_header_line(spark):
    rows = C.split_sections(docs(spark, ("d", MARKDOWN, "t"))).orderBy("section_index").collect()
    assert [(r.header_level, r.header_text) for r in rows] == [(1, "Title"), (2, "Section 1"), (2, "Section 2")]
    assert "".join(r.section_text for r in rows) == MARKDOWN


def test_preamble_fences_setext_and_trailing_marks(spark):
    text = (
        "before\n# A ##\n```py\n# no header\n```\n~~~\n## no\n~~~\nText\n====\nx\n\nSub\n---\n"
        "- item\n---\n#tag is no header\n####### seven\n### \n```\n# after an unclosed fence\n"
    )
    rows = C.split_sections(docs(spark, ("d", text, "t"))).orderBy("section_index").collect()
    assert [(r.header_level, r.header_text) for r in rows] == [
        (None, None), (1, "A"), (1, "Text"), (2, "Sub"), (3, ""), (1, "after an unclosed fence"),
    ]
    assert "".join(r.section_text for r in rows) == text


def test_very_long_documents_do_not_exhaust_the_stack(spark):
    text = "".join(f"# h{i}\n" + "a line of text\n" * 50 for i in range(4000)) + "```\n" + "x\n" * 20000
    assert C.split_sections(docs(spark, ("d", text, "t"))).count() == 4000
    assert C.split_sections(docs(spark, ("d", "word\n" * 300000, "t"))).count() == 1


def test_section_chunks_number_the_whole_document(spark):
    chunks = C.chunk_documents(docs(spark, ("d", MARKDOWN, "t")), "sections", 100, 20).orderBy("chunk_index").collect()
    assert [c.chunk_index for c in chunks] == [0, 1, 2] and {c.chunk_count for c in chunks} == {3}
    assert [c.chunk_id for c in chunks] == ["d_chunk_0", "d_chunk_1", "d_chunk_2"]
    assert [c.header_text for c in chunks] == ["Title", "Section 1", "Section 2"]
    for c in chunks:
        assert sum(line.startswith("#") for line in c.content.split("\n")) == 1 and c.content.startswith("#")
        assert MARKDOWN[c.start:].startswith(c.content)


def test_single_section_keeps_metadata(spark):
    row = C.chunk_documents(docs(spark, ("d1", "# Test\n\nOne line.", "Test Document")), "sections", 100, 20).collect()
    assert len(row) == 1
    assert (row[0].doc_id, row[0].title, row[0].chunk_index, row[0].chunk_count) == ("d1", "Test Document", 0, 1)


def test_router(spark):
    rows = spark.sql("SELECT explode(array('markdown','python','csharp','text','html')) AS t")
    got = {r.t: (r.a, r.b) for r in rows.select(
        "t", C.route_chunker(F.col("t")).alias("a"), C.route_chunker(F.col("t"), "fixed").alias("b")).collect()}
    assert got == {
        "markdown": ("sections", "markdown"), "python": ("python", "python"), "csharp": ("code", "code"),
        "text": ("text", "text"), "html": ("text", "text"),
    }


def test_routed_documents_and_per_row_sizes(spark):
    d = spark.createDataFrame(
        [("a", MARKDOWN, "markdown", 100, 20), ("b", "x " * 100, "text", 50, 0), ("c", "", "text", 50, 0)],
        "doc_id string, content string, content_type string, size int, overlap int",
    )
    chunks = C.chunk_documents(d, C.route_chunker(F.col("content_type")), F.col("size"), F.col("overlap"))
    counts = {r.doc_id: r["count"] for r in chunks.groupBy("doc_id").count().collect()}
    assert counts == {"a": 3, "b": 4}


@pytest.mark.parametrize("length", [0, 1, 19, 20, 21, 25, 35, 36, 50, 51, 200])
def test_fixed_windows(spark, length):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(97 + i % 26) for i in range(length))
    size, overlap = 20, 5
    starts = range(0, max(length - overlap - 1, 0) + 1, size - overlap) if length else []
    got = C.chunk_fixed(docs(spark, ("d", text, "t")), size, overlap).orderBy("chunk_index").collect()
    assert [g.content for g in got] == [text[s:s + size] for s in starts]
    assert all(g.chunk_count == len(got) for g in got)


@pytest.mark.parametrize("count,size,overlap", [(0, 3, 1), (1, 3, 1), (3, 3, 1), (4, 3, 1), (10, 4, 0), (11, 4, 3)])
def test_token_windows(spark, count, size, overlap):
    tokens = [f"w{i}" for i in range(count)]
    starts = range(0, max(count - overlap, 1), size - overlap) if count else []
    got = C.chunk_by_tokens(docs(spark, ("d", " \n" + " \t".join(tokens) + "  ", "t")), size, overlap)
    assert [g.content for g in got.orderBy("chunk_index").collect()] == [" ".join(tokens[s:s + size]) for s in starts]


def test_renumber_matches_direct_numbering_beyond_one_block(spark, monkeypatch):
    from gleanery.operators import ordering

    monkeypatch.setattr(ordering, "_BLOCK", 2)
    text = "".join(f"# h{i}\n" + "some words " * (i % 4 * 5) + "\n" for i in range(15))
    direct = C.chunk_documents(docs(spark, ("d", text, "t"), ("e", MARKDOWN, "t")), "sections", 60, 10)
    again = C.renumber_chunks(direct.drop("chunk_id", "chunk_index", "chunk_count"))
    assert sorted(map(tuple, again.select(direct.columns).collect()), key=str) == sorted(map(tuple, direct.collect()), key=str)


def test_output_does_not_depend_on_partitioning(spark):
    d = docs(spark, *[(str(i), MARKDOWN * (i % 5 + 1), "t") for i in range(30)])
    one = C.chunk_documents(d.coalesce(1), "sections", 60, 10).collect()
    many = C.chunk_documents(d.repartition(7), "sections", 60, 10).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_python_runs_once_per_document(spark):
    plan = C.chunk_documents(docs(spark, ("d", MARKDOWN, "t")), "sections")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_overlap_larger_than_size_is_refused(spark):
    with pytest.raises(ValueError):
        C.chunk_documents(docs(spark), "text", 100, 200)


def test_documents_are_chunked_as_they_ask(spark):
    text = "One two three. Four five six. Seven eight nine."
    rows = [("r", 20, 5, None, "recursive"), ("f", 20, 5, None, "fixed"), ("same", 20, 20, None, "fixed"), ("t", 20, 5, 4, "fixed")]
    df = spark.createDataFrame([(*r, text, "text") for r in rows], "doc_id string, chunk_size int, chunk_overlap int, max_tokens int, strategy string, content string, content_type string")
    found = {}
    for r in C.chunk_as_asked(df).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append(r.content)
    assert found["f"] == [text[i : i + 20] for i in (0, 15, 30)]
    assert found["same"] == [text[i : i + 20] for i in range(len(text) - 19)]
    assert found["t"] == ["One two three. Four", "five six. Seven eight", "nine."]
    plain = C.chunk_documents(df.where("doc_id = 'r'"), "text", 20, 5).orderBy("chunk_index").collect()
    assert found["r"] == [r.content for r in plain]


def test_chunkers_in_sql(spark):
    from gleanery.functions.sql import register_chunkers

    register_chunkers(spark)
    text = "# One\nsome words here\n\n## Two\n" + "x" * 30
    docs = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "doc_id string, content string")
    docs.createOrReplaceTempView("some_documents")
    rows = spark.sql(
        "SELECT doc_id, i, c.start, c.content FROM some_documents LATERAL VIEW OUTER posexplode(chunk_recursive(content, 'markdown', 20, 4, NULL)) t AS i, c WHERE c IS NOT NULL"
    ).collect()
    direct = C.chunk_documents(docs, "markdown", 20, 4).select("doc_id", "chunk_index", "start", "content").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, direct)) and len(rows) > 3
    one = spark.sql("SELECT markdown_sections(content) AS s, chunk_windows(content, 5, 5) AS w, chunk_windows(content, 10, 2) AS x, chunk_tokens(content, 2, 1) AS t, "
                    "chunk_recursive(content, NULL, 10, 0, NULL) AS n FROM some_documents WHERE doc_id = 'a'").first()  # fmt: skip
    assert "".join(one.s) == text and len(one.s) == 2 and one.w is None and one.n == []
    assert one.x == [r.content for r in C.chunk_fixed(docs.where("doc_id = 'a'"), 10, 2).orderBy("chunk_index").collect()]
    assert one.t == [r.content for r in C.chunk_by_tokens(docs.where("doc_id = 'a'"), 2, 1).orderBy("chunk_index").collect()]
