import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators import summaries as G
from gleanery.operators import validation as V
from gleanery.operators.embedding import hashed_bag_of_words
from gleanery.plans.ingest import failed_sources, ingest_documents, ingest_requests, write_job_log
from gleanery.session import scratch_path
from gleanery.sources import direct as D
from gleanery.sources.collection import Collection, collection_rows
from gleanery.streaming import ingest as M

CHUNKS = "doc_id string, chunk_id string, content string, content_type string, source string, chunk_index int, chunk_count int, vector array<float>"


def chunks(spark, *rows):
    return spark.createDataFrame(
        [(d, c, f"text {c}", t, "it's", i, 2, v) for d, c, t, i, v in rows], CHUNKS
    )


@pytest.fixture
def collection(spark):
    return Collection(spark, scratch_path(spark, "test"), 2).create()


ROWS = [("d1", "a", "python", 1, [1.0, 2.0]), ("d1", "b", "python", 0, [1.0, 2.0]), ("d2", "c", "text", 0, [3.0, 4.0]),
        (None, None, "text", 0, [5.0, 6.0]), ("d3", "bad", "text", 0, [1.0])]


def test_append_and_read_back(spark, collection):
    ids = collection.append(chunks(spark, *ROWS), embedding_model="m", content_types=["python", "text"])
    assert ids.count() == 4 and {r.chunk_id for r in ids.where("chunk_id in ('a','b','c')").collect()} == {"a", "b", "c"}
    rows = collection.read()
    assert {r.doc_id for r in rows.collect()} == {"d1", "d2", ""} and rows.where("chunk_id is null").count() == 0
    assert collection.append(chunks(spark, ("d9", "z", "html", 0, [0.0, 0.0])), content_types=["text"]).count() == 0
    assert collection.scan("metadata.chunk_index = 1", ["chunk_id"], {"source": "it's"}).first().chunk_id == "a"


def test_writing_a_batch_again_replaces_it(spark, collection):
    for _ in range(2):
        collection.append(chunks(spark, *ROWS), batch="b-1")
    collection.append(chunks(spark, ROWS[0]), batch="b-2")
    assert collection.read().count() == 5


def test_delete_hides_only_what_was_there(spark, collection):
    collection.append(chunks(spark, *ROWS))
    assert collection.delete_document("d1") is True
    assert collection.delete_document("d1") is False and collection.delete_document("nobody") is False
    assert {r.doc_id for r in collection.read().collect()} == {"d2", ""}
    collection.append(chunks(spark, ROWS[0]))
    assert collection.read().where("doc_id = 'd1'").count() == 1
    stats = collection.stats().first()
    assert (stats.chunks, stats.documents, stats.dimension) == (3, 3, 2)


def test_compaction_and_search(spark, collection):
    collection.append(chunks(spark, *ROWS))
    collection.delete_document("d1")
    smaller = collection.compact_to(scratch_path(spark, "compact"))
    assert sorted(map(str, smaller.read().drop("batch").collect())) == sorted(map(str, collection.read().drop("batch").collect()))
    queries = spark.createDataFrame([("q", [3.0, 4.0])], "query_id string, vector array<float>")
    hits = smaller.search(queries, k=2, filters={"content_type": "text"}).orderBy("rank").collect()
    assert [(h.document_id, h.score) for h in hits] == [("d2", 0.0), ("", 8.0)]
    texts = spark.createDataFrame([(1, "any words")], "query_id int, text string")
    assert smaller.text_search(texts, hashed_bag_of_words(2), k=5).count() == 2


def test_create_keeps_and_clear_empties(spark, collection):
    collection.append(chunks(spark, *ROWS))
    collection.delete_document("d2")
    assert collection.create().read().count() == 3
    collection.clear()
    assert collection.read().count() == 0 and collection.read().columns[0] == "doc_id"
    collection.append(chunks(spark, *ROWS))
    assert collection.read().count() == 4


def test_type_filter_prunes_directories(spark, collection):
    collection.append(chunks(spark, *ROWS))
    plan = collection.scan(filters={"content_type": "python"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(content_type" in plan and "content_type" in plan


def test_documents_with_nested_chunks(spark, collection):
    nested = chunks(spark, *[r for r in ROWS if r[0]]).groupBy("doc_id").agg(
        F.first("content_type").alias("content_type"), F.first("source").alias("source"),
        F.collect_list(F.struct("chunk_id", "content", "vector", "chunk_index")).alias("chunks"),
    )
    assert sorted(r.doc_id for r in collection.append_documents(nested).collect()) == ["d1", "d2", "d3"]
    assert collection.read().count() == 3


def test_reassembled_documents(spark, collection, monkeypatch):
    monkeypatch.setattr(G, "_BLOCK", 4)
    collection.append(chunks(spark, *[("long", f"k{i:02d}", "text", i, [0.0, 0.0]) for i in range(19)], *ROWS))
    rows = {r.doc_id: r for r in collection.documents().collect()}
    assert rows["long"].content == "\n\n".join(f"text k{i:02d}" for i in range(19)) and rows["long"].n_chunks == 19
    assert rows["d1"].content == "text b\n\ntext a" and rows["d1"].metadata.chunk_index == 0 and "d3" not in rows
    assert [r.chunk_id for r in G.chunks_in_order(chunks(spark, *ROWS[:3])).collect()] == ["b", "a", "c"]


def test_results_and_job_summary(spark):
    rows = {tuple(r) for r in G.ingest_results(chunks(spark, *ROWS[:3], ROWS[4]), 2).collect()}
    assert rows == {("d1", 0, "b", True), ("d1", 1, "a", True), ("d2", 0, "c", True), ("d3", 0, "bad", False)}
    log = spark.createDataFrame(
        [("j1", f"d{i}", None) for i in range(50)] + [("j1", "d0", None), ("j2", "x", None), ("j2", None, "boom"), ("j3", None, "early")],
        "job_id string, document_id string, error string",
    )
    jobs = [tuple(r) for r in G.ingest_job_summary(log).orderBy("job_id").collect()]
    assert jobs == [("j1", "completed", "Ingested 50 documents"), ("j2", "failed", "boom"), ("j3", "failed", "early")]
    assert sorted(tuple(r) for r in G.ingest_job_documents(log).collect()) == sorted(("j1", f"d{i}") for i in range(50))


def test_validation(spark):
    sources = spark.createDataFrame([("u", None, None), (None, None, None), ("u", "f", None)], "url string, file_path string, content string")
    valid, rejected = V.split_valid(V.validate_sources(sources))
    assert valid.count() == 1 and {tuple(r.reasons) for r in rejected.collect()} == {("empty",), ("exclusive",)}
    requests = spark.createDataFrame([(1000, 200, None), (100, 500, None), (50, 0, 0), (2000, 501, 5)], "chunk_size int, chunk_overlap int, max_tokens int")
    assert [r.reasons for r in V.validate_chunking(requests).coalesce(1).collect()] == [
        [], ["overlap_exceeds_size"], ["chunk_size_range", "max_tokens_positive"], ["chunk_overlap_range"],
    ]
    ks = spark.createDataFrame([(0,), (1,), (100,), (101,)], "k int")
    assert [len(r.reasons) for r in V.validate_search(ks).coalesce(1).collect()] == [1, 0, 0, 1]
    row = collection_rows(chunks(spark, ("é" * 128, "c", "text", 0, None)))
    assert V.validate_rows(row).first().reasons == ["doc_id_too_long"]
    assert failed_sources(rejected.withColumn("job_id", F.lit("j"))).where("error = 'empty'").count() == 1


def test_requests_from_all_three_kinds_of_sources(spark, collection):
    sources = spark.createDataFrame(
        [
            ("j1", None, None, "# A\n\none\n# B\n\ntwo", "text/markdown", 100, 0, {"team": "x"}),
            ("j1", "http://a/p", None, None, None, 1000, 200, {}),
            ("j2", None, "/f/x.py", None, None, 1000, 200, None),
            ("j3", "http://a/missing", None, None, None, 1000, 200, None),
            ("j4", "http://a/p", None, "both", None, 1000, 200, None),
            ("j5", None, None, "bad size", None, 50, 90, None),
            ("j6", None, "/f/none", None, None, 1000, 200, None),
        ],
        "job_id string, url string, file_path string, content string, content_type string, chunk_size int, chunk_overlap int, metadata map<string,string>",
    ).withColumn("max_tokens", F.lit(None).cast("int"))
    responses = spark.createDataFrame([("http://a/p", 200, "text/html", "<h1>T</h1><p>body</p>")], "url string, status int, content_type string, body string")
    files = spark.createDataFrame([("/f/x.py", "def f():\n    pass", "python")], "source string, content string, content_type string")
    log = ingest_requests(sources, responses, files, collection)
    jobs = {r.job_id: (r.status, r.message) for r in G.ingest_job_summary(log).collect()}
    assert jobs == {
        "j1": ("completed", "Ingested 2 documents"), "j2": ("completed", "Ingested 1 documents"), "j3": ("failed", "no response"),
        "j4": ("failed", "exclusive"), "j5": ("failed", "chunk_size_range,overlap_exceeds_size"), "j6": ("failed", "no such file"),
    }
    rows = {(r.content_type, r.content) for r in collection.read().collect()}
    assert rows == {("markdown", "# A\n\none"), ("markdown", "# B\n\ntwo"), ("web_page", "# T\n\nbody"), ("python", "def f():\n    pass")}
    assert collection.read().where("content_type = 'markdown'").first().metadata.extra == {"team": "x"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    pass\n")
    (tmp_path / "b.md").write_text("# T\n")
    (tmp_path / "c.bin").write_text("x")
    files = {r.source.rsplit("/", 1)[1]: (r.content_type, r.content) for r in D.file_documents(spark, str(tmp_path)).collect()}
    assert files == {"a.py": ("python", "def f():\n    pass\n"), "b.md": ("markdown", "# T\n"), "c.bin": ("text", "x")}
    given = spark.createDataFrame([("text", "text/markdown", "id1"), ("text", None, None), (None, None, "gone")], "content string, content_type string, doc_id string")
    docs = D.direct_documents(given).collect()
    assert len(docs) == 2 and docs[0].doc_id == "id1" and docs[0].content_type == "markdown" and docs[1].source == "direct_content"
    assert D.direct_documents(given).orderBy("doc_id").collect()[0].doc_id == D.direct_documents(given).orderBy("doc_id").collect()[0].doc_id
    dropped = D.drop_original(D.direct_documents(given), store_original=False)
    assert dropped.where("content is not null").count() == 0
    results = spark.createDataFrame([("http://a/x.md", 200, "text/markdown", "b", None), ("http://a/y", 404, "", "", None)], "url string, status int, content_type string, body string, error string")
    assert [r.content_type for r in D.page_documents(results).collect()] == ["markdown"]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    schema = "doc_id string, content string, content_type string, source string"
    docs = spark.createDataFrame([(f"d{i}", f"# h{i}\n\n" + "word " * (i * 7), "markdown", "s") for i in range(30)], schema)
    incoming, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "cp"))
    docs.where("doc_id < 'd2'").repartition(4).write.parquet(incoming)
    streamed = Collection(spark, scratch_path(spark, "stream"), 16).create()

    def run():
        source = M.stream_table(spark, incoming, docs.schema, files_per_batch=2)
        M.stream_ingest(source, streamed, log, checkpoint, "job", size=100, overlap=20).awaitTermination()

    run()
    run()  # nothing new: nothing stored twice
    docs.where("doc_id >= 'd2'").write.mode("append").parquet(incoming)
    run()
    batch = Collection(spark, scratch_path(spark, "batch"), 16).create()
    write_job_log(ingest_documents(docs, batch, "job", size=100, overlap=20), str(tmp_path / "log2"), "b")
    columns = ["doc_id", "chunk_id", "content", "vector"]
    assert sorted(map(str, streamed.read().select(columns).collect())) == sorted(map(str, batch.read().select(columns).collect()))
    assert spark.read.parquet(log).count() == 30


def test_seen_urls_across_runs(spark, tmp_path):
    incoming, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    first = spark.createDataFrame([("a",), ("b",), ("a",)], "url string")
    first.write.parquet(incoming)
    for extra in ([("b",), ("c",)], []):
        M.write_table(M.seen_urls(M.stream_table(spark, incoming, first.schema)), out, checkpoint).awaitTermination()
        if extra:
            spark.createDataFrame(extra, "url string").write.mode("append").parquet(incoming)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    fresh = str(tmp_path / "out2")
    M.write_table(M.seen_urls(M.stream_table(spark, incoming, first.schema)), fresh, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(fresh).count() == 3


def test_a_batch_is_replaced_whole_and_deletes_survive_a_replay(spark, collection):
    collection.append(chunks(spark, *ROWS[:2]), batch="b1")
    moved = chunks(spark, *ROWS[:2]).withColumn("content_type", F.lit("csharp"))
    assert collection.append(moved, batch="b1").count() == 2 and collection.read().count() == 2
    assert collection.delete_document("d1")
    collection.append(moved, batch="b1")
    assert collection.read().where("doc_id = 'd1'").count() == 0


def test_rejects_have_reasons_and_are_counted(spark, collection, caplog):
    rows = chunks(spark, *ROWS).withColumn("vector", F.expr("IF(chunk_id = 'a', array(CAST('NaN' AS FLOAT), 1), vector)"))
    rows = rows.withColumn("content", F.expr("IF(chunk_id = 'b', repeat('x', 70000), content)"))
    assert {"a", "b"}.isdisjoint(r.chunk_id for r in collection.append(rows).collect())
    assert "'content': 1" in caplog.text and "vector" in caplog.text
    reasons = {r.chunk_id: r.reason for r in collection.rejects(rows).collect()}
    assert reasons["a"] == "vector: null or non-finite value" and reasons["b"] == "content: more than 65535 bytes"


def test_all_metadata_is_stored(spark, collection):
    rows = chunks(spark, *ROWS[:1]).drop("metadata").withColumns({
        "sitemap_priority": F.lit(0.5), "header_level": F.lit(2), "header_text": F.lit("Head"), "description": F.lit("about"),
        "chunk_index": F.lit(0), "last_modified": F.lit("2024-01-02"),
    })
    collection.append(rows)
    kept = collection.read().first().metadata
    assert (kept.sitemap_priority, kept.header_level, kept.header_text, kept.description, kept.last_modified) == (0.5, 2, "Head", "about", "2024-01-02")


def ids(rows):
    return sorted(r.chunk_id for r in rows.select("chunk_id").collect())


def test_a_write_that_dies_leaves_rows_and_time(spark, collection, monkeypatch):
    """A replay that dies after its data, before its version, changes nothing; the next one keeps the first time."""
    collection.append(chunks(spark, ("d1", "a", "text", 0, [1.0, 2.0]), ("d2", "b", "text", 0, [1.0, 2.0])), batch="b")
    collection.delete_document("d1")
    time = collection.read_all().first().added_at
    with monkeypatch.context() as m:
        m.setattr(collection, "_change", lambda make: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            collection.append(chunks(spark, ("d3", "c", "text", 0, [1.0, 2.0])), batch="b")
    assert ids(collection.read()) == ["b"] and ids(collection.read_all()) == ["a", "b"]
    collection.append(chunks(spark, ("d1", "a", "text", 0, [1.0, 2.0]), ("d3", "c", "text", 0, [1.0, 2.0])), batch="b")
    assert ids(collection.read()) == ["c"]  # d1 stays deleted
    assert {r.added_at for r in collection.read_all().collect()} == {time}


def test_readers_keep_their_version(spark, collection):
    collection.append(chunks(spark, ("d1", "a", "text", 0, [1.0, 2.0])), batch="b")
    rows, pinned = collection.read(), collection.at()
    collection.append(chunks(spark, ("d2", "b", "text", 0, [1.0, 2.0])), batch="b")
    collection.clear()
    assert ids(rows) == ids(pinned.read()) == ["a"] and ids(collection.read()) == []
    with pytest.raises(ValueError):
        pinned.clear()
    with pytest.raises(ValueError):
        Collection(spark, scratch_path(spark, "nowhere"), 2).read()


def test_a_taken_version_is_not_overwritten(spark, collection, monkeypatch):
    """Another writer publishes between reading and writing: both changes are kept."""
    log, real, once = collection.versions, collection.versions.state, []

    def late(number=None):
        found = real(number)
        if not once:
            once.append(1)
            Collection(spark, collection.path, 2).append(chunks(spark, ("d1", "a", "text", 0, [1.0, 2.0])), batch="other")
        return found

    part = chunks(spark, ("d2", "b", "text", 0, [1.0, 2.0]))
    monkeypatch.setattr(log, "state", late)
    collection.append(part, batch="mine")
    once.clear()
    log.change(lambda state: {**state, "note": 1})
    assert ids(collection.read()) == ["a", "b"] and real()[1]["note"] == 1


def test_vacuum_removes_what_no_kept_version_names(spark, collection):
    for name in "abc":
        collection.append(chunks(spark, ("d1", name, "text", 0, [1.0, 2.0])), batch="b")
    collection.delete_document("nobody")
    assert collection.vacuum(keep=2) == 2 and ids(collection.read()) == ["c"]
    assert len(collection.versions.numbers()) == 2 and collection.vacuum(keep=2) == 0


def test_append_reads_no_rows(spark, collection, monkeypatch):
    """One batch more never lists or reads the others."""
    collection.append(chunks(spark, ("d1", "a", "text", 0, [1.0, 2.0])), batch="a")
    read = []
    monkeypatch.setattr(collection, "_read_parts", lambda entries, *more: read.extend(entries) or Collection._read_parts(collection, entries, *more))
    collection.append(chunks(spark, ("d2", "b", "text", 0, [1.0, 2.0])), batch="b").collect()
    assert [e["batch"] for e in read] == ["b"]


def test_cells_follow_the_collection(spark, collection):
    rows = [(f"d{i}", f"c{i:02d}", "text" if i % 2 else "python", i, [float(i % 7), float(i // 7)]) for i in range(40)]
    queries = spark.createDataFrame([(1, [3.0, 2.0]), (2, [6.0, 5.0]), (3, [1.0])], "query_id int, vector array<float>")
    with pytest.raises(ValueError):
        collection.search(queries, using="cells")
    collection.append(chunks(spark, *rows[:20]), batch="a")
    collection.append(chunks(spark, *rows[20:25]), batch="b")
    collection.build_cells(4)
    collection.append(chunks(spark, *rows[25:]), batch="c")
    collection.delete_document("d17")
    collection.append(chunks(spark, *rows[20:22]), batch="b")
    for options in ({}, {"filters": {"content_type": "text"}}, {"filters": {"doc_id": "d5"}}, {"include_vectors": True, "metric": "IP"}):
        want = sorted(map(str, collection.search(queries, k=6, **options).collect()))
        assert want and sorted(map(str, collection.search(queries, using="bounds", k=6, **options).collect())) == want
        assert sorted(map(str, collection.search(queries, using="cells", nprobe=4, k=6, **options).collect())) == want
    old = collection.at()
    collection.build_cells(centers=collection.cells()[1])
    assert collection.cells()[3].count() == 0 and old.cells()[3].count() == 17
    collection.clear()
    collection.build_cells()
    assert collection.search(queries, using="bounds").count() == collection.search(queries, using="cells").count() == 0


def test_search_of_a_collection_takes_its_own_dimension(spark, collection):
    collection.append(chunks(spark, *ROWS))
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [9.0])], "query_id int, vector array<float>")
    assert {r.query_id for r in collection.search(queries, k=2).collect()} == {1}


def test_dynamic_fields(spark):
    collection = Collection(spark, scratch_path(spark, "test"), 2, dynamic=True).create()
    rows = chunks(spark, *[("d", str(i), "text", i, [1.0, float(i)]) for i in range(6)])
    json = F.expr("""element_at(array('{"n": 1, "s": "x"}', '{"n": 1.5}', '{"n": "1"}', '{"n": null, "b": true}', 'no json', NULL), chunk_index + 1)""")
    collection.append(rows.withColumn("dynamic", json), batch="a")
    collection.append(rows.where("chunk_index = 0").withColumn("dynamic", F.create_map(F.lit("s"), F.lit("x"))).withColumn("chunk_id", F.lit("m")), batch="b")
    found = lambda **filters: ids(collection.scan(filters=filters))
    assert found(n=1) == found(n=1.0) == ["0"] and found(n=[1, 1.5]) == ["0", "1"] and found(n="1") == ["2"]
    assert found(s="x") == ["0", "m"] and found(b=True) == ["3"] and found(b=1) == found(other="x") == []
    collection.build_cells(2)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    for using in ("rows", "cells", "bounds"):
        assert sorted(r.id for r in collection.search(queries, using=using, filters={"s": "x", "doc_id": "d"}).collect()) == ["0", "m"]
    smaller = collection.compact_to(scratch_path(spark, "compact"))
    assert ids(smaller.scan(filters={"s": "x"})) == ["0", "m"]
    with pytest.raises(TypeError):
        collection.scan(filters={"s": None})


def test_a_lookup_skips_row_groups(spark, tmp_path):
    """Rows lie by document, so the statistics and filters of most row groups rule a document out."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "500")
    try:
        collection = Collection(spark, scratch_path(spark, "test"), 2).create()
        rows = spark.range(6_000).selectExpr(
            "concat('d', lpad(id * 7919 % 600, 4, '0')) AS doc_id", "CAST(id AS STRING) AS chunk_id", "'text' AS content_type", "CAST(id AS INT) AS chunk_index",
            "concat('s', id * 7919 % 600) AS source", "repeat('x', 50) AS content", "array(1F, 2F) AS vector",
        )
        collection.append(rows.coalesce(1), batch="a")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")

    def scanned(condition):
        df = collection.read().where(condition)
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return len(found), sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    assert scanned("doc_id = 'd0300'") == (10, 500)  # one of twelve files, each one row group
    n, read = scanned("metadata.source = 's123'")
    assert n == 10 and read <= 1_500  # by the Bloom filters, with their false positives


def test_seen_urls_cleared_across_runs(spark, tmp_path):
    """Memory and commands hold over restarts of the stream; one scope with nearly all URLs, null URLs and scopes."""
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = "scope string, url string, at int, clear boolean"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(str(folder / name))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))
        M.write_table(M.seen_since_cleared(source, parts=3), out, checkpoint).awaitTermination()
        return sorted((r.scope or "", r.url, r.at) for r in spark.read.schema("scope string, url string, at int").parquet(out).collect())

    try:
        first = [("a", f"u{i % 50}", i, None) for i in range(200)] + [("b", "u1", 1, False), (None, "u1", 1, None), ("a", None, 3, None)]
        found = run("1", first + [("a", "u1", 100, True)])
        want = [("", "u1", 1), ("b", "u1", 1)] + [("a", f"u{i}", i) for i in range(50)] + [("a", f"u{i - 100}", i) for i in range(100, 150)]
        assert found == sorted(want)
        found = run("2", [("a", "u1", 300, None), ("b", "u1", 300, None), ("b", None, 301, True), ("b", "u1", 302, None)])
        assert found == sorted(want + [("b", "u1", 302)])
    finally:
        spark.conf.set(provider, before)


def _counts(collection):
    row = collection.stats(approximate=True).first()
    return row["chunks"], row["documents"]


def test_stored_sketches_follow_every_change(spark, tmp_path):
    rows = spark.range(3_000).select(
        F.concat(F.lit("d"), F.col("id") % 1_000).alias("doc_id"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("x").alias("content"),
        F.lit("text").alias("content_type"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit(0).alias("chunk_index"), "id",
    )
    collection = Collection(spark, str(tmp_path / "c"), 2).create()
    assert _counts(collection) == (0, 0)
    collection.append(rows.where("id < 1500"), batch="a")
    collection.append(rows.where("id >= 1500"), batch="b")
    assert _counts(collection) == (3_000, 1_000)
    collection.delete(spark.createDataFrame([("d1",), ("d2",), ("none",)], "doc_id string"))
    collection.delete(spark.createDataFrame([("d1",)], "doc_id string"))
    assert not collection.delete_document("d2")
    assert _counts(collection) == (2_994, 998)
    collection.append(rows.where("id = 1"))
    assert _counts(collection) == (2_995, 999)
    collection.append(rows.where("id < 1500 AND doc_id <> 'd3'"), batch="a")
    for one in (collection, collection.compact_to(str(tmp_path / "compact"))):
        exact = one.stats().first()
        assert _counts(one) == (exact["chunks"], exact["documents"])
    files = collection.stats(approximate=True).inputFiles()
    assert files and all("/measures/" in name for name in files)
    collection.vacuum()
    assert _counts(collection) == (exact["chunks"], exact["documents"])
    collection.append(rows.where("false"))
    collection.clear()
    collection.append(rows.where("false"))
    assert _counts(collection) == (0, 0)


def test_jobs_that_fall_silent_fail(spark, tmp_path):
    import time

    from suite.jobs import _rocksdb

    kinds = "job_id string, kind string, document_id string, error string"
    folder, out = str(tmp_path / "events"), str(tmp_path / "trail")
    rows = [("a", "accepted", None, None), ("b", "document", "1", None), ("b", "document", "1", None), ("c", "document", "1", "bad"),
            ("c", "end", None, None), ("d", "document", "7", None), ("d", "end", None, None), (None, "end", None, None)]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(folder)
    wanted = [("a", "failed", 0), ("a", "pending", 0), ("b", "failed", 0), ("b", "processing", 1), ("c", "failed", 0), ("d", "completed", 1)]
    progress = M.job_progress(M.stream_table(spark, folder, T.StructType.fromDDL(kinds)), quiet_ms=1_000)
    with _rocksdb(spark):
        query = progress.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint"))
        query = query.trigger(processingTime="1 second").start()
        try:
            until, found = time.monotonic() + 60, []
            while found != wanted and time.monotonic() < until and query.isActive:
                time.sleep(2)
                found = sorted(tuple(r)[:3] for r in spark.read.schema("job_id string, status string, n_documents bigint").parquet(out).collect())
        finally:
            query.stop()
    assert found == wanted


def test_an_append_lists_versions_once(spark, collection, monkeypatch):
    """The newest version is looked for from the last one met, also when others wrote or removed versions meanwhile."""
    collection.append(chunks(spark, ("d0", "a0", "text", 0, [1.0, 2.0])), batch="b0")
    listed = []
    numbers = type(collection.versions).numbers
    monkeypatch.setattr(type(collection.versions), "numbers", lambda log: listed.append(1) or numbers(log))
    for i in (1, 2):
        collection.append(chunks(spark, (f"d{i}", f"a{i}", "text", 0, [1.0, 2.0])), batch=f"b{i}")
    assert not listed
    other = Collection(spark, collection.path, collection.dimension)
    other.append(chunks(spark, ("d3", "a3", "text", 0, [1.0, 2.0])), batch="b3")
    other.append(chunks(spark, ("d4", "a4", "text", 0, [1.0, 2.0])), batch="b4")
    other.vacuum(keep=1)
    assert ids(collection.read()) == ["a0", "a1", "a2", "a3", "a4"]


def test_many_jobs_are_few_states(spark, tmp_path):
    """All states of all jobs over several micro-batches, with far fewer parts than jobs."""
    from suite.jobs import _rocksdb

    kinds, folder, out, checkpoint = "job_id string, kind string, document_id string, error string", *(str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    jobs = [f"j{i}" for i in range(300)]
    steps = [[(j, "accepted", None, None) for j in jobs], [(j, "document", d, None) for j in jobs for d in "xyx"] + [("j7", "document", None, e) for e in ("z", "b")],
             [(j, "end", None, None) for j in jobs], [("j1", "document", "late", None)]]
    for step in steps:
        spark.createDataFrame(step, kinds).write.mode("append").parquet(folder)
        with _rocksdb(spark):
            M.write_table(M.job_progress(M.stream_table(spark, folder, T.StructType.fromDDL(kinds)), parts=4), out, checkpoint).awaitTermination()
    found = sorted(tuple(r) for r in spark.read.schema("job_id string, status string, n_documents bigint, message string").parquet(out).collect())
    good = [j for j in jobs if j != "j7"]
    want = [(j, "pending", 0, None) for j in jobs] + [(j, "processing", 2, None) for j in good] + [(j, "completed", 2, "Ingested 2 documents") for j in good]
    assert sorted(map(str, found)) == sorted(map(str, [*want, ("j7", "failed", 0, "b")]))


def test_seen_urls_with_many_commands_in_a_batch(spark, tmp_path):
    """Several commands in every micro-batch give what row by row gives."""
    import random

    from suite.jobs import _rocksdb

    draw = random.Random(5)
    rows = [(draw.choice("ab"), f"u{draw.randrange(6)}", i, draw.random() < 0.1) for i in range(400)]
    schema, folder, out = "scope string, url string, at int, clear boolean", tmp_path / "in", str(tmp_path / "out")
    for i, part in enumerate((rows[:150], rows[150:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / str(i)))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))
        with _rocksdb(spark):
            M.write_table(M.seen_since_cleared(source, parts=2), out, str(tmp_path / "checkpoint")).awaitTermination()
    memory, want = {"a": set(), "b": set()}, []
    for scope, url, at, clear in rows:
        if clear:
            memory[scope].clear()
        elif url not in memory[scope]:
            memory[scope].add(url)
            want.append((scope, url, at))
    assert sorted(tuple(r) for r in spark.read.schema("scope string, url string, at int").parquet(out).collect()) == sorted(want)


def test_workers_hold_a_few_documents_at_a_time(spark, monkeypatch):
    """Chunks and vectors leave a worker in steps, with the results of whole batches."""
    from gleanery.operators import embedding, splitter
    from gleanery.operators.chunking import chunk_documents

    docs = spark.range(100).repartition(1).select(F.col("id").cast("string").alias("doc_id"), F.expr("repeat('some words ', int(id) * 3)").alias("content"))
    whole = sorted(map(str, embedding.embed_chunks(chunk_documents(docs, size=200, overlap=20)).collect()))
    held = splitter.chunk_lists
    monkeypatch.setattr(splitter, "STEP_ROWS", 7)
    monkeypatch.setattr(embedding, "STEP_ROWS", 5)

    def small(sections, *more):
        assert len(sections) <= 7
        return held(sections, *more)

    monkeypatch.setattr(splitter, "chunk_lists", small)
    again = embedding.embed_chunks(chunk_documents(docs, size=200, overlap=20, separators=["\n\n", "\n", " ", ""]), embedding.hashed_bag_of_words())
    assert sorted(map(str, again.collect())) == whole
