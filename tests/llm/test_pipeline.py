"""The pipeline's stages against brute-force versions, each on what the stage before kept."""

import numpy as np
import pytest
from test_contamination import brute as brute_contamination
from test_exact_duplicates import fold
from test_near_duplicates import brute as brute_near
from test_pieces import brute as brute_pieces

import corpus_pipeline
from gleanery.llm.languages import SIZE, fit_languages
from gleanery.llm.pieces import load_pieces
from gleanery.llm.queries import PIECE_MODEL
from gleanery.session import cut_lineage

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_language(text, model):
    """Nearest centroid by plain loops: (language, rejected)."""
    if not any(c.isalpha() for c in text or ""):
        return "und", True
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    counts = np.zeros(SIZE)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        counts[((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> 20] += 1
    vector = np.log1p(counts) * model.idf
    cosine = model.centroids @ (vector / max(np.linalg.norm(vector), 1e-12))
    return model.languages[int(cosine.argmax())], bool(cosine.max() < model.floors[int(cosine.argmax())])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    model = fit_languages(docs.filter("lang IS NOT NULL"))
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages)

    def check(name, expected):
        nonlocal docs, rows
        docs = cut_lineage(stages[name](spark, docs, SF_DIR))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(expected)
        rows = {i: rows[i] for i in expected}

    check("language ID", [i for i, t in rows.items() if not brute_language(t, model)[1]])
    last = {}
    for i, t in rows.items():
        last[fold(t)] = max(i, last.get(fold(t), i))
    check("exact dedup", list(last.values()))
    check("MinHash near-dedup", sorted({c for _, c in brute_near(list(rows.items())).values()}))
    judged = brute_contamination(list(rows.items()), bench)
    assert any(r[-1] for r in judged)
    check("benchmark decontamination", [r[0] for r in judged if not r[-1]])
    pieces = load_pieces(PIECE_MODEL)
    found = {r.doc_id: r.ids for r in stages["SentencePiece encoding"](spark, docs, SF_DIR).collect()}
    assert found.keys() == rows.keys()
    for i in sorted(rows)[:40]:
        assert found[i] == brute_pieces(rows[i], pieces)
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert whole == found


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_take_rows_of_every_kind(spark, name, stage):
    long = "the quick word and the slow one " * 5_000
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "a text of a few words", "en", "s", 1), (3, "a text of a few words", "en", "s", 1)]
    rows += [(None, "a row without id", "en", "s", 1), (4, long, "en", "s", 1), (5, "ein Satz auf Deutsch", "de", "s", 1)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], f"{SCHEMA}, row string, kept boolean".replace("kept boolean", "kept string"))
    found = stage(spark, df, SF_DIR)
    assert found.schema.names == df.schema.names
    ids = sorted((r.doc_id for r in found.collect()), key=repr)
    expected = {
        "language ID": [3, 3, 4, 5, None], "exact dedup": [2, 3, 4, 5, None], "MinHash near-dedup": [1, 2, 3, 3, 4, 5, None],
        "benchmark decontamination": [1, 2, 3, 3, 4, 5, None],
    }[name]
    assert ids == sorted(expected, key=repr)
    assert stage(spark, df.limit(0), SF_DIR).collect() == []


def test_the_last_stage_takes_every_distinct_word_through_the_lattice(spark, monkeypatch):
    from gleanery.llm import pieces

    seen, edges_of = [], pieces.lattice_edges

    def watched(words, table):
        seen.extend(r.word for r in words.select("word").collect())
        return edges_of(words, table)

    monkeypatch.setattr(pieces, "lattice_edges", watched)
    monkeypatch.setattr(pieces, "SAMPLE_BYTES", 1)  # hardly a text is in the sample of frequent words
    df = spark.createDataFrame([(i, f"rareword{chr(97 + i)} and more", "en") for i in range(20)], "doc_id bigint, text string, lang string")
    assert all(r.round_trip for r in corpus_pipeline.piece_ids(spark, df, "").collect())
    assert {f"▁rareword{chr(97 + i)}" for i in range(20)} <= set(seen)
