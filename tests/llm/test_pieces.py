import random
import re

import pytest

from gleanery.llm.pieces import MARK, decode_pieces, encode_pieces, load_pieces
from gleanery.llm.queries import PIECE_MODEL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return load_pieces(PIECE_MODEL)


def brute(text, pieces):
    """Viterbi over the whole text, word marks and all; of equal paths the one whose last piece is longest."""
    table = {p: (i, s) for p, i, s in pieces.table}
    text = MARK + text.replace(" ", MARK) if text else ""
    best = [(0.0, 0, None)]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(max(0, end - pieces.longest), end):
            piece = text[start:end]
            i, score = table.get(piece, (None, pieces.unknown_score if end - start == 1 else None))
            if score is not None and (found is None or best[start][0] + score > found[0]):
                ids = [i] if i is not None else [pieces.byte_base + b for b in piece.encode()]
                found = (best[start][0] + score, start, ids)
        best.append(found)
    out, at = [], len(text)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [i for ids in reversed(out) for i in ids]


@pytest.mark.parametrize("frequent", [0, 20, 200_000])
def test_against_brute_force(spark, pieces, frequent):
    rng = random.Random(4)
    texts = [None, "", " ", "   a  b", "a\nb\n\n", "été naïve ß", "日本語テスト 🎉🎉", "x" * 700, "aé" * 600, "0x1F,;()[]{}", "▁mark▁", "\0\x01", "Hello world. The end"]
    texts += ["".join(rng.choices("abeinrt .,\n'é0", k=rng.randint(1, 80))) for _ in range(60)]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(3, texts[3], "", 0), (None, "null id", "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, block int").repartition(3)
    found = encode_pieces(df, pieces, frequent_words=frequent)
    got = sorted(((r.doc_id, r.n_pieces, r.ids, r.round_trip) for r in found.collect()), key=repr)
    expected = [(i, brute(t or "", pieces), MARK not in (t or "")) for i, t, *_ in rows]
    assert got == sorted(((i, len(ids), ids, same) for i, ids, same in expected), key=repr)


def test_decoding_gives_texts_back(spark, pieces):
    df = spark.createDataFrame([(1, "One two.\n", "x"), (2, "", "x"), (3, "ünï 🎉", "x")], "doc_id bigint, text string, decoded string")
    coded = encode_pieces(df, pieces)
    assert {r.doc_id: r.decoded for r in decode_pieces(coded, pieces).collect()} == {1: "One two.\n", 2: "", 3: "ünï 🎉"}
    nothing = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert decode_pieces(nothing, pieces).first().decoded is None


def test_empty_table(spark, pieces):
    assert encode_pieces(spark.createDataFrame([], "doc_id bigint, text string"), pieces).collect() == []


def test_a_very_long_word(spark, pieces):
    text = "ab1" * 20_000
    row = encode_pieces(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), pieces).first()
    assert row.round_trip and row.ids == brute(text, pieces)


def test_same_ids_as_the_library_on_a_unigram_model(spark, tmp_path):
    """The given vocabulary as a unigram model; its marks of -1e9 would not survive the library's single precision."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECE_MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    for piece in model.pieces:
        if piece.type == piece.NORMAL:
            piece.score = max(piece.score, -40_000.0)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in encode_pieces(docs, load_pieces(str(path)), frequent_words=1_000).collect():
        assert row.ids == library.encode(texts[row.doc_id])


def test_texts_and_words_are_encoded_where_they_lie(spark, pieces):
    df = spark.range(40).selectExpr("id AS doc_id", "concat('word', id, ' and some more') AS text").repartition(2)
    found = encode_pieces(df.localCheckpoint(), pieces, frequent_words=2, block_bytes=64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    assert {r.doc_id: r.ids for r in found.collect()} == {i: brute(f"word{i} and some more", pieces) for i in range(40)}


def test_every_distinct_word_goes_through_the_lattice(spark, pieces, monkeypatch):
    from gleanery.llm import pieces as module

    seen, edges_of = [], module.lattice_edges

    def watched(words, table):
        seen.extend(r.word for r in words.select("word").collect())
        return edges_of(words, table)

    monkeypatch.setattr(module, "lattice_edges", watched)
    texts = [f"word{i} other,\nNext{i}" for i in range(30)] + ["y" * 100, "word1  two", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    found = {r.doc_id: r.ids for r in encode_pieces(df, pieces, frequent_words=5, block_bytes=100).collect()}
    assert found == {i: brute(t or "", pieces) for i, t in enumerate(texts)}
    pattern = re.compile(pieces.pattern)
    assert sorted(seen) == sorted({w for text in texts for part in module.marked(text or "") for w in module.words_of(part, pattern)})


def test_words_end_only_where_no_piece_goes_across(pieces):
    from gleanery.llm.pieces import marked, words_of

    pattern = re.compile(pieces.pattern)
    pairs = {p[i : i + 2] for p, _, _ in pieces.table for i in range(len(p) - 1)}
    for text in ("a.b, (c)\n\nD's x1.5 é.\nThe  end *** [e] http://x.y/z", "▁m ▁", "日本。語 №5 don't.", " "):
        words = [w for part in marked(text) for w in words_of(part, pattern)]
        assert "".join(words) == MARK + text.replace(" ", MARK)
        assert not [(a, b) for a, b in zip(words, words[1:]) if a[-1] + b[0] in pairs]
