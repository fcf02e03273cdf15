import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.llm.queries import BYTE_BPE
from gleanery.llm.token_shards import Encoder, WaveletMatrix, chunks, token_shards, write_shards

SF_DIR = "/root/testdata/sf0.001"


@cache
def opened():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return tokenizer


@cache
def encoder():
    return Encoder(BYTE_BPE)


def encoded(texts):
    tokenizer = opened()
    return [found.ids + [0] for found in tokenizer.encode_batch(texts, add_special_tokens=False)]


def expected(rows):
    start, out = 0, []
    for (i, _), ids in zip(rows, encoded([t or "" for _, t in rows])):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300))
def test_wavelet_matrix_answers_like_a_list(ids):
    matrix = WaveletMatrix(WaveletMatrix.build(np.array(ids, np.uint16), 6))
    assert matrix.to_array().tolist() == ids
    assert [matrix.access(i) for i in range(len(ids))] == ids
    for value in {*ids, 41}:
        places = [i for i, x in enumerate(ids) if x == value]
        assert matrix.occurrences(value) == places
        assert matrix.rank(value, len(ids) // 2) == sum(p < len(ids) // 2 for p in places)
    with pytest.raises(IndexError):
        matrix.select(41, 0)


def test_wavelet_matrix_over_several_blocks():
    ids = np.random.default_rng(2).integers(0, 50_257, 200_000).astype(np.uint16)
    matrix = WaveletMatrix(WaveletMatrix.build(ids, 16))
    assert (matrix.to_array() == ids).all()
    assert [matrix.access(i) for i in (0, 65_535, 65_536, 199_999)] == ids[[0, 65_535, 65_536, 199_999]].tolist()
    value = int(ids[150_000])
    assert matrix.occurrences(value) == np.flatnonzero(ids == value).tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" a'tTÉ1.\n\t 　", max_size=40))
def test_encoding_by_chunks_is_encoding(text):
    assert "".join(chunks(text)) == text
    assert [i for ids in encoded(chunks(text)) for i in ids[:-1]] == encoded([text])[0][:-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Été", "ab.", "a,", "b.\nA", "b.\nA,", "²", "a²", "x1.", "'s", "\n", " ", "a\u0301.", "日", "日.", "_b!", "a!?", "<|endoftext|>", "a<|endoftext|>.", "<|endoftext|"]), max_size=8))
def test_encoding_with_remembered_words_is_encoding(words):
    text = " ".join(words)
    assert encoder().encode([text, text])[1].tolist() == encoded([text])[0][:-1]


def test_every_word_is_looked_up_once_and_the_library_gets_few():
    """Marks, line feeds and first words are put together from words; each step asks for a word once."""
    fresh, asked, known = Encoder(BYTE_BPE), [], []
    ask, look = fresh._ask, fresh._known
    fresh._ask = lambda words: (asked.extend(words), ask(words))[1]
    fresh._known = lambda keys: (known.extend(keys), look(keys))[1]
    words = ["abc", "Été", "straße", "日本"]
    marked = [f"{a}{m}" for a in words for m in ("", ".", "!!", "$$$", ".***")]
    texts = [" ".join(marked + [f"{a}\n{b}" for a in marked for b in marked])] * 5
    found = fresh.encode(texts)
    assert [f.tolist() for f in found] == [ids[:-1] for ids in encoded(texts)]
    assert len(known) <= len(marked) * (len(marked) + 1) + 10  # 2,100 words in all
    assert len(asked) < 40  # 420 distinct ones


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abÉß日ªʼⅷ²'!$*.-_|\n\x1c\x85 ", max_size=12), max_size=5))
def test_encoding_of_marks_and_letters_is_encoding(texts):
    assert [f.tolist() for f in encoder().encode(texts)] == [ids[:-1] for ids in encoded(texts)]


def test_documents_of_every_kind(spark):
    rows = [(1, None), (2, ""), (3, "a  b \n c\n\n"), (4, "<|endoftext|>"), (5, "word " * 30_000), (6, "日本語 'twas  "), (7, "x" * 5_000), (8, "a <|endoftext|> b<|endoftext|>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string").repartition(3)
    for size in (1, 1 << 22):
        found = token_shards(df, BYTE_BPE, shard_ids=size).orderBy("doc_id").collect()
        assert [tuple(r) for r in found] == expected(rows)


def test_null_and_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (2, "b"), (None, "n")], "doc_id bigint, text string")
    found = token_shards(df, BYTE_BPE).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in found] == [(None, 0), (1, 2), (2, 4), (2, 6)]
    assert token_shards(df.limit(0), BYTE_BPE).collect() == []


def test_occurrences_in_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "the cat and the dog") for i in range(20)], "doc_id bigint, text string")
    the = encoded([" the"])[0][0]
    shards = write_shards(df, str(tmp_path / "shards"), BYTE_BPE)
    assert sum(WaveletMatrix(bytes(r["image"])).count(the) for r in shards.collect()) == 20


def test_query_against_brute_force(spark):
    from gleanery.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = QUERIES["op1_token_shards"](spark, SF_DIR).orderBy("doc_id").select("doc_id", "start", "n_tokens", F.col("ids_crc32"))
    assert [tuple(r) for r in found.collect()] == expected([tuple(d) for d in docs])
