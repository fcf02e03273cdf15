import pytest
from pyspark.sql import functions as F

from gleanery.llm.languages import fit_languages, identify_languages
from gleanery.llm.queries import QUERIES, remainder

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = QUERIES["op8_languages"](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    right = found.filter("held_out").join(docs, "doc_id").filter("lang IS NOT NULL")
    assert right.count() > 100
    assert right.filter("lang = lang_pred").count() >= 0.98 * right.count()
    assert right.filter("rejected AND lang_pred <> 'und'").count() <= 0.02 * right.count()
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_predictions_never_read_labels_or_ids(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = fit_languages(docs.filter((remainder("doc_id") != 0) & F.col("lang").isNotNull()))
    a = identify_languages(docs, model).select("row.doc_id", "lang_pred", "score")
    b = identify_languages(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model).select("row.doc_id", "lang_pred", "score")
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"the house and the garden number {i}", "en") for i in range(30)] + [(i + 30, f"das Haus und der Garten Nummer {i}", "de") for i in range(30)]
    rows += [(90, None, "en"), (91, "no label", None), (92, "the only", "en")]
    return fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_rows=20)


def test_rows_of_every_kind(spark, model):
    texts = [None, "", "12 34 !?", "the garden", "der Garten und das Haus", "the house and the garden number 5 " * 20_000, "the garden", "漢字漢字漢字漢字"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "und der Garten", "x")], "doc_id bigint, text string, score string")
    found = {r.row.doc_id: r for r in identify_languages(df, model).collect()}
    assert [found[i].lang_pred for i in range(7)] == ["und", "und", "und", "en", "de", "en", "en"]
    assert [found[i].rejected for i in range(7)] == [True, True, True, False, False, False, False]
    assert found[7].rejected and found[7].lang_pred in ("en", "de")  # far from all that was learned
    assert found[3].score == found[6].score and found[None].lang_pred == "de" and found[0].row.score == "clash"


def test_empty_tables_and_no_languages(spark, model):
    df = spark.createDataFrame([(1, "the house", "en")], "doc_id bigint, text string, lang string")
    assert identify_languages(df.limit(0), model).collect() == []
    row = identify_languages(df, fit_languages(df.limit(0))).first()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)


def test_bad_labelled_rows_do_not_turn_rejection_off(spark):
    said = {"en": "the weather of the {} day was good and we walked home", "de": "das wetter am {} tag war gut und wir gingen nach hause"}
    rows = [(i, text.format(i), lang) for lang, text in said.items() for i in range(30)]
    bad = [(100, "", "en"), (101, "42 17", "de"), (102, "x", "en"), (103, "ok", "de"), (104, "добрый вечер", "en"), (105, "καλησπέρα σας", "de")]
    kind = "doc_id bigint, text string, lang string"
    clean, fitted = (fit_languages(spark.createDataFrame(r, kind)) for r in (rows, rows + bad))
    assert (fitted.floors > 0.5 * clean.floors.min()).all()
    asked = [(1, "the weather was good and we walked"), (2, "qxz jvkw zzqx wvxj kkqz"), (3, "今日は天気がいい")]
    found = identify_languages(spark.createDataFrame(asked, "doc_id bigint, text string"), fitted).orderBy("row.doc_id").collect()
    assert [(r.lang_pred, r.rejected) for r in found][0] == ("en", False)
    assert [r.rejected for r in found[1:]] == [True, True]


def test_query_against_brute_force(spark):
    """Fitting and prediction of the registered query, restated with dictionaries, on tables small enough that every labelled row is sampled."""
    import math
    import zlib
    from collections import Counter

    import numpy as np

    def place(a, b, c):
        return ((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 20

    def trigrams(text):
        folded = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode())
        while b"  " in folded:
            folded = folded.replace(b"  ", b" ")
        return Counter(place(*folded[i : i + 3]) for i in range(len(folded) - 2))

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = [trigrams(d.text or "") for d in docs]
    has_letter = [any(c.isalpha() for c in d.text or "") for d in docs]
    held = [zlib.crc32(str(d.doc_id).encode()) % 5 == 0 for d in docs]
    used = [i for i, d in enumerate(docs) if not held[i] and d.lang is not None and has_letter[i] and counts[i]]
    met = Counter(p for i in used for p in counts[i])

    def vector(found):
        out = np.zeros(1 << 12)
        for p, n in found.items():
            out[p] = math.log1p(n) * (math.log((1 + len(used)) / (1 + met[p])) + 1)
        return out / max(np.linalg.norm(out), 1e-12)

    vectors = [vector(c) for c in counts]
    centroids = []
    for lang in sorted({docs[i].lang for i in used}):
        x = np.stack([vectors[i] for i in used if docs[i].lang == lang])
        centres = [x.mean(axis=0) / np.linalg.norm(x.mean(axis=0))]
        while len(centres) < min(4, len(x)):
            centres.append(x[int((x @ np.stack(centres).T).max(axis=1).argmin())])
        for _ in range(12):
            owner = (x @ np.stack(centres).T).argmax(axis=1)
            for c in set(owner.tolist()):
                centres[c] = x[owner == c].mean(axis=0) / np.linalg.norm(x[owner == c].mean(axis=0))
        centroids += [(lang, c) for c in centres]
    cosines = np.stack(vectors) @ np.stack([c for _, c in centroids]).T
    found = {r.doc_id: r for r in QUERIES["op8_languages"](spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(docs)
    agree = 0
    for i, d in enumerate(docs):
        r, best = found[d.doc_id], int(cosines[i].argmax())
        assert r.held_out == held[i] and 0 <= r.score <= 1 and (r.lang_pred == "und") == (not has_letter[i])
        agree += not has_letter[i] or (r.lang_pred == centroids[best][0] and abs(r.score - cosines[i][best]) < 0.01)
    assert agree >= 0.99 * len(docs)
