import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gleanery.llm.collocations import collocations, phrase_counts

SCHEMA = "doc_id bigint, text string, lang string, n bigint, words string, phrase string, kind int"


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, top=2_000, percent=100, widest=5):
    """By counting every phrase of every piece."""
    total, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, widest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            within = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and c >= least and 100 * c >= percent * a and within(q) for q, c in counts.items()):
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def fixture():
    rng = random.Random(5)
    common = ["the", "New", "york", "times", "Zürich", "a\x01b", "--", "é", "日本", "THE"]
    rows = []
    for _ in range(400):
        words = [rng.choice(common if rng.random() < 0.8 else [f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(40))]
        rows.append((rng.choice([" ", "  ", "\t"]).join(words).replace("york", rng.choice(["york", "york.", "york,"])), rng.choice(["en", "fr", None, "und"])))
    rows += [("new york times " * 30, "en")] * 7 + [("x " * 3_000 + "\n y", "de"), (None, "en"), ("", None), (" \t.,", "it"), ("one\x0bword", "fr")]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, 1, "clash", "clash", 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in collocations(df, **options).collect())


def test_against_brute_force(spark):
    rows = fixture()
    assert run(spark, rows, least=12) == brute(rows, 12)
    assert run(spark, rows, least=5, top=9, percent=60, widest=4) == brute(rows, 5, 9, 60, 4)


def test_a_hot_pair_over_many_parts(spark):
    rows = [(f"of the x{i % 50} of the y{i}", "en") for i in range(3_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert run(spark, rows, least=50) == brute(rows, 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("", "en")], least=1) == []


def test_phrases_carry_whole_counts(spark):
    df = spark.createDataFrame([("a b a b a",)] * 40, "text string").withColumn("lang", F.lit("en"))
    phrases, totals = phrase_counts(df, least=40)
    found = {" ".join(r.words): r.n for r in phrases.collect()}
    assert found == {"a": 120, "b": 80, "a b": 80, "b a": 80, "a b a": 80, "b a b": 40, "a b a b": 40, "b a b a": 40, "a b a b a": 40}
    assert [tuple(r) for r in totals.collect()] == [("en", 200)]
