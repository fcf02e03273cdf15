import hashlib
import random
import re

import pytest

from gleanery.llm.contamination import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "naïve", "日本"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 12, 13, 14, 40])))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "..."), (2, items[2][1]), (33, "w1 w1 " * 10)]
    docs = [(0, None), (1, ""), (2, "—!"), (3, "w1 " * 500)]
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30, 400]))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randint(0, len(text))
            text[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i + 4, rng.choice([" ", ", ", "\n"]).join(text)))
    return docs + docs[-2:] + [(None, items[5][1])], items


@pytest.mark.parametrize("block_windows", [200_000, 7])
def test_against_brute_force_in_one_block_and_in_many(spark, block_windows):
    docs, items = fixture()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination(df, bench, block_windows=block_windows)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in found.select(columns).collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    row = contamination(docs, none).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (3, 0, False)
    assert contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_long_text(spark):
    item = " ".join(f"q{i}" for i in range(13))
    text = "filler " * 400_000 + item
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = contamination(df, spark.createDataFrame([(7, item)], "item_id bigint, text string")).first()
    assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (400_013, 13, ["7"], False)
