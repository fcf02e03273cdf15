import random
import re

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm.components import components
from gleanery.llm.near_duplicates import densified, near_duplicates, probing_ranks
from gleanery.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def fixture():
    rng = random.Random(3)
    rows = []
    for group in range(25):
        base = [f"g{group}w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 3, 5, 8, 30, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"n{rng.random()}"
            rows.append(" ".join(text))
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [f"{shared} " + " ".join(f"u{i}x{j}" for j in range(30)) for i in range(30)]
    rows += [None, "", " \t\n", "One", "one", "x " * 20_000, "X " * 30_000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id bigint, text string, n bigint, key string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert found == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None), (3, "a b c")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found), key=repr) == sorted(
        [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 1, False), (3, 1, False)], key=repr
    )


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_densified_signatures_agree_as_sets_do():
    rng = np.random.default_rng(1)
    ranks, agreed = probing_ranks(128), []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 20, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(x[:16]), np.unique(x[4:])
        agreed.append((densified(a, 128, ranks) == densified(b, 128, ranks)).mean())
    assert abs(np.mean(agreed) - 12 / 20) < 0.03


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200)]
    found = dict(components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}


def test_a_hot_group_gives_pairs_in_proportion(spark):
    words = F.expr("transform(sequence(1, 40), i -> concat('w', i))")
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.array_join(words, " "), F.lit(" tail"), F.col("id")).alias("text"))
    found = near_duplicates(df)
    assert found.filter("component_id = 0").count() == 600 and found.filter("kept").count() == 1


def test_no_link_of_a_large_mixed_bucket_is_missed(spark, monkeypatch):
    """A family near 0.70 to one another, too low to link, shares buckets; pairs planted in it at 0.77 are links."""
    monkeypatch.setattr("gleanery.llm.near_duplicates.CENTRES", 1)
    rng = random.Random(11)
    own = iter(range(10**9))

    def varied(words, edits):
        words = list(words)
        for at in rng.sample(range(0, len(words) - 5, 6), edits):
            words[at] = f"own{next(own)}"
        return words

    template = [f"t{i}" for i in range(400)]
    family = [varied(template, 8) for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate(family)]
    rows += [(1000 + i, " ".join(varied(family[i], 10))) for i in (40, 80, 120)]
    expected = brute(rows)
    assert 100 < len({c for _, c in expected.values()}) < len(rows)  # some are linked, most are not
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bins=8, rows=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_a_family_that_does_not_link_gives_pairs_in_proportion(spark, monkeypatch):
    """Rows with a long passage in common, too unlike to link, share many buckets of ever other members."""
    made = {}

    def counted(df):
        out = cut_lineage(df)
        made.setdefault(tuple(out.columns), []).append(out.count())
        return out

    monkeypatch.setattr("gleanery.llm.near_duplicates.cut_lineage", counted)
    passage = " ".join(f"p{i}" for i in range(64))
    rows = [(i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(18))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 300, 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()} == brute(rows)
    assert max(made["a", "b"]) < 30 * len(rows)  # all pairs tested
    assert sum(made["key", "id", "n", "m", "c"]) <= 2 * made["key", "id", "n", "m", "centre"][0]  # rows of mixed buckets in all turns


def test_texts_without_candidates_stay_where_they_are(spark, monkeypatch):
    from gleanery.llm import near_duplicates as module

    moved, perhaps = [], module._perhaps

    def counted(rows, keys, column):
        out = perhaps(rows, keys, column)
        moved.append((rows.columns, out.count(), out.join(keys, column, "left_semi").count(), rows.join(keys, column, "left_semi").count()))
        return out

    monkeypatch.setattr(module, "_perhaps", counted)
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(2_000)]
    rows += [(5_000 + i, rows[i][1] + " more") for i in range(20)]
    found = module.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.component_id for r in found.filter("NOT kept").collect()) == list(range(20))
    assert all(met == wanted for _, _, met, wanted in moved)  # nothing is lost
    assert [n for columns, n, *_ in moved if columns == ["id", "text"]][0] < 100  # of 2,020 texts
    assert [n for columns, n, *_ in moved if "key" in columns][0] < 5_000  # of 64,640 rows of buckets


def test_texts_move_only_for_pairs_that_may_be_links(spark, monkeypatch):
    """A family too unlike to link gives many pairs; their outlines tell nearly all of them, and no link, without a text."""
    from gleanery.llm import near_duplicates as module

    moved, perhaps = [], module._perhaps

    def counted(rows, keys, column):
        if rows.columns == ["id", "text"] and keys.columns == ["id"]:  # not those of the prefix join, a row each
            moved.append(keys.count())
        return perhaps(rows, keys, column)

    monkeypatch.setattr(module, "_perhaps", counted)
    passage = " ".join(f"p{i}" for i in range(64))
    rows = [(i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(30))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 300, 50)]
    found = module.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)
    assert sum(moved[1:]) < len(rows)  # the first call keeps the texts of candidates; two ids for each pair


def test_outlines_of_links_always_pass(spark):
    from gleanery.llm.near_duplicates import _likely, _outlines

    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = [f"g{i}w{j}" for j in range(rng.choice([3, 20, 90, 400, 3_000]))]
        rows.append((2 * i, " ".join(base)))
        rows.append((2 * i + 1, " ".join(base[: len(base) - rng.randrange(len(base) // 3)])))
    sets = {i: shingles(t) for i, t in rows}
    links = {(2 * i, 2 * i + 1) for i in range(60) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 75 * len(sets[2 * i] | sets[2 * i + 1])}
    df = spark.createDataFrame(rows, "id bigint, text string")
    outlines = df.mapInArrow(_outlines(5), "id bigint, n bigint, bits array<bigint>")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(60)] + [(2 * i, 2 * i + 2) for i in range(59)], "a bigint, b bigint")
    found = {(r.a, r.b) for r in _likely(pairs, outlines, 75).collect()}
    assert links and links <= found and len(found) < 119
