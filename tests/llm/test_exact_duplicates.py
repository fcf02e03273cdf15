import hashlib

import pytest
from pyspark.sql import functions as F

from gleanery.llm.exact_duplicates import exact_duplicates

SCHEMA = "doc_id bigint, text string, keep_id string, kept string"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, largest):
    groups = {}
    for row in rows:
        groups.setdefault(fold(row[1]), []).append(row[0])
    pick = max if largest else min
    return {
        hashlib.sha256(text.encode()).hexdigest(): (pick((i for i in ids if i is not None), default=None), len(ids)) for text, ids in groups.items()
    }


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups_with_nulls_case_repeats_and_clashing_columns(spark, keep):
    rows = [
        (1, "Same Text"), (2, "same text"), (3, "SAME TEXT "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 70_000), (9, "X" * 70_000),
        (10, "x" * 69_999 + "y"), (11, "once"), (11, "once"), (None, "once"), (None, "alone"), (None, "alone"),
    ]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)
    found = exact_duplicates(df, keep=keep).collect()
    expected = brute(rows, keep == "largest")
    assert len(found) == len(rows)
    assert {(r.text_sha256, r.keep_id, r.group_size) for r in found} == {(sha, *v) for sha, v in expected.items()}
    kept = [r for r in found if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(expected)  # one row of each group, repeated ids too
    assert all(r.doc_id == r.keep_id for r in kept)


def test_a_group_larger_than_a_partition_is_joined_across_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
        found = exact_duplicates(df, keep="largest")
        copies = found.filter("group_size > 1")
        assert copies.agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.min("group_size")).first()[:] == (3000, 3999, 3999, 3000)
        assert found.filter("kept").count() == 1001
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
