"""Ranks, caps and running totals that never put a whole group in one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.session import cut_lineage

# Up to this n Spark itself keeps only n rows per group before the shuffle
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
_GROUP_LIMIT = 1000
_BLOCK = 4096
_SALTS = 256


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows of every group with their 1-based rank.

    A small n becomes a WindowGroupLimit, applied before the shuffle, so a hot
    group sends n rows per task. For a larger n the group is first cut to n per
    salt, which is exact: the first n overall are among the first n of each part.
    """
    if n > _GROUP_LIMIT:
        # hashed from the row itself, so that a repeated task salts alike
        hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        salt = F.pmod(F.xxhash64(*hashable), F.lit(_SALTS))
        df = df.withColumn("_salt", salt)
        part = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n).drop("_r", "_salt")
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based position of every row under a total order, without a one-task window.

    A range-partitioned sort numbers rows inside their partition; the partition
    sizes (one row per partition, so always small) give the offsets.
    """
    numbered = cut_lineage(df.sort(*order).withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright("_pos", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg((F.max("_pos") + 1 - F.min("_pos")).alias("_size"))
    before = F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_before") + within + 1)
        .drop("_part", "_pos", "_before")
    )


def running_total(
    df: DataFrame, keys: list[str], position: str, value: str, before: str, total: str
) -> DataFrame:
    """Sum of ``value`` at earlier positions of the key, and over the whole key.

    ``position`` is a non-negative integer, unique per key. Positions are cut in
    blocks: one window runs inside a block, a second one over block sums, so a
    key with very many rows spreads over its blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / _BLOCK))
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    by_key = W.partitionBy(*keys)
    earlier = by_key.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        *keys, "_block",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_sum").over(by_key).alias(total),
    )
    inside = W.partitionBy(*keys, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    return (
        blocked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*keys, "_block"])
        .withColumn(before, F.col("_start") + F.col("_inside"))
        .drop("_block", "_start", "_inside")
    )
