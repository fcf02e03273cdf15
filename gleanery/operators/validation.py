"""Validation: every rule set splits its input into valid rows and rejects with reasons."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.schema import BYTE_LIMITS, CHUNK_OVERLAP_BOUNDS, CHUNK_SIZE_BOUNDS, CHUNK_STRATEGIES, MAX_K, MIN_K


def _reasons(rules: dict[str, Column]) -> Column:
    """Names of the broken rules; a rule is a condition that must not hold."""
    named = [F.when(broken, name) for name, broken in rules.items()]
    return F.filter(F.array(*named), lambda r: r.isNotNull())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by the ``reasons`` column."""
    return df.where(F.size("reasons") == 0).drop("reasons"), df.where(F.size("reasons") > 0)


def validate_sources(sources: DataFrame) -> DataFrame:
    """At most one of url, file_path, content; none at all is reported as ``empty``."""
    given = sum(F.col(c).isNotNull().cast("int") for c in ("url", "file_path", "content"))
    return sources.withColumn("reasons", _reasons({"exclusive": given > 1, "empty": given == 0}))


def validate_chunking(requests: DataFrame) -> DataFrame:
    """Chunk size, overlap and token limits of ingest requests."""
    size, overlap, tokens = F.col("chunk_size"), F.col("chunk_overlap"), F.col("max_tokens")
    return requests.withColumn("reasons", _reasons({
        "chunk_size_range": ~size.between(*CHUNK_SIZE_BOUNDS),
        "chunk_overlap_range": ~overlap.between(*CHUNK_OVERLAP_BOUNDS),
        "max_tokens_positive": tokens <= 0,
        "overlap_exceeds_size": overlap > size,
    }))


def validate_strategy(requests: DataFrame) -> DataFrame:
    return requests.withColumn("reasons", _reasons({"unknown_strategy": ~F.col("strategy").isin(*CHUNK_STRATEGIES)}))


def validate_search(requests: DataFrame) -> DataFrame:
    return requests.withColumn("reasons", _reasons({"k_range": ~F.col("k").between(MIN_K, MAX_K)}))


def validate_rows(rows: DataFrame) -> DataFrame:
    """Byte limits of the stored string columns."""
    return rows.withColumn("reasons", _reasons({
        f"{name}_too_long": F.octet_length(name) > limit for name, limit in BYTE_LIMITS.items()
    }))
