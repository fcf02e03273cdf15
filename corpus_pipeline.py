"""From raw documents to token ids: language ID, exact dedup, near dedup, decontamination, piece encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All
but the last return the columns of ``docs``; columns beyond doc_id, text and lang are
carried along. Rows with a null text have no letter, so the first stage drops them.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.common import LOWER, UPPER, table
from gleanery.llm.contamination import contamination
from gleanery.llm.exact_duplicates import exact_duplicates
from gleanery.llm.languages import fit_languages, identify_languages
from gleanery.llm.near_duplicates import near_duplicates
from gleanery.llm.pieces import BLOCK_BYTES, encode_pieces, load_pieces
from gleanery.llm.queries import PIECE_MODEL
from gleanery.session import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled rows and drops what is rejected: no letter, or far from every centroid."""
    model = fit_languages(docs.filter("lang IS NOT NULL"))
    return identify_languages(docs, model).filter("NOT rejected").select("row.*")


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts; a row that is there twice stays once."""
    kept = exact_duplicates(docs, keep="largest").filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), 256)
    rows = docs.select(F.struct("*").alias("row"), digest.alias("digest"))
    same = (F.col("digest") == F.col("text_sha256")) & F.col("row.doc_id").eqNullSafe(F.col("kept_id"))
    once = Window.partitionBy("digest", "row.doc_id").orderBy(F.xxhash64("row"))
    rows = rows.join(kept, same, "left_semi").withColumn("n", F.row_number().over(once))
    return rows.filter("n = 1").select("row.*")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    dropped = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; rows pass through the operator whole, so nothing is joined."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("content"))
    return contamination(rows, table(spark, sf_dir, "benchmark"), "row", "content").filter("NOT contaminated").select("row.*")


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip, of every document.

    Blocks are smaller than where it runs alone, because other stages leave less memory;
    results are the same. Null and empty texts have
    no pieces, rows that are there twice are encoded twice, an empty table gives no rows.
    """
    return encode_pieces(docs, load_pieces(PIECE_MODEL), block_bytes=BLOCK_BYTES // 4)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", first_copies),
    ("MinHash near-dedup", distinct_texts),
    ("benchmark decontamination", clean_of_benchmark),
    ("SentencePiece encoding", piece_ids),
]

#: SQL cannot express the first stage; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
