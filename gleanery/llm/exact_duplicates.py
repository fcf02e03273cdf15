"""Exact duplicates by a content sort.

Normalised texts are range-partitioned at sampled splitters and sorted on disk, so
equal ones are neighbours; every row is compared in full with the one before it.
The sort key is (first bytes, digest, bytes, id): its leading columns are short, so
the sampled splitters stay small however long the texts are, and the id lets a
group of copies of any size spread over several partitions. Runs that touch the
end of a partition are joined afterwards from two rows per partition.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from gleanery.llm.common import slices, trimmed, two_columns
from gleanery.session import cut_lineage

HEAD = 32


def _normalise(batches):
    for batch in slices(batches):
        bodies = [text.encode().lower() for text in batch.column("text").to_pylist()]  # of bytes: A-Z only
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([body[:HEAD] for body in bodies], pa.binary()),
                pa.array([hashlib.sha256(body).digest() for body in bodies], pa.binary()),
                pa.array(bodies, pa.binary()),
            ],
            ["id", "head", "digest", "body"],
        )


def _sweep(schema: pa.Schema):
    def flush(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def sweep(batches):
        part = TaskContext.get().partitionId()
        columns: list[list] = [[] for _ in schema]

        def close(edge):
            n = len(ids)
            for column, values in zip(
                columns, (ids, ids[:1] * n, [n] * n, [digest.hex()] * n, [True] + [False] * (n - 1), [edge] * n, [part] * n)
            ):
                column.extend(values)

        body, digest, ids, first = None, b"", [], True
        for batch in slices(batches):
            for i, d, b in zip(*(batch.column(c).to_pylist() for c in ("id", "digest", "body"))):
                if b == body:  # the full comparison with the neighbour
                    ids.append(i)
                    continue
                if ids:
                    close(first)
                    first = False
                body, digest, ids = b, d, [i]
            if len(columns[0]) >= 5_000:
                yield flush(columns)
                for column in columns:
                    column.clear()
        if ids:
            close(True)
        if columns[0]:
            yield flush(columns)

    return sweep


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the smallest
    (or ``keep="largest"``) id of its group is kept, exactly one row even where an id
    is repeated. A null text is the empty text and a group like any other; a null id
    loses to every other id; an empty table gives no rows. Other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    rows = two_columns(df, id_col, text_col)
    id_field = StructField("id", rows.schema["id"].dataType)
    sort_schema = StructType([id_field, *(StructField(c, BinaryType()) for c in ("head", "digest", "body"))])
    by_id = F.desc_nulls_last("id") if keep == "largest" else F.asc_nulls_last("id")
    ordered = (
        rows.mapInArrow(trimmed(_normalise), sort_schema)
        .repartitionByRange("head", "digest", by_id)
        .sortWithinPartitions("head", "digest", "body", by_id)
    )
    out_schema = StructType([
        id_field, StructField("keep_id", id_field.dataType), StructField("group_size", LongType()),
        StructField("text_sha256", StringType()), StructField("first", BooleanType()),
        StructField("edge", BooleanType()), StructField("part", IntegerType()),
    ])
    swept = cut_lineage(ordered.mapInArrow(trimmed(_sweep(to_arrow_schema(out_schema))), out_schema))
    # at most two runs per partition: a bounded side
    ends = swept.filter("edge AND first").groupBy(F.col("text_sha256").alias("sha")).agg(
        F.min_by("keep_id", "part").alias("whole_keep"), F.sum("group_size").alias("whole_size"), F.min("part").alias("whole_part")
    )
    joined = swept.join(F.broadcast(ends), F.col("edge") & (F.col("text_sha256") == F.col("sha")), "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("sha").isNull(), F.col("keep_id")).otherwise(F.col("whole_keep")).alias("keep_id"),
        F.coalesce("whole_size", "group_size").alias("group_size"),
        (F.col("first") & (F.col("sha").isNull() | (F.col("part") == F.col("whole_part")))).alias("kept"),
        "text_sha256",
    )
