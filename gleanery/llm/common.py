"""What the operators share: inputs, ASCII folding, Arrow plumbing."""

import contextlib
import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one vectorised step works on; bounds the arrays of a task, not the result.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns never clash; null texts are empty."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state() -> dict:
    """A dictionary of this Python process; functions travel by value, so their own module's globals do not last."""
    return sys.modules.setdefault("gleanery_worker_state", types.ModuleType("gleanery_worker_state")).__dict__


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, without a copy: what is built for each of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def give_back() -> None:
    """Returns memory that a task has freed to the system, so that an idle worker keeps little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(task):
    """A task over batches that gives its memory back when it is done."""

    def run(batches):
        yield from task(batches)
        give_back()

    return run


def text_steps(batch: pa.RecordBatch, column: str = "text", rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into steps of about STEP_BYTES and at most ``rows`` rows: first row, end row, bytes, offsets from 0.

    A row is never cut: a longer text is a step of its own. Null texts have no bytes.
    """
    texts = batch.column(column).cast(pa.large_string())
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, side="right")) - 1
        end = min(max(end, row + 1), row + rows, len(texts))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
