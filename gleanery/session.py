"""Shared-folder handling: the one place that decides where intermediate data goes."""

import functools
import gc
import tempfile
import uuid
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would not be readable by other executors,
    so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="gleanery-")
    return _LOCAL_FOLDERS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is ever overwritten there."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Later stages start from files, so a lost executor costs a re-read instead
    of a replay of the whole plan, and loops keep a constant plan size. Files
    carry exact sizes, which lets adaptive execution pick join strategies.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets go of the shuffle files of queries that are over; otherwise they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def append_rows(df: DataFrame, path: str) -> DataFrame:
    """Add rows to a table in the shared folder; the whole table as it is now.

    For loops that remember what they met: the plan has one scan, however many rounds.
    """
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer partitions than cores one partition per core.

    For CPU-heavy steps over small inputs only. A large input already has more
    partitions than cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def remembered(build):
    """Columns made by ``build`` are made once for the same arguments of one application, and used again.

    Columns name what they read and hold no data, so every micro-batch can have the same;
    making hundreds of them anew takes longer than a small batch. Arguments that are columns
    are the same if they are the same object; the cache holds them as long as it holds the result.
    """
    cache: OrderedDict = OrderedDict()

    @functools.wraps(build)
    def columns(*args):
        spark = SparkSession.active()
        key = (spark.sparkContext.applicationId, *(id(a) if isinstance(a, Column) else a for a in args))
        if key not in cache:
            cache[key] = args, build(*args)
            if len(cache) > 64:
                cache.popitem(last=False)
        return cache[key][1]

    return columns
