"""The chunk collection: Parquet parts, partitioned by content type, named by numbered versions.

Every write is a part of its own, made visible by publishing the next version (see
``versions``); a batch that is written twice (a retried job, a replayed stream batch) takes
the place of its first part and keeps its time. Deleting a document adds its id and the
time to a small table of deletions, and reading anti-joins it, so a delete costs one
filtered scan instead of a rewrite of the collection.

``build_cells`` stores all rows once more by their nearest centres. It covers the parts of
its version: rows that come later are searched exactly beside it, deleted documents
and replaced batches drop out of it, and building again is the caller's decision.

Beside every part lie its number of chunks and a theta sketch of its documents, beside every
deletion the same of what it took from each part. United and subtracted they answer
``stats(approximate=True)`` without a row being read.
"""

import logging
import time
import uuid
from urllib.parse import quote

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.urls import document_id
from gleanery.operators.embedding import Loader, reject_reason
from gleanery.operators import ivf
from gleanery.operators.search import combine_filters, merge_hits, nearest, project_hits, response_columns, text_search, vector_search, with_columns_of
from gleanery.operators.summaries import collection_stats, reassemble_documents, stats_row
from gleanery.schema import BYTE_LIMITS, CHUNK_METADATA, COLLECTION, DEFAULT_DIMENSION, DEFAULT_K, DEFAULT_MODEL_NAME, DEFAULT_NLIST, DEFAULT_NPROBE
from gleanery.session import cut_lineage, remembered
from gleanery.sources.versions import VersionLog

_CENTERS = "cell int, center array<double>, radius double, n bigint"
_MEASURES = "part string, chunks bigint, documents binary"
_DELETIONS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("deleted_at", T.LongType())])


def _metadata(names: tuple[str, ...], nested: tuple[str, ...] | None) -> Column:
    """The stored metadata struct, from a struct column with the fields ``nested`` or from flat columns."""
    if nested is not None:
        have = set(nested)
        pick = lambda name: F.col(f"metadata.{name}")
    else:
        have, pick = set(names), F.col
    return F.struct(*[
        (pick(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNK_METADATA.fields
    ])


def _dynamic(kind: T.DataType | None) -> Column:
    """The dynamic field of chunks, column ``dynamic``: a variant, a JSON string, or a map or struct whose types are kept."""
    if kind is None:
        return F.lit(None).cast("variant")
    if isinstance(kind, T.VariantType):
        return F.col("dynamic")
    if isinstance(kind, T.StringType):
        return F.try_parse_json("dynamic")  # what is no JSON is null
    return F.to_variant_object("dynamic")


def collection_rows(chunks: DataFrame, embedding_model: str = DEFAULT_MODEL_NAME, dynamic: bool = False) -> DataFrame:
    """Chunks in stored form: a null document id becomes '', a missing chunk id is derived."""
    kinds = {f.name: f.dataType for f in chunks.schema.fields}
    nested = tuple(kinds["metadata"].fieldNames()) if "metadata" in kinds else None
    return chunks.select(*_stored_columns(tuple(kinds), nested, embedding_model, dynamic, kinds.get("dynamic")))


@remembered
def _stored_columns(names: tuple[str, ...], nested: tuple[str, ...] | None, embedding_model: str, dynamic: bool, kind: T.DataType | None) -> list[Column]:
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    index = F.col("chunk_index" if "chunk_index" in names else "metadata.chunk_index")
    derived = document_id(F.concat_ws("#", doc_id, index.cast("string"), F.col("content")))
    return [
        doc_id.alias("doc_id"),
        F.coalesce(F.col("chunk_id").cast("string"), derived).alias("chunk_id"),
        "content",
        F.lit(embedding_model).alias("embedding_model"),
        F.col("vector").cast("array<float>").alias("vector"),
        _metadata(names, nested).alias("metadata"),
        F.col("content_type"),
        *([_dynamic(kind).alias("dynamic")] if dynamic else []),
    ]


@remembered
def _refusal(names: tuple[str, ...], dimension: int) -> Column:
    """Why a row in stored form cannot be stored; null for one that can."""
    vector = F.concat(F.lit("vector: "), reject_reason(F.col("vector"), dimension))
    long = [F.when(F.octet_length(name) > limit, f"{name}: more than {limit} bytes") for name, limit in BYTE_LIMITS.items() if name in names]
    return F.coalesce(vector, *long)


@remembered
def _refused_by_kind() -> list[Column]:
    return [F.count_if(F.startswith(F.col("reason"), F.lit(f"{kind}:"))).alias(kind) for kind in ("vector", *BYTE_LIMITS)]


@remembered
def _measured() -> list[Column]:
    return [F.count("*").alias("chunks"), F.theta_sketch_agg("doc_id").alias("documents")]


def _new_part() -> str:
    return f"p{uuid.uuid4().hex}"


class Collection:
    def __init__(
        self, spark: SparkSession, path: str, dimension: int = DEFAULT_DIMENSION, version: int | None = None, dynamic: bool = False
    ) -> None:
        """The newest version at every call, or always the given one, which then is only read.

        With ``dynamic`` the rows have one more column for fields that no schema names, and filters look them up there.
        """
        self.spark, self.dimension, self.path, self.version, self.dynamic = spark, dimension, path, version, dynamic
        self.schema = T.StructType([*COLLECTION.fields, *([T.StructField("dynamic", T.VariantType())] if dynamic else [])])
        self.versions = VersionLog(spark, f"{path}/versions")
        self._rows, self._deletions, self._cells = f"{path}/rows", f"{path}/deletions", f"{path}/cells"
        self._measures = f"{path}/measures"

    def create(self, drop_old: bool = False) -> "Collection":
        """Create the empty collection; an existing one is kept unless ``drop_old``."""
        if drop_old or not self.versions.numbers():
            self._change(lambda state: {})
        return self

    def clear(self) -> None:
        """Empty the collection, keep its schema. Readers of earlier versions keep their rows."""
        self.create(drop_old=True)

    def at(self, version: int | None = None) -> "Collection":
        """The collection pinned to a version, by default the newest."""
        return Collection(self.spark, self.path, self.dimension, version or self.versions.state()[0], self.dynamic)

    def _state(self) -> dict:
        number, state = self.versions.state(self.version)
        if not number:
            raise ValueError(f"no collection at {self.path}; create it first")
        return {"rows": [], "deletions": [], "cells": None, **state}

    def _change(self, make) -> dict:
        if self.version is not None:
            raise ValueError("a collection pinned to a version is only read")
        return self.versions.change(lambda state: make({"rows": [], "deletions": [], "cells": None, **state}))[1]

    def append(
        self,
        chunks: DataFrame,
        embedding_model: str = DEFAULT_MODEL_NAME,
        content_types: list[str] | None = None,
        batch: str | None = None,
    ) -> DataFrame:
        """Store the chunks with a sound vector, short enough strings and an admitted type; ids of what was stored.

        What is refused is counted by reason in the same pass and warned about;
        ``rejects`` gives the rows. A batch that is written again is replaced as a
        whole and keeps its first time, so that a document deleted meanwhile stays
        deleted; until the new rows are complete the old ones stay.
        """
        batch = batch or f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        state = self._state()
        before = [e["added_at"] for e in state["rows"] if e["batch"] == batch]
        added_at = min(before, default=time.time_ns())
        entry = {"batch": batch, "part": _new_part(), "added_at": added_at}
        judged = self._judged(chunks, embedding_model)
        counted, measured = Observation(), Observation()
        judged = judged.observe(counted, *_refused_by_kind())
        accepted = judged.where("reason IS NULL")
        if content_types is not None:
            accepted = accepted.where(F.col("content_type").isin(list(content_types)))
        stamped = accepted.withColumn("added_at", F.lit(added_at))
        stored = [c for c in self.schema.fieldNames() if c != "batch"]
        self._write(stamped.select(stored).observe(measured, *_measured()), self._part_path(entry))
        written, now = self._read_parts([entry]), self._state()
        if now["deletions"] and (before or now["deletions"] != state["deletions"]):  # some of the rows may be deleted already
            self._measure(self._kept(written, now).withColumn("part", F.lit(entry["part"])), entry["part"])
        else:
            found = measured.get
            row = self.spark.range(0, 1, 1, 1).select(
                F.lit(entry["part"]).alias("part"), F.lit(found["chunks"]).cast("bigint").alias("chunks"), F.lit(bytes(found["documents"])).alias("documents")
            )
            row.write.parquet(f"{self._measures}/{entry['part']}")
        now = self._change(lambda state: {**state, "rows": [e for e in state["rows"] if e["batch"] != batch] + [entry]})
        refused = {kind: n for kind, n in counted.get.items() if n}
        if refused:
            logging.getLogger(__name__).warning("batch %s: chunks refused: %s", batch, refused)
        return self._kept(written, now).select("chunk_id")

    def _judged(self, chunks: DataFrame, embedding_model: str) -> DataFrame:
        rows = collection_rows(chunks, embedding_model, self.dynamic)
        return rows.withColumn("reason", _refusal(tuple(rows.columns), self.dimension))

    def rejects(self, chunks: DataFrame, embedding_model: str = DEFAULT_MODEL_NAME) -> DataFrame:
        """The chunks that ``append`` would refuse, in stored form, each with its reason."""
        return self._judged(chunks, embedding_model).where("reason IS NOT NULL")

    def append_documents(self, documents: DataFrame, **options) -> DataFrame:
        """Store documents with a nested ``chunks`` array; the ids of all documents."""
        flat = documents.select(
            "doc_id", "content_type", *(["source"] if "source" in documents.columns else []),
            F.size("chunks").alias("chunk_count"), "chunks",
        ).select(
            *[c for c in ("doc_id", "content_type", "source", "chunk_count") if c in documents.columns or c == "chunk_count"],
            F.inline("chunks"),
        )
        self.append(flat, **options)
        return documents.select("doc_id").distinct()

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        """Rows of a document side by side, and filters by document and source beside them: a lookup skips most row groups."""
        writer = rows.sortWithinPartitions("content_type", "doc_id").write.partitionBy("content_type")
        for name in ("doc_id", "metadata.source"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer.parquet(path)

    def _part_path(self, entry: dict) -> str:
        return f"{self._rows}/batch={quote(entry['batch'], safe=' ')}/part={entry['part']}"

    def _read_parts(self, entries: list[dict], *more: str) -> DataFrame:
        columns = [*self.schema.fieldNames(), *more]
        if not entries:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, *(T.StructField(c, T.StringType()) for c in more)]))
        rows = self.spark.read.schema(self.schema).option("basePath", self._rows).parquet(*map(self._part_path, entries))
        if "part" not in rows.columns:  # parts without any row
            rows = rows.withColumn("part", F.lit(None).cast("string"))
        return rows.select(*columns)

    def _kept(self, rows: DataFrame, state: dict) -> DataFrame:
        """Without deleted documents. The deletions are broadcast by Spark while they are small."""
        if not state["deletions"]:
            return rows
        gone = self.spark.read.schema(_DELETIONS).parquet(*(f"{self._deletions}/{part}" for part in state["deletions"]))
        deleted = (rows["doc_id"] == gone["doc_id"]) & (rows["added_at"] <= gone["deleted_at"])
        return rows.join(gone, deleted, "left_anti")

    def _measure(self, rows: DataFrame, name: str) -> None:
        """Store how many chunks of each part ``rows`` hold, and a sketch of their documents."""
        measured = rows.groupBy("part").agg(*_measured())
        measured.coalesce(1).write.parquet(f"{self._measures}/{name}")

    def _read_measures(self, names: list[str]) -> DataFrame:
        paths = [f"{self._measures}/{name}" for name in names]
        return self.spark.read.schema(_MEASURES).parquet(*paths) if paths else self.spark.createDataFrame([], _MEASURES)

    def read_all(self) -> DataFrame:
        """All rows, deleted documents included."""
        return self._read_parts(self._state()["rows"])

    def read(self) -> DataFrame:
        """Current rows."""
        state = self._state()
        return self._kept(self._read_parts(state["rows"]), state)

    def scan(self, condition: Column | str | None = None, columns: list[str] | None = None, filters: dict | None = None) -> DataFrame:
        """Rows that satisfy an expression and a filter dictionary, with chosen fields."""
        rows = self.read().where(combine_filters(filters, self.dynamic))
        if condition is not None:
            rows = rows.where(condition)
        return rows.select(*columns) if columns else rows

    def documents(self, condition: Column | str | None = None) -> DataFrame:
        """Documents put together from their chunks; no chunks, no row."""
        return reassemble_documents(self.scan(condition))

    def _placed(self) -> DataFrame:
        """Current rows with the part they lie in."""
        state = self._state()
        return self._kept(self._read_parts(state["rows"], "part"), state)

    def delete(self, doc_ids: DataFrame) -> DataFrame:
        """Delete documents by ``doc_id``: every asked id with ``deleted`` true or false."""
        asked = doc_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        deleted = self._mark_deleted(self._placed().join(asked, "doc_id", "left_semi")).withColumn("_hit", F.lit(True))
        return asked.join(deleted, "doc_id", "left").select("doc_id", F.coalesce("_hit", F.lit(False)).alias("deleted"))

    def delete_document(self, doc_id: str) -> bool:
        """Delete one document; the id reaches the scan as a filter."""
        return not self._mark_deleted(self._placed().where(F.col("doc_id") == doc_id)).isEmpty()

    def _mark_deleted(self, rows: DataFrame) -> DataFrame:
        """Record the documents of ``rows`` as deleted now, and what that takes from each part; their ids."""
        now, part = time.time_ns(), _new_part()
        gone = cut_lineage(rows.select("doc_id", "part"))
        marks = gone.select("doc_id").distinct().withColumn("deleted_at", F.lit(now))
        marks.write.parquet(f"{self._deletions}/{part}")
        self._measure(gone, part)
        self._change(lambda state: {**state, "deletions": [*state["deletions"], part]})
        return self.spark.read.schema(_DELETIONS).parquet(f"{self._deletions}/{part}").select("doc_id")

    def compact_to(self, path: str) -> "Collection":
        """Copy what is left after deletions to a new collection, for the caller to switch to.

        All batches become one, in few files per content type; the rebalance splits a
        type that holds very many rows. Worth it once batches are many and small, or
        deletions too many to be broadcast on every read.
        """
        target = Collection(self.spark, path, self.dimension, dynamic=self.dynamic).create()
        entry = {"batch": f"compact-{time.time_ns()}", "part": _new_part(), "added_at": time.time_ns()}
        rows = self.read().drop("batch").hint("rebalance", "content_type")
        self._write(rows, target._part_path(entry))
        target._measure(target._read_parts([entry], "part").withColumn("part", F.lit(entry["part"])), entry["part"])
        target._change(lambda state: {**state, "rows": [entry]})
        return target

    # --- cells ---------------------------------------------------------------

    def build_cells(self, nlist: int = DEFAULT_NLIST, centers: np.ndarray | None = None, **training) -> "Collection":
        """Store the rows of the newest version by their nearest centres, trained on them unless given.

        Content stays in the rows; the cells hold what filters and scores need.
        """
        state = self._state()
        rows = self._kept(self._read_parts(state["rows"], "part"), state)
        if centers is None:
            centers = ivf.train_cells(rows, nlist, dimension=self.dimension, **training)
        part = _new_part()
        assigned = ivf.ivf_assign(rows.drop("content"), centers)
        stored = ivf.write_cells(assigned, f"{self._cells}/{part}/rows")
        sizes = ivf.cell_sizes(stored, centers)
        table = [(i, [float(x) for x in c], r, n) for i, (c, (r, n)) in enumerate(zip(centers, sizes))]
        self.spark.createDataFrame(table, _CENTERS).coalesce(1).write.parquet(f"{self._cells}/{part}/centers")
        covered = [e["part"] for e in state["rows"]]
        self._change(lambda now: {**now, "cells": {"part": part, "covers": covered}})
        return self

    def cells(self) -> tuple[DataFrame, np.ndarray, np.ndarray, DataFrame]:
        """(current rows in cells, centres, radii, current rows beside them)."""
        state = self._state()
        if state["cells"] is None:
            raise ValueError("the collection has no cells; build_cells makes them")
        folder, covers = f"{self._cells}/{state['cells']['part']}", set(state["cells"]["covers"])
        table = self.spark.read.parquet(f"{folder}/centers").orderBy("cell").collect()  # one row per cell
        schema = T.StructType([f for f in self.schema.fields if f.name != "content"] + [T.StructField("part", T.StringType()), T.StructField("_cell", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{folder}/rows")
        gone = covers.difference(e["part"] for e in state["rows"])  # replaced batches
        if gone:
            rows = rows.where(~F.col("part").isin(sorted(gone)))
        beside = self._read_parts([e for e in state["rows"] if e["part"] not in covers])
        centers = np.array([r["center"] for r in table], np.float32).reshape(len(table), self.dimension)
        return self._kept(rows, state), centers, np.array([r["radius"] for r in table]), self._kept(beside, state)

    def _cell_search(
        self, queries: DataFrame, k: int = DEFAULT_K, filters: dict | None = None, metric: str = "L2", include_metadata: bool = True,
        include_vectors: bool = False, nprobe: int | None = None, **options,
    ) -> DataFrame:
        rows, centers, radii, beside = self.cells()
        wanted = combine_filters(filters, self.dynamic)
        rows, beside = rows.where(wanted), beside.where(wanted)
        if nprobe is None:
            found = ivf.bounded_search(queries, rows, centers, radii, k, metric, output=[], **options)
        else:
            found = ivf.ivf_search(queries, rows, centers, k, nprobe, metric, output=[], **options)
        fresh = nearest(queries, beside, k, metric, output=[], dimension=self.dimension, **options)
        best = merge_hits([found, fresh], k, metric)
        output = response_columns(include_metadata, include_vectors)
        return project_hits(with_columns_of(best, self.read(), output), include_metadata, include_vectors)

    def search(
        self, queries: DataFrame, using: str = "rows", nprobe: int = DEFAULT_NPROBE, filters: dict | None = None, **options
    ) -> DataFrame:
        """Filtered top-k search for (query_id, vector); see ``operators.search.vector_search``.

        ``using`` names the way: "rows" scores every row; "bounds" gives the same hits from
        the stored cells, passing over those that cannot hold one; "cells" is
        approximate and probes the ``nprobe`` nearest. Queries of another
        length than the collection's are not compared.
        """
        if using == "rows":
            return vector_search(queries, self.scan(filters=filters), dimension=self.dimension, **options)
        if using not in ("bounds", "cells"):
            raise ValueError("using is one of rows, bounds, cells")
        return self._cell_search(queries, nprobe=nprobe if using == "cells" else None, filters=filters, **options)

    def text_search(self, queries: DataFrame, loader: Loader, filters: dict | None = None, **options) -> DataFrame:
        """The same over all rows for text queries (query_id, text)."""
        return text_search(queries, self.scan(filters=filters), loader, dimension=self.dimension, **options)

    def stats(self, approximate: bool = False, **options) -> DataFrame:
        """Counts of chunks and documents; see ``collection_stats``.

        With ``approximate`` they come from what was stored beside parts and deletions: no row
        is read, chunks are exact, documents are exact up to 4,096 and within a few
        percent beyond. A deletion that runs while its batch is written again is not
        taken from the new part's counts.
        """
        if not approximate:
            return collection_stats(self.read(), self.dimension, **options)
        state = self._state()
        stored = self._read_measures([e["part"] for e in state["rows"]])
        taken = self._read_measures(state["deletions"]).groupBy("part").agg(F.sum("chunks").alias("_n"), F.theta_union_agg("documents").alias("_gone"))
        left = stored.join(taken, "part", "left").select(
            (F.col("chunks") - F.coalesce("_n", F.lit(0))).alias("chunks"),
            F.when(F.col("_gone").isNull(), F.col("documents")).otherwise(F.theta_difference("documents", "_gone")).alias("documents"),
        )
        counts = left.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.theta_sketch_estimate(F.theta_union_agg("documents")), F.lit(0)).alias("documents"))
        return stats_row(counts, self.dimension, **options)

    def vacuum(self, keep: int = 1) -> int:
        """Remove the parts that none of the newest ``keep`` versions names, and the older versions; the number of parts removed.

        For a time at which no writer is at work and no reader holds an older version.
        """
        removed = self.versions.remove_before(keep, self.path, lambda state: [
            *(f"rows/batch={quote(e['batch'], safe=' ')}/part={e['part']}" for e in state.get("rows", [])),
            *(f"deletions/{part}" for part in state.get("deletions", [])),
            *(f"measures/{part}" for part in [*(e["part"] for e in state.get("rows", [])), *state.get("deletions", [])]),
            *([f"cells/{state['cells']['part']}"] if state.get("cells") else []),
        ])
        return sum(not part.startswith("measures/") for part in removed)
