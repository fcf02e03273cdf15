"""Language identification by nearest centroid.

A text is a vector of hashed byte trigrams, logarithmic counts times inverse document
frequency, of length one. Each language has several centroids, found by spherical
k-means on a bounded sample of labelled rows; document frequencies cover all labelled
rows with a trigram. A text goes to the language of the centroid with the largest
cosine and is rejected when it is farther from it, by a margin, than nearly all sampled
texts of that language are from their own nearest centroid; a small share of bad
labelled rows does not move that distance.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import slices, text_steps, trimmed
from gleanery.session import cut_lineage

SIZE = 1 << 12
CENTROIDS = 4
#: Labelled rows per language that centroids are fitted on, in expectation.
SAMPLE_ROWS = 2_000
#: A text is rejected below this share of a low quantile of the cosines in its language's sample.
MARGIN = 0.5
#: The quantile; of fewer rows than its inverse, the least cosine but one.
BAD_SHARE = 0.05
_ROWS = 256


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray


def _folded_bytes() -> np.ndarray:
    """a-z for letters of either case, bytes beyond ASCII as they are, all else space."""
    folded = np.full(256, 32, np.uint8)
    folded[97:123] = folded[65:91] = np.arange(97, 123)
    folded[128:] = np.arange(128, 256)
    return folded


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams: one row per text."""
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    data = _folded_bytes()[data]
    if len(data) > 1:  # runs of spaces are one
        keep = np.concatenate([[True], ~((data[1:] == 32) & (data[:-1] == 32) & (owner[1:] == owner[:-1]))])
        data, owner = data[keep], owner[keep]
    if len(data) < 3:
        return np.zeros((rows, SIZE), np.float32)
    whole = owner[:-2] == owner[2:]
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(2654435761)
    place = owner[:-2][whole] * SIZE + (code[whole] >> np.uint32(20))
    return np.bincount(place, minlength=rows * SIZE).reshape(rows, SIZE).astype(np.float32)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.maximum(norms, 1e-12)


def _frequencies(batches):
    total, n = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for row, end, data, offsets in text_steps(batch, rows=_ROWS):
            met = trigram_counts(data, offsets) > 0
            total += met.sum(axis=0)
            n += int(met.any(axis=1).sum())
    yield pa.RecordBatch.from_arrays([pa.array([*range(SIZE), -1], pa.int32()), pa.array([*total.tolist(), n], pa.int64())], ["place", "n"])


def _sampled(idf):
    def vectors(batches):
        for batch in batches:
            for row, end, data, offsets in text_steps(batch, rows=_ROWS):
                found = _vectors(trigram_counts(data, offsets), idf).astype(np.float32)
                some = np.flatnonzero(found.any(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(row, end - row).take(pa.array(some)), pa.array([v.tobytes() for v in found[some]], pa.binary())],
                    ["lang", "vector"],
                )

    return vectors


def _clustered(k: int, rounds: int = 12):
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means from centres spread by farthest-first; independent of the order of rows."""
        raw = sorted(group["vector"])
        x = np.stack([np.frombuffer(v, np.float32) for v in raw])
        centres = [x.mean(axis=0) / max(np.linalg.norm(x.mean(axis=0)), 1e-12)]
        while len(centres) < min(k, len(x)):
            nearest = (x @ np.stack(centres).T).max(axis=1)
            centres.append(x[int(nearest.argmin())])
        centres = np.stack(centres)
        for _ in range(rounds):
            owner = (x @ centres.T).argmax(axis=1)
            for c in range(len(centres)):
                if (owner == c).any():
                    mean = x[owner == c].mean(axis=0)
                    centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
        cosine = x @ centres.T
        owner = cosine.argmax(axis=1)
        used = [c for c in range(len(centres)) if (owner == c).any()]
        floors = float(np.quantile(cosine.max(axis=1), BAD_SHARE, method="higher"))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [centres[c].astype(np.float32).tobytes() for c in used], "floor": floors})

    return fit


def fit_languages(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS, margin: float = MARGIN,
) -> Model:
    """A model from labelled rows; rows without label, text, letter or trigram are ignored.

    Document frequencies are taken over all others; centroids are fitted on about
    ``sample_rows`` of each language, picked by a hash of their id and text.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.select("text").mapInArrow(trimmed(_frequencies), "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    seen = {r["place"]: r["n"] for r in counts}
    total = seen.pop(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + seen.get(p, 0))) + 1 for p in range(SIZE)], np.float32)
    # one row per language; as a table its size is known before the join, so texts stay in place
    share = cut_lineage(rows.groupBy("lang").agg((F.lit(float(sample_rows)) / F.count("*")).alias("share")))
    spread = (F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / F.lit(float(1 << 53))).alias("spread")
    sample = rows.select("lang", "text", spread).join(share, "lang").filter("spread < share")
    fitted = (
        sample.select("lang", "text")
        .mapInArrow(trimmed(_sampled(idf)), "lang string, vector binary")
        .groupBy("lang")
        .applyInPandas(_clustered(centroids), "lang string, centroid binary, floor double")
        .orderBy("lang", "centroid")
        .collect()
    )
    matrix = np.stack([np.frombuffer(r["centroid"], np.float32) for r in fitted]) if fitted else np.zeros((0, SIZE), np.float32)
    return Model([r["lang"] for r in fitted], matrix, margin * np.array([r["floor"] for r in fitted], np.float64), idf)


def _predict(model):
    def predict(batches):
        m = model.value
        for batch in slices(batches):
            for row, end, data, offsets in text_steps(batch, rows=_ROWS):
                letters = np.array(batch.column("letters").slice(row, end - row).to_pylist(), bool)
                if len(m.languages):
                    cosine = _vectors(trigram_counts(data, offsets), m.idf) @ m.centroids.T
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine.max(axis=1).astype(np.float64), 0, 1)
                    far = score < m.floors[best]
                else:
                    letters = letters & False
                    best, score, far = np.zeros(end - row, int), np.zeros(end - row), np.ones(end - row, bool)
                names = [m.languages[b] if known else "und" for b, known in zip(best.tolist(), letters.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(row, end - row),
                        pa.array(names, pa.string()),
                        pa.array(np.where(letters, score, 0.0)),
                        pa.array(far | ~letters),
                    ],
                    ["row", "lang_pred", "score", "rejected"],
                )

    return predict


def identify_languages(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Per input row: a struct ``row`` of all its columns, lang_pred, score (cosine, 0 to 1), rejected.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, as is
    everything under a model of no languages. Very short texts have no trigram, hence
    score 0, and go to the first language; they are rejected. Of equal cosines the
    first language wins. Rows are never moved; an empty table gives no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_col)
    rows = df.select(F.struct("*").alias("row"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(trimmed(_predict(sent)), f"row {kind}, lang_pred string, score double, rejected boolean")
