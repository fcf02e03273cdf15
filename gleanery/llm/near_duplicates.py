"""Near duplicates by one-permutation MinHash with optimal densification.

One hash of every shingle fills BINS bins with their minima; an empty bin takes the
value of the first full bin in a probing order of its own, the same for every
document. Bands of ROWS bins are bucket keys. Documents with the same set of
shingles are one class, represented by its smallest id; only representatives are
bucketed, and of buckets with the same members one is kept. In a bucket, candidates
form a star around the smallest id, so a bucket of m rows gives m - 1 pairs; most
buckets of a group have the same centre and give the same pairs. Pairs are confirmed
on the full sets.

A star can miss a link between two rows that are both too far from the centre. So,
while confirmed links leave a bucket in more than one component, its rows of
different components are paired again: all pairs in buckets of up to SMALL rows, once,
and new centres in larger ones, as long as one pair in PAYS is a link. Buckets choose
centres by one order of ids, so those with most members in common have the same. What
then is still in mixed larger buckets is joined on prefixes: with the shingles of every
set in one order, rarest first, two sets of enough similarity share a shingle among the
first few of each. The pairs of different components that this leaves are all
confirmed, so no link between two rows of a bucket is missed.

Before the texts of a pair are moved, its outlines are compared: PLACES bits for each
row, every shingle turning one of them over. Bits that differ are no more than the
shingles that only one of two sets has, so a pair with too many of them is no link.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import slices, text_steps, trimmed
from gleanery.llm.components import components
from gleanery.llm.words import SPACED, Words, byte_class, combine, mix
from gleanery.session import cut_lineage

WIDTH = 5
BINS, ROWS = 128, 4
SMALL = 8
CENTRES = 4
#: New centres are tried as long as one pair in so many is a link; a family that hardly links goes to the prefix join.
PAYS = 8
#: Counters that order shingles by how common they are; collisions cost pairs to confirm, never links.
COUNTERS = 1 << 18
#: Bits of an outline; fewer let more pairs through to the full sets and lose no link.
PLACES = 1 << 10
#: Words of 64 bits in a filter that every task gets, most; a fuller filter lets more rows move and changes no result.
FILTER_WORDS = 1 << 18


def shingle_sets(batch: pa.RecordBatch, column: str, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; a row of fewer words is one shingle; no words, no shingle."""
    out = []
    for row, end, data, offsets in text_steps(batch, column):
        words = Words(data, offsets, byte_class(SPACED))
        at, hashes = words.shingles(width)
        bounds = np.searchsorted(words.row[at], np.arange(end - row + 1))
        counts = words.counts(end - row)
        first = np.concatenate([[0], np.cumsum(counts)])
        for r in range(end - row):
            n = int(counts[r])
            if n >= width:
                out.append(np.unique(hashes[bounds[r] : bounds[r + 1]]))
            elif n:
                out.append(combine([words.hash[first[r] + j : first[r] + j + 1] for j in range(n)]))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def probing_ranks(bins: int) -> np.ndarray:
    """For every bin, the place of all bins in its probing order."""
    keys = mix(np.arange(1, bins * bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bins, bins)
    return np.argsort(np.argsort(keys, axis=1), axis=1).astype(np.int32)


def densified(found: np.ndarray, bins: int, ranks: np.ndarray) -> np.ndarray:
    """The signature of a non-empty sorted set."""
    place = (found >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    lead = np.concatenate([[True], place[1:] != place[:-1]])
    full, values = place[lead], found[lead]
    signature = np.zeros(bins, np.uint64)
    signature[full] = values
    if len(full) < bins:
        empty = np.ones(bins, bool)
        empty[full] = False
        signature[empty] = values[ranks[empty][:, full].argmin(axis=1)]
    return signature


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    bands = signatures.shape[1] // rows
    keys = combine([signatures[:, j::rows].ravel() for j in range(rows)]).reshape(-1, bands)
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _signatures(width: int, bins: int, rows: int):
    def sign(batches):
        ranks = probing_ranks(bins)
        for batch in slices(batches):
            sets = shingle_sets(batch, "text", width)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = [None] * len(sets)
            some = [i for i, s in enumerate(sets) if len(s)]
            if some:
                bands = band_keys(np.stack([densified(sets[i], bins, ranks) for i in some]), rows).view(np.int64)
                for i, row in zip(some, bands):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "n", "print", "keys"],
            )

    return sign


def _outlines(width: int):
    def outline(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch, "text", width)
            odd = [np.bincount((s & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES) & 1 for s in sets]
            bits = [np.packbits(row.astype(bool)).view(np.int64) for row in odd]
            columns = [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "bits"])

    return outline


def _likely(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose outlines allow a link: all that are links, and some more.

    Sets of sizes whose sum is S and that differ in D shingles are linked if
    (100 + percent) * D <= (100 - percent) * S.
    """
    a, b = (outlines.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in ("a", "b"))
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, one: n + one)
    near = pairs.join(a, "a").join(b, "b").filter((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    return near.select("a", "b").distinct()


def _confirm(width: int, percent: int):
    def confirm(batches):
        for batch in slices(batches):
            names, sets = {}, []
            for side in ("a", "b"):
                ids = batch.column(side).to_pylist()
                fresh = [i for i, name in enumerate(ids) if name not in names and not names.update({name: len(names)})]
                sets.extend(shingle_sets(batch.select([f"text_{side}"]).take(pa.array(fresh, pa.int64())), f"text_{side}", width))
            linked = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = sets[names[a]], sets[names[b]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            kept = batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            yield kept

    return confirm


def _tallies(width: int):
    def tally(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches):
            for s in shingle_sets(batch, "text", width):
                np.add.at(total, (s % np.uint64(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "n"])

    return tally


def _prefixes(width: int, percent: int, tallies):
    def prefixes(batches):
        common = tallies.value
        for batch in slices(batches):
            owner, size, place, hashes = [], [], [], []
            for r, s in enumerate(shingle_sets(batch, "text", width)):
                n = len(s)
                first = n - -(-percent * n // 100) + 1 if n else 0
                ordered = s[np.lexsort((s, common[(s % np.uint64(COUNTERS)).astype(np.int64)]))][:first]
                owner.append(np.full(len(ordered), r))
                size.append(np.full(len(ordered), n))
                place.append(np.arange(len(ordered)))
                hashes.append(ordered)
            if owner:
                rows = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(rows),
                        batch.column("c").take(rows),
                        pa.array(np.concatenate(size), pa.int64()),
                        pa.array(np.concatenate(place), pa.int64()),
                        pa.array(np.concatenate(hashes).view(np.int64)),
                    ],
                    ["id", "c", "n", "at", "shingle"],
                )

    return prefixes


def _prefix_pairs(rows: DataFrame, kind: str, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components ``c`` that may be similar enough: all that are, and some more.

    A pair that is shares its first common shingle with at least percent / (100 + percent)
    of both sizes left from there on in either set; the smaller set, which has no more
    than half of the sum, is cut to a shorter prefix by the same bound.
    """
    spark = rows.sparkSession
    seen = rows.select("text").mapInArrow(trimmed(_tallies(width)), "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    tallies = np.zeros(COUNTERS, np.int64)
    tallies[seen.column("place").to_numpy()] = seen.column("n").to_numpy()
    prefix = _prefixes(width, percent, spark.sparkContext.broadcast(tallies))
    found = cut_lineage(rows.mapInArrow(trimmed(prefix), f"id {kind}, c {kind}, n bigint, at bigint, shingle bigint"))
    x, y = (found.select("shingle", *(F.col(k).alias(f"{k}_{side}") for k in ("id", "c", "n", "at"))) for side in ("x", "y"))
    x = x.filter(f"{100 + percent} * (n_x - at_x) >= {2 * percent} * n_x")
    met = x.join(y, "shingle").filter("c_x <> c_y AND (n_x < n_y OR n_x = n_y AND id_x < id_y)")
    met = met.filter(f"100 * n_x >= {percent} * n_y AND {100 + percent} * least(n_x - at_x, n_y - at_y) >= {percent} * (n_x + n_y)")
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _perhaps(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose value of ``column`` is in ``keys``, and a few others; they are found where they lie, by one bit per key."""
    hashed = F.xxhash64(column)
    word, bit = F.pmod(hashed, F.lit(FILTER_WORDS)).cast("int"), F.expr("shiftleft(1L, int(hash & 63))")
    # the places of the bits are not those of the words
    placed = keys.select(word.alias("word"), F.shiftrightunsigned(hashed, 40).alias("hash"))
    bits = placed.groupBy("word").agg(F.bit_or(bit).alias("bits"))
    met = rows.select("*", word.alias("word"), F.shiftrightunsigned(hashed, 40).alias("hash")).join(F.broadcast(bits), "word")
    return met.filter(F.col("bits").bitwiseAND(bit) != 0).select(rows.columns)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 75, bins: int = BINS, rows: int = ROWS
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a row's set holds its
    distinct shingles of ``width`` words, or all its words as one if they are fewer.
    Rows are linked when their sets' Jaccard similarity is ``percent`` or more; a
    component is the smallest id that links reach, and the row with that id is kept.
    Null and empty texts, and texts of white space, have empty sets and are linked with
    nothing. Rows with a null id are linked with nothing and kept, with a null
    component. Rows that share an id are one document whose links are those of any of
    them. ``bins`` is a power of two and a multiple of ``rows``. An empty table gives no
    rows; other columns are ignored. A link is missed only between two rows that share
    no bucket and that no other links connect: with 32 bands of 4, a pair of similarity
    0.75 shares none with probability 5e-6.
    """
    if bins & (bins - 1) or bins % rows:
        raise ValueError("bins is a power of two and a multiple of rows")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    signed = cut_lineage(docs.mapInArrow(trimmed(_signatures(width, bins, rows)), f"id {kind}, n bigint, print binary, keys array<bigint>"))
    named = signed.filter("n > 0 AND id IS NOT NULL")
    classes = cut_lineage(named.groupBy("print").agg(F.min("id").alias("rep")))
    # a class is met by the row of its representative; ids are unique, or else repeated buckets do no harm
    reps = named.select(F.col("print").alias("p"), "id", "n", "keys").join(classes, (F.col("p") == F.col("print")) & (F.col("id") == F.col("rep")))
    reps = cut_lineage(reps.select("id", "n", "keys"))
    bucketed = reps.select("id", "n", F.explode("keys").alias("key"))
    shared = cut_lineage(bucketed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    # few keys are shared, so most rows of buckets need not move again
    met = cut_lineage(_perhaps(bucketed, shared, "key").join(shared, "key"))
    # members of a bucket as two sums of 64-bit hashes; buckets of the same members would give the same pairs
    sums = [F.sum(F.xxhash64("id", "n", F.lit(seed)).cast("decimal(20,0)")).alias(f"sum{seed}") for seed in range(2)]
    kept = met.groupBy("key", "m").agg(F.min("id").alias("centre"), *sums)
    kept = kept.groupBy("m", "centre", "sum0", "sum1").agg(F.min("key").alias("key")).select("key", "centre")
    members = cut_lineage(met.join(kept, "key").select("key", "id", "n", "m", "centre").distinct())

    candidates = members.select("id").distinct()
    # no semi-join: Spark would make that before the filter
    texts = cut_lineage(_perhaps(docs, candidates, "id").join(candidates, "id"))
    outlines = cut_lineage(texts.mapInArrow(trimmed(_outlines(width)), f"id {kind}, n bigint, bits array<bigint>"))
    sizes = members.groupBy("id").agg(F.max("n").alias("n"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(_likely(pairs, outlines, percent))
        own = _perhaps(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
        a, b = (own.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b"))
        full = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
        return cut_lineage(full.mapInArrow(trimmed(_confirm(width, percent)), f"a {kind}, b {kind}").distinct())

    possible = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    with_centre = members.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"), F.col("n").alias("n_b")).distinct()
    pairs = with_centre.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").filter(possible).select("a", "b").distinct()
    tested = cut_lineage(pairs)
    links = confirmed(tested)
    labels = cut_lineage(components(links))
    turn, pays = 0, True
    while True:
        # all pairs of small buckets are tested in the first turn
        met = members if turn == 0 else members.filter(F.col("m") > SMALL)
        rest = met.select("key", "id", "n", "m").join(labels, F.col("id") == F.col("node"), "left")
        rest = rest.select("key", "id", "n", "m", F.coalesce("component", "id").alias("c"))
        mixed = rest.groupBy("key").agg(
            F.min("c").alias("low"), F.max("c").alias("high"),
            *(F.min_by(F.struct("id", "n", "c"), F.xxhash64("id", F.lit(turn * CENTRES + i))).alias(f"s{i}") for i in range(CENTRES)),
        ).filter("low <> high")
        mixed = cut_lineage(mixed)
        if mixed.isEmpty():
            break
        open_rows = cut_lineage(rest.join(mixed.select("key"), "key", "left_semi"))
        if not pays:
            large = cut_lineage(open_rows.select("id", "c").distinct())
            large = _perhaps(texts, large, "id").join(large, "id").select("id", "c", "text")
            left = _prefix_pairs(large, kind, width, percent).join(tested, ["a", "b"], "left_anti")
            labels = cut_lineage(components(links.unionByName(confirmed(cut_lineage(left)))))
            break
        # only centres of other components are exploded, each once
        centres = F.array_distinct(F.filter(F.array(*(F.struct(f"s{i}.id", f"s{i}.n", f"s{i}.c") for i in range(CENTRES))), lambda s: s["c"] != F.col("c")))
        stars = open_rows.filter(F.col("m") > SMALL).join(mixed, "key").select("id", "n", centres.alias("s")).distinct()
        stars = stars.select("id", "n", F.explode("s").alias("s")).select(
            F.least("id", "s.id").alias("a"), F.greatest("id", "s.id").alias("b"), F.col("n").alias("n_a"), F.col("s.n").alias("n_b")
        )
        small = open_rows.filter(F.col("m") <= SMALL)
        other = small.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"))
        every = small.join(other, "key").filter("id < b AND c <> c_b").select(F.col("id").alias("a"), "b", F.col("n").alias("n_a"), "n_b")
        fresh = stars.unionByName(every).filter(possible).select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        fresh = cut_lineage(fresh)
        found = confirmed(fresh)
        tested = cut_lineage(tested.unionByName(fresh))
        added = found.count()
        pays = added > 0 and PAYS * added >= fresh.count()
        if added:
            links = cut_lineage(links.unionByName(found))
            labels = cut_lineage(components(links))
        turn += 1

    grouped = signed.select("id", "n", "print").join(classes, "print", "left")
    # rows that share an id are one document: the least label of them
    whole = grouped.filter("id IS NOT NULL AND rep IS NOT NULL").select(F.col("id").alias("x"), F.col("rep"))
    own = whole.join(labels, F.col("rep") == F.col("node"), "left").select("x", F.coalesce("component", "rep").alias("c"))
    own = own.groupBy("x").agg(F.min("c").alias("c"))
    out = signed.select("id", "n").join(own, F.col("id") == F.col("x"), "left")
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
