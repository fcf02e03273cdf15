"""Phrase collocations from count streams in prefix and in suffix order.

Texts become windows: the run of up to WIDEST words that starts at a word and stays in its
piece. A phrase occurs where a window begins with it, so windows with their counts are one
stream, and in prefix order the occurrences of every phrase are neighbours: one pass with
a stack of open prefixes counts all phrases of all lengths.

Only phrases of ``least`` occurrences matter, and so do their words and word pairs. A first
pass counts 64-bit hashes of words and pairs; those that reach ``least`` set bits of
a filter of fixed size, and a window ends before a pair that is not in it. A hash that
stands for several pairs, or a bit for several hashes, only keeps a window longer than needed,
so counts stay exact at any size.

The phrases are then kept in two orders. In prefix order a phrase comes after its first
words: the pass knows the count of every first part, and of the most frequent extension to the
right. In suffix order (words reversed) it knows the same of last parts and
extensions to the left. Both streams come sorted by phrase into a merge join, and cuts are
scored there with decimals.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import text_steps, trimmed
from gleanery.llm.words import Words, byte_class, combine, mix
from gleanery.operators.ordering import top_n_per_group
from gleanery.session import cut_lineage

WIDEST = 5
#: Characters between words, and those that also end a piece.
BLANKS = [(0x09, 0x09), (0x20, 0x20)]
BREAKS = [(0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D)]
#: Bits of the filter, as a power of two: 8 MB at every size of the corpus.
FILTER_BITS = 26
#: Hashes that a task gathers before it counts them.
GATHER = 1 << 21
#: Rows that a pass over a sorted stream gives at once.
OUT_ROWS = 10_000


class Pieces:
    """Words of one step with their language; ``joined[i]``: word i + 1 follows word i in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.words = Words(data, offsets, byte_class(BLANKS + BREAKS))
        ends = np.cumsum(~byte_class(BREAKS)[data])
        w = self.words
        self.lang = langs[w.row]
        self.joined = np.zeros(len(w.hash), bool)
        if len(w.hash) > 1:
            self.joined[:-1] = (w.row[1:] == w.row[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1] - 1])
        named = mix(w.hash + mix((self.lang + 1).astype(np.uint64)))
        self.word_hash = named
        self.pair_hash = np.zeros(len(named), np.uint64)
        if len(named) > 1:
            self.pair_hash[:-1] = combine([named[:-1], named[1:]])

    def texts(self, data: np.ndarray) -> pa.Array:
        """The words as strings, A-Z lower-cased."""
        w = self.words
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        member = byte_class(BLANKS + BREAKS)[data]
        sizes = np.concatenate([[0], np.cumsum(w.end - w.start)])
        return pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(lower[data[member]]))


def _steps(batch: pa.RecordBatch):
    """Steps of a batch with the languages of its rows as numbers that are the same in every task."""
    names = batch.column("lang").dictionary_encode()
    place, numbers = names.indices.to_numpy(), _numbers(names.dictionary.to_pylist())
    for row, end, data, offsets in text_steps(batch, "text"):
        yield data, Pieces(data, offsets, numbers[place[row:end]]), place[row:end], names.dictionary


def _numbers(names: list[str]) -> np.ndarray:
    """A 63-bit number of each name, from the hash of its bytes."""
    out = []
    for name in names:
        value = 1469598103934665603
        for byte in name.encode():
            value = (value ^ byte) * 1099511628211 % (1 << 64)
        out.append(value >> 1)
    return np.array(out, np.int64)


def _hashes(batches):
    """Hashes of words and of pairs with their counts, combined within the task; kind 0 holds the words of a language."""
    held, size, totals = [], 0, {}

    def counted(kind: int, hashes: np.ndarray, n: np.ndarray, langs):
        columns = [pa.array(np.full(len(hashes), kind, np.int8)), pa.array(langs, pa.string()), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["kind", "lang", "hash", "n"])

    def flush():
        found, n = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(found), 1 << 18):
            part = slice(at, at + (1 << 18))
            yield counted(1, found[part], n[part], [None] * len(found[part]))

    for batch in batches:
        for _, pieces, place, names in _steps(batch):
            n = pieces.words.counts(len(place))
            for code in np.unique(place):
                name = names[int(code)].as_py()
                totals[name] = totals.get(name, 0) + int(n[place == code].sum())
            held.append(pieces.word_hash)
            held.append(pieces.pair_hash[pieces.joined])
            size += len(held[-1]) + len(held[-2])
            if size >= GATHER:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()
    yield counted(0, np.zeros(len(totals), np.uint64), np.array(list(totals.values()), np.int64), list(totals))


def _filter(frequent: DataFrame) -> np.ndarray:
    """The bits of all hashes in a table, as bytes; of fixed size, whatever the table holds."""
    bits = frequent.select(F.expr(f"(hash & {(1 << FILTER_BITS) - 1}) + 1").alias("bit"))  # numbered from 1, as Spark's maps are
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for b, m in maps.collect():  # at most 2,048 maps of 4 KB
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
    return out


def _windows(widest: int, sent):
    """(lang, w1 .. w_widest, n): the windows of a step, cut where the filter says a phrase ends, counted."""

    def windows(batches):
        bits = np.frombuffer(sent.value, np.uint8)

        def passes(hashes: np.ndarray) -> np.ndarray:
            at = hashes & np.uint64((1 << FILTER_BITS) - 1)
            return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for data, pieces, place, names in _steps(batch):
                if not len(pieces.word_hash):
                    continue
                good = passes(pieces.word_hash)
                linked = pieces.joined & good & np.append(good[1:], False) & passes(pieces.pair_hash)
                codes = pieces.texts(data).dictionary_encode()
                word, most = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(codes.dictionary) + 1
                lang = place[pieces.words.row]
                starts = np.flatnonzero(good)
                # the key of a window is grown word by word; keys are numbered anew at each step, so they stay small
                key, live = lang[starts].astype(np.int64) * most + word[starts] + 1, np.ones(len(starts), bool)
                kinds, first, key = np.unique(key, return_index=True, return_inverse=True)
                length = np.ones(len(starts), np.int64)
                for j in range(1, widest):
                    at = starts + j
                    live &= at < len(word)
                    live[live] = linked[at[live] - 1]
                    if not live.any():
                        break
                    length += live
                    grown = key * most
                    grown[live] += word[at[live]] + 1
                    kinds, first, key = np.unique(grown, return_index=True, return_inverse=True)
                counts = np.bincount(key, minlength=len(kinds))
                begin, size = starts[first], length[first]
                columns = [names.take(pa.array(lang[begin]))]
                for j in range(widest):
                    there = size > j
                    at = np.where(there, begin + j, 0)
                    columns.append(codes.dictionary.take(pa.array(word[at], mask=~there)).cast(pa.string()))
                columns.append(pa.array(counts.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if i == 0 else c for i, c in enumerate(columns)], ["lang", *(f"w{j}" for j in range(widest)), "n"])

    return windows


def _shared(a: list, b: list) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def _prefix_counts(least: int):
    """Counts of all prefixes of a stream sorted by (lang, words): sums over runs.

    A run that touches an end of the task's part of the stream may go on in another part
    and is given whatever its count; of others only those of ``least``.
    """

    def count(batches):
        stack, sums, edge, out = [], [], [], []  # the language is the first entry of the stack

        def close(depth: int):
            while len(stack) > depth:
                total = sums.pop()
                if len(stack) > 1 and (total >= least or edge[-1]):
                    out.append((stack[0], stack[1:], total))
                stack.pop()
                edge.pop()
                if sums:
                    sums[-1] += total

        def batch():
            columns = zip(*out) if out else ((), (), ())
            kinds = (pa.string(), pa.list_(pa.string()), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "words", "n"])
            out.clear()
            return made

        begun = False
        for rows in batches:
            for lang, words, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "words", "n"))):
                entry = [lang, *words]
                close(_shared(stack, entry))
                for word in entry[len(stack) :]:
                    stack.append(word)
                    sums.append(0)
                    edge.append(not begun)
                begun = True
                sums[-1] += n
                if len(out) >= OUT_ROWS:
                    yield batch()
        edge[:] = [True] * len(edge)
        close(0)
        yield batch()

    return count


def _part_counts(batches):
    """For every phrase of a stream sorted by (lang, words): the counts of its proper prefixes and of its most frequent extension."""
    stack, counts, widest, out = [], [], [], []

    def close(depth: int):
        while len(stack) > depth:
            stack.pop()
            n, extension = counts.pop(), widest.pop()
            if stack:
                out.append((stack[0], [*stack[1:], last[len(stack)]], n, counts[1:], extension))
                widest[-1] = max(widest[-1], n)

    def batch():
        columns = zip(*out) if out else ((), (), (), (), ())
        kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "words", "n", "parts", "extension"])
        out.clear()
        return made

    last = []
    for rows in batches:
        for lang, words, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "words", "n"))):
            entry = [lang, *words]
            close(_shared(stack, entry))
            if not stack:
                stack, counts, widest = [lang], [0], [0]
            # every prefix of a phrase is as frequent as the phrase, so it is in the stream, just before
            stack.append(words[-1])
            counts.append(n)
            widest.append(0)
            last = entry
            if len(out) >= OUT_ROWS:
                yield batch()
    close(0)
    yield batch()


def _sorted_pass(phrases: DataFrame, words: Column, task, out: str) -> DataFrame:
    """A pass over phrases sorted by language and words; all that share their first word meet in one sorted stream."""
    stream = phrases.select("lang", words.alias("words"), "n")
    parts = stream.repartitionByRange(F.col("lang"), F.col("words")[0]).sortWithinPartitions("lang", "words")
    return parts.mapInArrow(trimmed(task), out)


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, widest: int = WIDEST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, n) of all phrases of up to ``widest`` words with ``least`` occurrences, (lang, total) of all words)."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = texts.mapInArrow(trimmed(_hashes), "kind byte, lang string, hash bigint, n bigint")
    seen = cut_lineage(seen.groupBy("kind", "lang", "hash").agg(F.sum("n").alias("n")).where((F.col("kind") == 0) | (F.col("n") >= least)))
    sent = spark.sparkContext.broadcast(_filter(seen.where("kind = 1")).tobytes())
    names = [f"w{j}" for j in range(widest)]
    found = texts.mapInArrow(trimmed(_windows(widest, sent)), f"lang string, {', '.join(f'{n} string' for n in names)}, n bigint")
    stream = cut_lineage(found.groupBy("lang", *names).agg(F.sum("n").alias("n")))
    stream = stream.select("lang", F.array_compact(F.array(*names)).alias("words"), "n")
    stream = stream.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    runs = stream.mapInArrow(trimmed(_prefix_counts(least)), "lang string, words array<string>, n bigint")
    phrases = cut_lineage(runs.groupBy("lang", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    return phrases, seen.where("kind = 0").select("lang", F.col("n").alias("total"))


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, widest: int = WIDEST, percent: int = 100, top: int = 2_000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of every language by score, then a, then phrase.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into
    words at spaces and tabs. Candidates are phrases of 2 to ``widest`` words within pieces with
    a >= ``least`` occurrences, overlaps included. A cut after k words has the counts l and r of its
    two parts and the score floor(1000 * a * n / (l * r)), with n all words of the language; the cut
    with the least score counts, of equal ones the smallest k. A candidate inside a longer
    one that has at least ``percent`` of its occurrences is left out. Null languages are
    ``und``, null and empty texts have no words, repeated rows count as often as they are there,
    other columns are ignored, and an empty table gives no rows. Numbers are exact: products have
    38 digits.
    """
    phrases, totals = phrase_counts(df, text_col, lang_col, least, widest)
    out = "lang string, words array<string>, n bigint, parts array<bigint>, extension bigint"
    left = _sorted_pass(phrases, F.col("words"), _part_counts, out)
    right = _sorted_pass(phrases, F.reverse("words"), _part_counts, out)
    right = right.select("lang", F.reverse("words").alias("words"), F.reverse("parts").alias("lasts"), F.col("extension").alias("before"))
    # lasts[k] follows a cut after k + 1 words, as parts[k] precedes it
    both = left.where(F.size("words") > 1).hint("merge").join(right, ["lang", "words"])
    longer = F.greatest("extension", "before")
    both = both.where(100 * longer < percent * F.col("n")).join(F.broadcast(totals), "lang")  # one row per language
    cuts = F.transform(
        F.arrays_zip("parts", "lasts"),
        lambda c, k: F.struct(c["parts"].alias("l"), c["lasts"].alias("r"), k.alias("k")),
    )
    cut = both.select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), F.col("total").alias("n"), F.explode(cuts).alias("c"))
    cut = cut.selectExpr("lang", "phrase", "a", "c.l", "c.r", "n", "c.k", "CAST(1000 * CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(19,0)) AS DECIMAL(38,0)) div (CAST(c.l AS DECIMAL(19,0)) * CAST(c.r AS DECIMAL(19,0))) AS score")
    least_cut = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
    scored = least_cut.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    best = top_n_per_group(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
