"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of consecutive words, and a window into word shingles.
Containment is asked for in full, so one shingle of each window is a sufficient
prefix: the one that is rarest in the corpus. A window any of whose shingles occurs
nowhere in the corpus cannot occur itself. Documents meet the prefix shingles in an
equi-join on their hashes; the place of the shingle in the window bounds where the
window may begin, the row's words bound where it may end, and what is left is
compared word for word.

Benchmark windows come in blocks of bounded size, each broadcast and met by one pass
over the documents, so memory holds for any benchmark; documents never move.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import slices, text_steps, trimmed, two_columns
from gleanery.llm.words import ALPHANUMERIC, Words, byte_class, combine
from gleanery.session import cut_lineage

WINDOW = 13
SHINGLE = 3
#: Windows broadcast at once: about 60 MB of them at most.
BLOCK_WINDOWS = 200_000


def _words_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    words = Words(data, np.array([0, len(data)]), byte_class(ALPHANUMERIC))
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(words.start.tolist(), words.end.tolist())]


def _windows(window: int):
    def cut(batches):
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = _words_of(text)
                size = min(window, len(words))
                found = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else ()
                texts.extend(found)
                items.extend([item] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(items, batch.column("id").type), pa.array(texts, pa.binary())], ["id", "window"])

    return cut


class _Block:
    """Windows of one block: word hashes, shingle hashes, and later the chosen prefixes."""

    def __init__(self, windows: list[bytes], items: list[list], shingle: int):
        self.windows, self.items = windows, items
        self.length = np.array([w.count(b" ") + 1 for w in windows], np.int64)
        data = np.frombuffer(b"\n".join(windows) + b"\n", np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(w) + 1 for w in windows])])
        words = Words(data, offsets, byte_class(ALPHANUMERIC))
        first = np.concatenate([[0], np.cumsum(self.length)])
        self.size = np.minimum(self.length, shingle)
        owner, offset, hashes = [], [], []
        for k in np.unique(self.size).tolist():
            at, h = words.shingles(k)
            mine = self.size[words.row[at]] == k
            at, h = at[mine], h[mine]
            owner.append(words.row[at])
            offset.append(at - first[words.row[at]])
            hashes.append(h)
        self.owner, self.offset, self.hash = (np.concatenate(x) for x in (owner, offset, hashes))
        self.sizes = np.unique(self.size).tolist()

    def choose(self, counts: dict[int, int]) -> None:
        """Keeps, per window that can occur, its rarest shingle; the smallest hash among equals."""
        seen = np.array([counts.get(h, 0) for h in self.hash.tolist()], np.int64)
        order = np.lexsort((self.offset, self.hash, seen, self.owner))
        owner = self.owner[order]
        lead = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        chosen = order[lead]
        chosen = chosen[seen[chosen] > 0]
        chosen = chosen[np.argsort(self.hash[chosen], kind="stable")]
        self.owner, self.offset, self.hash = self.owner[chosen], self.offset[chosen], self.hash[chosen]


def _count(block):
    def count(batches):
        member, keys = byte_class(ALPHANUMERIC), np.unique(block.value.hash)
        totals = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_steps(batch):
                words = Words(data, offsets, member)
                for k in block.value.sizes:
                    h = words.shingles(k)[1]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    totals += np.bincount(at[keys[at] == h], minlength=len(keys))
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(totals[some])], ["shingle", "n"])

    return count


def _occurrences(block, words: Words, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence in a step."""
    b = block
    starts, windows = [], []
    for k in b.sizes:
        at, h = words.shingles(k)
        low, high = np.searchsorted(b.hash, h, "left"), np.searchsorted(b.hash, h, "right")
        some = np.flatnonzero(high > low)
        n = (high - low)[some]
        entry = np.repeat(low[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        start = np.repeat(at[some], n) - b.offset[entry]
        window, anchor = b.owner[entry], np.repeat(at[some], n)
        last = start + b.length[window] - 1
        fits = (start >= 0) & (last < len(words.row)) & (b.size[window] == k)  # positions and lengths
        start, window, anchor, last = start[fits], window[fits], anchor[fits], last[fits]
        fits = (words.row[start] == words.row[anchor]) & (words.row[last] == words.row[anchor])
        starts.append(start[fits])
        windows.append(window[fits])
    start, window = np.concatenate(starts), np.concatenate(windows)
    exact = np.zeros(len(start), bool)
    s, e = words.start, words.end
    for i, (at, w) in enumerate(zip(start.tolist(), window.tolist())):
        text = b.windows[w]
        mine = range(at, at + int(b.length[w]))
        # same words, whatever stands between them
        exact[i] = b" ".join([raw[s[j] : e[j]] for j in mine]) == text
    return start[exact], window[exact]


def _hits(block):
    def hits(batches):
        member = byte_class(ALPHANUMERIC)
        for batch in slices(batches):
            columns = [[], [], []]
            for row, end, data, offsets in text_steps(batch):
                words = Words(data, offsets, member)
                start, window = _occurrences(block.value, words, data.tobytes().lower())
                change = np.zeros(len(words.row) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + block.value.length[window], -1)
                covered = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                counts = words.counts(end - row)
                first = np.concatenate([[0], np.cumsum(counts)])
                places: dict[int, list] = {}
                for r, p in zip(words.row[covered].tolist(), covered.tolist()):
                    places.setdefault(r, []).append(p - int(first[r]))
                items: dict[int, set] = {}
                for r, w in zip(words.row[start].tolist(), window.tolist()):
                    items.setdefault(r, set()).update(block.value.items[w])
                for r in range(end - row):
                    columns[0].append(int(counts[r]))
                    columns[1].append(places.get(r, []))
                    columns[2].append(sorted(items.get(r, ())))
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, types))], ["row", "n_words", "places", "items"]
            )

    return hits


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    share: float = 0.05,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (array of strings), items_sha256, contaminated.

    Words are runs of ASCII letters and digits, A-Z lower-cased, and of all other
    characters beyond ASCII. A word inside an occurrence of any window is hit; a
    document is contaminated when it has a hit word and hits are at least ``share``
    of its words. Items shorter than a window are one window; items without words
    give none. Null texts have no words; repeated rows are judged row by row; an
    empty benchmark hits nothing. ``block_windows`` bounds what is broadcast at once.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    cut = (
        items.mapInArrow(trimmed(_windows(window)), "id string, window binary")
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("id")).alias("items"))
    )
    total = (cut := cut_lineage(cut)).count()
    blocks = max(1, -(-total // block_windows))
    rows = two_columns(docs, id_col, text_col)
    numbered = rows.select(F.struct("id", F.monotonically_increasing_id().alias("n")).alias("row"), "text")
    row_type = numbered.schema["row"].dataType.simpleString()
    found = []
    for b in range(blocks):
        mine = cut.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect()  # about block_windows rows
        if not mine:
            found.append(numbered.mapInArrow(trimmed(_empty), f"row {row_type}, n_words bigint, places array<bigint>, items array<string>"))
            continue
        block = _Block([bytes(r["window"]) for r in mine], [r["items"] for r in mine], shingle)
        sent = spark.sparkContext.broadcast(block)
        counts = rows.mapInArrow(trimmed(_count(sent)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
        block.choose({r["shingle"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in counts})
        chosen = spark.sparkContext.broadcast(block)
        found.append(numbered.mapInArrow(trimmed(_hits(chosen)), f"row {row_type}, n_words bigint, places array<bigint>, items array<string>"))
    if len(found) == 1:
        merged = found[0]
    else:
        merged = found[0]
        for other in found[1:]:
            merged = merged.unionByName(other)
        merged = merged.groupBy("row").agg(
            F.max("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    n_hit = F.size("places").cast("bigint")
    return merged.select(
        F.col("row.id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit >= F.lit(share) * F.col("n_words"))).alias("contaminated"),
    )


def _empty(batches):
    """No window in this block: only the words are counted."""
    member = byte_class(ALPHANUMERIC)
    for batch in batches:
        counts = np.zeros(batch.num_rows, np.int64)
        for row, end, data, offsets in text_steps(batch):
            counts[row:end] = Words(data, offsets, member).counts(end - row)
        none = pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(counts), none, none.cast(pa.list_(pa.string()))], ["row", "n_words", "places", "items"]
        )
