"""SentencePiece encoding by best lattice path, and decoding.

Encoding is relational. Every distinct word of the corpus is spread into its
substrings of at most the longest piece; an equi-join with the piece table leaves the
edges of its lattice; edges are grouped by word and folded into the path of the highest
total score. A word ends where no piece can go across: before a word mark, and between
two characters, one of them no letter, that no piece has side by side. So the best paths
of words are the best path of the text.

Words are made distinct per block of texts before they move, and only words, the sizes
of their pieces and one compressed copy of the texts do. The most frequent words of a
bounded sample, as many as FREQUENT, are encoded first in the same way and sent to every
task; they need not move for each block. A block then gets its other words' pieces,
turns its texts into ids, and decodes them again to see that nothing is lost.
"""

import json
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import partitions, slices, trimmed, two_columns
from gleanery.session import cut_lineage, drop_shuffles, scratch_path

MARK = "▁"
_LETTERS = "A-Za-z\x80-▀▂-\U0010ffff"
_AT_MARKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes of text whose words are made distinct together, and that move together.
BLOCK_BYTES = 1 << 22
#: Ids and rows that go back to Spark together.
OUT_BYTES, OUT_ROWS = 1 << 22, 1_000
#: Rows of a block, for texts that are short.
BLOCK_ROWS = 1 << 16
#: Long words are spread in windows of so many places.
PLACES = 256
#: Words up to this length are their own keys and are folded side by side.
KEY_CHARS = 64
UNKNOWN_PENALTY = 10.0
#: Sizes travel as one digit each.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
OTHER_ROWS = "the table to encode had other rows when it was read again"
#: Words sent to every task, found in a sample of about so many bytes of text. They save moves and change no result.
FREQUENT, SAMPLE_BYTES = 200_000, 1 << 26
#: A word's edges take some forty times its bytes while they are grouped, so words go to so many times the usual partitions.
SPLITS = 4


@dataclass
class Pieces:
    """A piece table: surfaces, ids and scores of ordinary pieces, the first byte piece, and how words end."""

    table: list[tuple[str, int, float]]
    surfaces: list[bytes]
    byte_base: int
    longest: int
    unknown_score: float
    pattern: str


def load_pieces(model_file: str) -> Pieces:
    """Reads a model with byte pieces and without normalization rules, such as the public ones."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as file:
        model.ParseFromString(file.read())
    ordinary = [(p.piece, i, float(p.score)) for i, p in enumerate(model.pieces) if p.type == p.NORMAL]
    raw = [(p.piece, i) for i, p in enumerate(model.pieces) if p.type == p.BYTE]
    if len(raw) != 256 or [i for _, i in raw] != list(range(raw[0][1], raw[0][1] + 256)):
        raise ValueError("the model must have its 256 byte pieces in a row")
    if model.normalizer_spec.precompiled_charsmap or not model.normalizer_spec.add_dummy_prefix:
        raise ValueError("the model must have no normalization rules and a word mark at the start")
    if any(len(piece) >= len(DIGITS) for piece, _, _ in ordinary):
        raise ValueError("a piece is too long")
    if any(MARK in piece.lstrip(MARK) for piece, _, _ in ordinary):
        raise ValueError("a piece has a word mark after its beginning")
    surfaces = [b""] * len(model.pieces)
    for piece, i, _ in ordinary:
        surfaces[i] = piece.replace(MARK, " ").encode()
    for byte, (_, i) in enumerate(raw):
        surfaces[i] = bytes([byte])
    return Pieces(
        ordinary, surfaces, raw[0][1], max(len(p) for p, _, _ in ordinary), min(s for _, _, s in ordinary) - UNKNOWN_PENALTY,
        _word_pattern([p for p, _, _ in ordinary]),
    )


def _word_pattern(pieces: list[str]) -> str:
    """Words: letters stay together, and so do any two characters that some piece has side by side."""
    letter, before, after = re.compile(f"[{_LETTERS}]"), {}, {}
    for a, b in {pair for p in pieces for pair in zip(p.lstrip(MARK), p.lstrip(MARK)[1:])}:
        if not letter.match(b):
            before.setdefault(b, set()).add(a)
        elif not letter.match(a):
            after.setdefault(a, set()).add(b)
    chars = lambda found: f"[{''.join(map(re.escape, sorted(found)))}]"
    joined = [f"{re.escape(b)}(?<={chars(found)}{re.escape(b)})" for b, found in sorted(before.items())]
    joined += [f"(?<={re.escape(a)})(?={chars(found)})[{_LETTERS}]+" for a, found in sorted(after.items())]
    more = f"(?:{'|'.join(joined)})*" if joined else ""
    return f"{MARK}*(?:[{_LETTERS}]+|[^{_LETTERS}{MARK}]){more}|{MARK}+"


def marked(text: str) -> list[str]:
    """The text after a word mark is put before it and in place of every space, cut before word marks."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
        return _AT_MARKS.findall(MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", " " + MARK)).split(" ")


def words_of(part: str, pattern: re.Pattern) -> list[str]:
    """The words of a part that begins with a mark."""
    return [part] if part[1:].isalpha() else pattern.findall(part)


def _blocks(batches, block_bytes: int):
    """The blocks of a task: number, ids and texts of consecutive rows."""
    block, size, names, texts = TaskContext.get().partitionId() << 32, 0, [], []
    for batch in slices(batches):
        for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            names.append(name)
            texts.append(text)
            size += len(text.encode())
            if size >= block_bytes or len(names) >= BLOCK_ROWS:
                yield block, names, texts
                block, size, names, texts = block + 1, 0, [], []
    if names:
        yield block, names, texts


def _other_words(texts: list[str], pattern: re.Pattern, frequent) -> list[str]:
    """The distinct words of a block that are not sent to every task, as they are first met."""
    parts: dict[str, None] = {}
    for text in texts:
        parts.update(dict.fromkeys(marked(text)))
    return [word for word in dict.fromkeys(word for part in parts for word in words_of(part, pattern)) if word not in frequent]


def _word_counts(pattern: str):
    def count(batches):
        compiled, parts, counts = re.compile(pattern), Counter(), Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                parts.update(marked(text))
        for part, n in parts.items():
            for word in words_of(part, compiled):
                if len(word) <= KEY_CHARS:
                    counts[word] += n
        found = list(counts.items())
        for i in range(0, len(found), 50_000):
            part = found[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    return count


def _block_words(pattern: str, frequent, block_bytes: int):
    def distinct(batches):
        compiled = re.compile(pattern)
        for block, _, texts in _blocks(batches, block_bytes):
            found = _other_words(texts, compiled, frequent.value)
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(part), pa.int64()), pa.array(range(i, i + len(part)), pa.int32()), pa.array(part, pa.string())], ["block", "n", "word"]
                )

    return distinct


def _payloads(id_type: pa.DataType, block_bytes: int):
    def pack(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=9)
        for block, names, texts in _blocks(batches, block_bytes):
            payload = packer.compress(json.dumps(texts, ensure_ascii=False).encode())
            columns = [pa.array([block], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([payload], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "names", "payload"])

    return pack


def _gathered(rows: pa.Table) -> pa.Table:
    """The sizes of a block's words, in the order of the words, as one compressed value."""
    import zstandard

    order = np.argsort(rows.column("n").to_numpy())
    found = zstandard.ZstdCompressor().compress(",".join(rows.column("sizes").take(pa.array(order)).to_pylist()).encode())
    return pa.table([rows.column("block").slice(0, 1), pa.array([found], pa.binary())], ["block", "found"])


def lattice_edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, first, last, score) for every piece in a word (key, word), and for every character without one."""
    spark = words.sparkSession
    # bounded by the model file
    table = spark.createDataFrame([(p, s) for p, _, s in pieces.table], "piece string, score double")
    places = words.select("key", "word", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("word") - 1) / PLACES).cast("int"))).alias("g"))
    places = places.select(
        "key", (F.col("g") * PLACES).alias("base"),
        F.substring("word", F.col("g") * PLACES + 1, F.lit(PLACES + pieces.longest - 1)).alias("part"),
    )
    starts = places.select("key", "base", "part", F.explode(F.sequence(F.lit(1), F.least(F.char_length("part"), F.lit(PLACES)))).alias("at"))
    spans = starts.select(
        "key", "base", "part", "at",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.char_length("part") - F.col("at") + 1))).alias("size"),
    )
    substrings = spans.select(
        "key", (F.col("base") + F.col("at") - 1).alias("first"), (F.col("base") + F.col("at") - 1 + F.col("size")).alias("last"),
        F.substring("part", F.col("at"), F.col("size")).alias("piece"), "size",
    )
    edges = substrings.join(F.broadcast(table), "piece", "left").filter("score IS NOT NULL OR size = 1")
    return edges.select("key", "first", "last", F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"))


def best_paths(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, sizes): the pieces' lengths on the path of the highest score, a digit each; of equal ones, the path whose last piece is longest.

    The fold takes edges by their ends, those of many words side by side. Its state has for every
    place the best score of a path to it and where the last piece of that path begins.
    """
    # the hash comes first: it settles almost every comparison of keys
    grouped = edges.groupBy(F.xxhash64("key").alias("h"), "key").agg(F.collect_list(F.struct("last", "first", "score")).alias("edges"))

    def fold(batches):
        for batch in slices(batches, 10_000):
            lists = batch.column("edges")
            counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            last, first, score = (flat.field(i).to_numpy() for i in range(3))
            word = np.repeat(np.arange(len(counts)), counts)
            places = np.maximum.reduceat(last, lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())
            sizes = np.empty(len(counts), object)
            few = places <= KEY_CHARS
            at = few[word]
            sizes[few] = _folded((np.cumsum(few) - 1)[word[at]], last[at], first[at], score[at], places[few])
            begins = np.concatenate([[0], np.cumsum(counts)])
            for i in np.flatnonzero(~few):
                mine = slice(begins[i], begins[i + 1])
                sizes[i] = _folded_alone(last[mine], first[mine], score[mine], int(places[i]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.string())], ["key", "sizes"])

    return grouped.select("key", "edges").mapInArrow(trimmed(fold), "key string, sizes string")


def _folded(word, last, first, score, places) -> list[str]:
    """Sizes of the best paths of words of so many places; edges have the number of their word."""
    n, most = len(places), int(places.max(initial=0))
    order = np.lexsort((first, word, last))
    word, last, first, score = word[order], last[order], first[order], score[order]
    best, back = np.zeros((n, most + 1)), np.zeros((n, most + 1), np.int64)
    ends = np.searchsorted(last, np.arange(1, most + 2))
    for end in range(1, most + 1):
        here = slice(ends[end - 1], ends[end])
        of, begin = word[here], first[here]
        total = best[of, begin] + score[here]
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        highest = np.repeat(np.maximum.reduceat(total, new), np.diff(np.append(new, len(of))))
        at = np.flatnonzero(total == highest)
        at = at[np.concatenate([[True], of[at][1:] != of[at][:-1]])]  # of equal paths the one that begins first: its last piece is the longest
        best[of[at], end], back[of[at], end] = total[at], begin[at]
    digits, met, at, rows = np.zeros((n, most), np.uint8), np.zeros((n, most), bool), places.astype(np.int64), np.arange(n)
    while (on := np.flatnonzero(at)).size:
        begin = back[rows[on], at[on]]
        digits[on, at[on] - 1], met[on, at[on] - 1] = _DIGIT_BYTES[at[on] - begin], True
        at[on] = begin
    text, cut = digits[met].tobytes().decode(), np.concatenate([[0], np.cumsum(met.sum(1))]).tolist()
    return [text[a:b] for a, b in zip(cut, cut[1:])]


def _folded_alone(last, first, score, places: int) -> str:
    """The same for one word of any length."""
    order = np.lexsort((first, last))
    best, back = [0.0] + [float("-inf")] * places, [0] * (places + 1)
    for end, begin, added in zip(last[order].tolist(), first[order].tolist(), score[order].tolist()):
        total = best[begin] + added
        if total > best[end]:
            best[end], back[end] = total, begin
    out, at = [], places
    while at:
        out.append(DIGITS[at - back[at]])
        at = back[at]
    return "".join(reversed(out))


#: The size that a digit stands for.
_SIZE = {digit: size for size, digit in enumerate(DIGITS)}
_DIGIT_BYTES = np.frombuffer(DIGITS.encode(), np.uint8)


def coded_table(pieces: Pieces) -> dict[str, bytes]:
    """Every piece's id as a 32-bit little-endian integer."""
    return {p: i.to_bytes(4, "little") for p, i, _ in pieces.table}


def word_ids(word: str, sizes: str, table: dict[str, bytes], byte_base: int) -> bytes:
    """Ids of a word, as 32-bit little-endian integers, from the sizes of its pieces, a digit to base 36 each."""
    out, at = [], 0
    if sum(map(_SIZE.__getitem__, sizes)) != len(word):
        raise ValueError(OTHER_ROWS)
    for digit in sizes:
        end = at + _SIZE[digit]
        piece = word[at:end]
        at = end
        if piece in table:
            out.append(table[piece])
        else:
            out.extend([(byte_base + b).to_bytes(4, "little") for b in piece.encode()])
    return b"".join(out)


def decoded(ids, surfaces: list[bytes]) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD, ids without a surface nothing."""
    return b"".join([surfaces[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


_OUT = ["id", "n_pieces", "ids", "round_trip"]


def _coded(names: list, values: list[np.ndarray], same: list[bool], id_type: pa.DataType) -> pa.RecordBatch:
    counts = np.array([len(v) for v in values], np.int64)
    flat = np.concatenate(values) if values else np.zeros(0, "<i4")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(names, id_type), pa.array(counts), lists, pa.array(same, pa.bool_())], _OUT)


def _assemble(pieces, frequent, id_type: pa.DataType):
    def assemble(batches):
        import zstandard

        compiled, opened = re.compile(pieces.value.pattern), zstandard.ZstdDecompressor()
        table, byte_base, surfaces = coded_table(pieces.value), pieces.value.byte_base, pieces.value.surfaces
        often, usual = frequent.value, {}
        for batch in slices(batches, 1):
            ((ids, payload, found),) = zip(*(batch.column(c).to_pylist() for c in ("names", "payload", "found")))
            texts = json.loads(opened.decompress(payload))
            found = iter([] if found is None else opened.decompress(found).decode().split(","))
            known: dict[str, bytes] = {}

            class Parts(dict):
                def __missing__(self, part: str) -> bytes:
                    out = []
                    for word in words_of(part, compiled):
                        coded = usual.get(word)
                        if coded is None:
                            coded = known.get(word)
                        if coded is None and word in often:
                            coded = usual[word] = word_ids(word, often[word], table, byte_base)
                        if coded is None:  # paths of other words lie in the order in which words are first met
                            coded = known[word] = word_ids(word, next(found, ""), table, byte_base)
                        out.append(coded)
                    self[part] = coded = b"".join(out)
                    return coded

            parts, names, values, same, size = Parts(), [], [], [], 0
            for name, text in zip(ids, texts):
                coded = np.frombuffer(b"".join([parts[part] for part in marked(text)]), "<i4")
                names.append(name)
                values.append(coded)
                same.append(decoded(coded.tolist(), surfaces) == text)
                size += coded.nbytes
                if size >= OUT_BYTES or len(names) >= OUT_ROWS:
                    yield _coded(names, values, same, id_type)
                    names, values, same, size = [], [], [], 0
            if names:
                yield _coded(names, values, same, id_type)
            if next(found, None) is not None:
                raise ValueError(OTHER_ROWS)

    return assemble


def encode_pieces(
    df: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", frequent_words: int = FREQUENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: id, n_pieces, ids, round_trip.

    ``block_bytes`` of text are encoded by one task at a time; larger blocks move fewer words and take more memory.
    The table is read more than once and must give the same rows in the same partitions each time, as stored ones do.

    Ids are those of the best path of the text after a word mark is put before it and in
    place of every space; characters without a piece become byte pieces. ``round_trip``
    says whether decoding gives the text again; only a text with U+2581 itself, which
    stands for a space, does not. Null and empty texts have no pieces; repeated rows are
    encoded each; an empty table gives no rows; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    rows = two_columns(df, id_col, text_col)
    kind = rows.schema["id"].dataType
    arrow, kind = to_arrow_type(kind), kind.simpleString()

    def paths(words: DataFrame) -> DataFrame:
        return best_paths(lattice_edges(words, pieces), pieces)

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = rows.sample(min(1.0, SAMPLE_BYTES / max(size, 1)), 11).select("text")
    counted = sample.mapInArrow(trimmed(_word_counts(pieces.pattern)), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    most = cut_lineage(counted.orderBy(F.desc("n"), "word").limit(frequent_words).select(F.col("word").alias("key"), "word"))
    frequent = spark.sparkContext.broadcast({r["key"]: r["sizes"] for r in paths(most.repartition(partitions(spark), "key")).collect()})

    def known() -> DataFrame:
        path, written = scratch_path(spark, "words"), "block bigint, n int, word string"
        rows.mapInArrow(trimmed(_block_words(pieces.pattern, frequent, block_bytes)), written).write.option("compression", "zstd").parquet(path)
        met = spark.read.schema(written).parquet(path)
        # a long word goes under its digest, which is what rows are copied with
        is_long = F.char_length("word") > KEY_CHARS
        key = F.when(is_long, F.concat(F.lit("\0"), F.sha2("word", 256))).otherwise(F.col("word"))
        met = met.select("block", "n", key.alias("key"), F.when(is_long, F.col("word")).alias("long"))
        met = met.repartition(SPLITS * partitions(spark), "key")
        # counting keeps all columns, so that this and the join below read one and the same exchange
        words = met.groupBy("key", "long").agg(F.count("block").alias("blocks"), F.count("n").alias("times")).filter("blocks > 0 AND times > 0")
        found = met.join(paths(words.select("key", F.coalesce("long", "key").alias("word"))), "key").select("block", "n", "sizes")
        return cut_lineage(found.groupBy("block").applyInArrow(_gathered, "block bigint, found binary"))

    found = known()
    drop_shuffles(spark)  # words are through before texts move
    packed = rows.mapInArrow(trimmed(_payloads(arrow, block_bytes)), f"block bigint, names array<{kind}>, payload binary")
    whole = cut_lineage(packed.join(found, "block", "left").drop("block"))
    sent = spark.sparkContext.broadcast(pieces)
    coded = whole.mapInArrow(trimmed(_assemble(sent, frequent, arrow)), f"id {kind}, n_pieces bigint, ids array<int>, round_trip boolean")
    return coded.withColumnRenamed("id", id_col)


def decode_pieces(df: DataFrame, pieces: Pieces, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Every row with the text of its ids; null ids give a null text, an id outside the table an error."""
    sent = df.sparkSession.sparkContext.broadcast(pieces)

    def decode(batches):
        for batch in slices(batches):
            texts = [None if ids is None else decoded(ids, sent.value.surfaces) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    rows = df.select(F.struct("*").alias("row"), F.col(ids_col).alias("ids"))
    out = rows.mapInArrow(trimmed(decode), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select(*(F.col("row")[c].alias(c) for c in df.columns if c != out_col), F.col("text").alias(out_col))
