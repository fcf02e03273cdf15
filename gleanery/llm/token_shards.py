"""Token ids as wavelet matrices, one compressed file image per shard.

Texts are range-partitioned and sorted by id, encoded, and gathered into shards of
bounded size. A shard is a wavelet matrix: one bit plane per id bit, most
significant first, each stably partitioned by the plane before. Planes are cut into
blocks, compressed one by one, with the ones before every block in a rank
directory, so access, count and occurrence lookup only open the blocks they touch.
Shards are binary rows of a table that Spark writes: a lost task leaves no half
file, and any store that Spark writes to will do.
"""

import bisect
import gc
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleanery.llm.common import slices, trimmed, two_columns, worker_state
from gleanery.session import cut_lineage, scratch_path

MAGIC = b"WVM1"
#: Bits of a plane that are compressed together.
BLOCK_BITS = 1 << 16
#: Ids after which a shard is closed; a longer document is a shard of its own.
SHARD_IDS = 1 << 21
#: Words remembered by an encoding task, twice at most.
REMEMBERED = 600_000
#: Characters of texts whose words are looked up together.
STEP_CHARACTERS = 1 << 22
END = 0


class WaveletMatrix:
    """Rank, select and access on a sequence of unsigned ids, from one byte string."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a wavelet matrix image")
        (size,) = struct.unpack_from("<I", image, 4)
        head = json.loads(image[8 : 8 + size])
        self.n, self.bits, self.zeros, at = head["n"], head["bits"], head["zeros"], 8 + size
        self.blocks = -(-self.n // BLOCK_BITS)
        count = self.bits * self.blocks
        self.ranks = np.frombuffer(image, "<u4", count, at).reshape(self.bits, self.blocks)
        ends = np.frombuffer(image, "<u4", count, at + 4 * count)
        self.ends = [at + 8 * count, *(ends + np.uint64(at + 8 * count)).tolist()]
        self.image, self._opened = image, {}

    @staticmethod
    def build(ids: np.ndarray, bits: int = 16) -> bytes:
        n = len(ids)
        zeros, ranks, packed = [], [], []
        for plane in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << plane)) != 0
            raw = np.packbits(one).tobytes()
            packed += [zlib.compress(raw[start : start + BLOCK_BITS // 8], 1) for start in range(0, len(raw), BLOCK_BITS // 8)]
            counts = [int(np.count_nonzero(one[start : start + BLOCK_BITS])) for start in range(0, n, BLOCK_BITS)]
            ranks.append(np.cumsum([0, *counts])[:-1] if n else np.zeros(0, np.int64))
            zeros.append(n - sum(counts))
            ids = np.concatenate([ids.take(np.flatnonzero(~one)), ids.take(np.flatnonzero(one))])
        head = json.dumps({"n": n, "bits": bits, "zeros": zeros}).encode()
        directory = np.concatenate(ranks).astype("<u4") if n else np.zeros(0, "<u4")
        ends = np.cumsum([len(p) for p in packed]).astype("<u4")
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, directory.tobytes(), ends.tobytes(), *packed])

    def _block(self, plane: int, block: int) -> np.ndarray:
        """Bits of one block; the blocks opened last stay at hand."""
        key = plane * self.blocks + block
        if key not in self._opened:
            if len(self._opened) > 256:
                self._opened.clear()
            raw = zlib.decompress(self.image[self.ends[key] : self.ends[key + 1]])
            self._opened[key] = np.unpackbits(np.frombuffer(raw, np.uint8))[: min(BLOCK_BITS, self.n - block * BLOCK_BITS)]
        return self._opened[key]

    def _ones(self, plane: int, at: int) -> int:
        """Ones of a plane before a position."""
        if at >= self.n:
            return self.n - self.zeros[plane]
        block, rest = divmod(at, BLOCK_BITS)
        return int(self.ranks[plane][block]) + int(self._block(plane, block)[:rest].sum())

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.bits):
            bit = int(self._block(plane, at // BLOCK_BITS)[at % BLOCK_BITS])
            ones = self._ones(plane, at)
            value, at = value << 1 | bit, self.zeros[plane] + ones if bit else at - ones
        return value

    def rank(self, value: int, end: int) -> int:
        """Occurrences of an id before a position."""
        start, end = 0, min(end, self.n)
        for plane in range(self.bits):
            low, high = self._ones(plane, start), self._ones(plane, end)
            if value >> (self.bits - 1 - plane) & 1:
                start, end = self.zeros[plane] + low, self.zeros[plane] + high
            else:
                start, end = start - low, end - high
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, nth: int) -> int:
        """Position of the nth occurrence, from 0; IndexError if there are fewer."""
        if not 0 <= nth < self.count(value):
            raise IndexError(nth)
        start = 0
        for plane in range(self.bits):
            ones = self._ones(plane, start)
            start = self.zeros[plane] + ones if value >> (self.bits - 1 - plane) & 1 else start - ones
        at = start + nth
        for plane in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - plane) & 1
            at = self._nth(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def _nth(self, plane: int, bit: int, nth: int) -> int:
        """Position of the nth one (or zero) of a plane: a search in the directory, then in one block."""
        starts = self.ranks[plane].astype(np.int64)
        if not bit:
            starts = np.arange(self.blocks) * BLOCK_BITS - starts
        block = bisect.bisect_right(starts.tolist(), nth) - 1
        inside = np.flatnonzero(self._block(plane, block) == bit)
        return block * BLOCK_BITS + int(inside[nth - int(starts[block])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, i) for i in range(self.count(value))]

    def to_array(self) -> np.ndarray:
        """All ids in order: the planes are undone from the last to the first."""
        values = np.zeros(self.n, np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            raw = [zlib.decompress(self.image[self.ends[k] : self.ends[k + 1]]) for k in range(plane * self.blocks, (plane + 1) * self.blocks)]
            one = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8))[: self.n].astype(bool)
            before = np.empty_like(values)
            before[np.flatnonzero(~one)] = values[: self.zeros[plane]]
            before[np.flatnonzero(one)] = values[self.zeros[plane] :] | np.uint32(1 << (self.bits - 1 - plane))
            values = before
        return values


MARKS = "!#$%&*+,./:;=?@-"
_MARKED = re.compile(rf"([^\W\d_]+)([{MARKS}]*)(?:\n([^\W\d_]+)([{MARKS}]*))?")
_BEFORE, _AFTER = re.compile(r"[^\S ] "), re.compile(r" [^\S ]")


def _odd_spaces(text: str) -> bool:
    """Whether a space is at an end of the text, or next to white space."""
    return text[0] == " " or text[-1] == " " or "  " in text or bool(_BEFORE.search(text) or _AFTER.search(text))


def chunks(text: str) -> list[str]:
    """Cuts a text before single spaces between characters that are not white space.

    The vocabulary's pre-tokenizer never joins a character with a space after it, and a
    space only with what follows it, so these cuts fall between its own pieces.
    """
    parts = text.split(" ")
    joined, out = parts[0], []
    for part in parts[1:]:
        if part and joined and not part[0].isspace() and not joined[-1].isspace():
            out.append(joined)
            joined = " " + part
        else:
            joined += " " + part
    if joined:
        out.append(joined)
    return out


def _byte_characters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible in Latin-1, else one from 256 on."""
    visible = np.zeros(256, bool)
    visible[[*range(33, 127), *range(161, 173), *range(174, 256)]] = True
    out = np.arange(256, dtype="<u2")
    out[~visible] = 256 + np.arange(np.count_nonzero(~visible))
    return out


def _gathered(pieces: list[bytes], at: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces at these places, one after another, and where those of each place end."""
    size = np.array([len(p) for p in pieces], np.int64) // kind().itemsize
    first, own = np.cumsum(size) - size, size[at]
    ends = np.cumsum(own)
    places = np.repeat(first[at] - (ends - own), own)
    places += np.arange(len(places))
    return np.frombuffer(b"".join(pieces), kind)[places], ends


class Encoder:
    """Ids of texts by the tokenizers library; the ids of words met lately are remembered.

    A word stands for the chunk of a space and itself; the first of a text, which has no
    space before it, has one in its key instead. Other chunks are not remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same for words of letters only, each a piece of its own, given in the characters of their bytes.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.characters = _byte_characters()
        self.byte_level = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        #: Control strings, each one id wherever it stands; a text that holds one is encoded as a whole.
        self.control = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.kind = np.uint32 if self.tokenizer.get_vocab_size() > 1 << 16 else np.uint16
        found = self.tokenizer.encode("a\n b", add_special_tokens=False).ids
        self.line_feed = found[1] if len(found) == 3 else None
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _keys(text: str) -> list[str]:
        if not _odd_spaces(text):
            keys = text.split(" ")
            keys[0] = " " + keys[0]
            return keys
        # a chunk with odd spaces keeps them all and gets two before it, which no other key has
        return [c[1:] if c[0] == " " and len(c) > 1 and " " not in c[1:] else "  " + c for c in chunks(text)]

    @staticmethod
    def _chunk(key: str) -> str:
        return key[2:] if key[:2] == "  " else key[1:] if key[:1] == " " else " " + key

    @staticmethod
    def _parts(key: str) -> list[str] | None:
        """Keys whose ids together are those of a word with marks at its end, and of two words around a line feed.

        The pre-tokenizer ends a run of letters before a mark, a run of marks before
        white space, and a single line feed before a letter.
        """
        word = key.rstrip(MARKS)
        if word.isalpha():  # most keys, told without the expression
            return None if len(word) == len(key) else [word, " " + key[len(word) :]]
        lead, body = (" ", key[1:]) if key[:1] == " " else ("", key)
        m = _MARKED.fullmatch(body)
        if m is None or not (m[2] or m[3]) or not m[1].isalpha() or not (m[3] or "a").isalpha():
            return None
        out = [lead + m[1]]
        if m[2]:
            out.append(" " + m[2])
        if m[3]:
            out += [" \n", " " + m[3]]
            if m[4]:
                out.append(" " + m[4])
        return out

    def _learn(self, missing: list[str]) -> None:
        """Ids of new words, put together from known parts where that is certain."""
        known, whole, composed = self.recent, set(), []
        for key in missing:
            parts = self._parts(key)
            if parts is None:
                whole.add(key)
                continue
            composed.append((key, parts))
            for part in parts:
                if part not in known:
                    if part in self.older:
                        known[part] = self.older[part]
                    else:
                        whole.add(part)
        self._ask(list(whole))
        for key, parts in composed:
            known[key] = b"".join([known[p] for p in parts])

    def _ask(self, words: list[str]) -> None:
        """Encodes words in lines of many: a line feed before a space is a piece of its own, so it separates their ids."""
        plain, letters = [], []
        if self.line_feed is not None:
            letters = [key for key in words if self.byte_level and (key[1:] if key[:1] == " " else key).isalpha()]
            rest = set(words).difference(letters)
            plain = [key for key in rest if key[:1] != " " and "\n" not in key]
        chosen = {*plain, *letters}
        single = [key for key in words if key not in chosen]
        self._lines(plain, self.tokenizer, lambda line: " " + "\n ".join(line))
        self._lines(letters, self.letters, self._spelled)
        for key, found in zip(single, self.tokenizer.encode_batch_fast([self._chunk(k) for k in single], add_special_tokens=False)):
            self.recent[key] = np.array(found.ids, self.kind).tobytes()

    def _lines(self, words: list[str], tokenizer, joined) -> None:
        width = self.kind().itemsize
        lines = [words[i : i + 500] for i in range(0, len(words), 500)]
        for line, found in zip(lines, tokenizer.encode_batch_fast([joined(line) for line in lines], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            raw, start = ids.tobytes(), 0
            for word, end in zip(line, [*np.flatnonzero(ids == self.line_feed).tolist(), len(ids)]):
                self.recent[word] = raw[start * width : end * width]
                start = end + 1

    def _spelled(self, words: list[str]) -> str:
        """The chunks of words, and line feeds between them, in the characters of their bytes, with white space between all."""
        raw = np.frombuffer("\n".join(map(self._chunk, words)).encode(), np.uint8)
        feed = chr(self.characters[10])
        return self.characters[raw].tobytes().decode("utf-16-le").replace(feed, f" {feed} ")

    def _whole(self, text: str) -> bool:
        return any(control in text for control in self.control)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, text in enumerate(texts) if text and self._whole(text)]
        if whole:
            rest = set(range(len(texts))).difference(whole)
            out = dict(zip(sorted(rest), self.encode([texts[i] for i in sorted(rest)]))) if rest else {}
            for i in whole:
                out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.kind)
            return [out[i] for i in range(len(texts))]
        collecting = gc.isenabled()
        gc.disable()  # hundreds of thousands of new words set off the collector again and again, and none is in a cycle
        try:
            return self._plain(texts)
        finally:
            if collecting:
                gc.enable()

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without control strings."""
        out = [np.zeros(0, self.kind)] * len(texts)
        odd = {i for i, text in enumerate(texts) if text and _odd_spaces(text)}
        some = [i for i, text in enumerate(texts) if text and i not in odd]
        if some:
            # words as numbers: each is looked up once
            split = pc.split_pattern(pa.array([texts[i] for i in some], pa.large_string()), " ")
            words = split.values.dictionary_encode()
            keys, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().astype(np.int64)
            bounds = split.offsets.to_numpy()
            first = [f" {texts[i].split(' ', 1)[0]}" for i in some]
            at[bounds[:-1]] = len(keys) + np.arange(len(some))
            ids, ends = _gathered(self._known(keys + first), at, self.kind)
            for i, found in zip(some, np.split(ids, ends[bounds[1:-1] - 1])):
                out[i] = found
        for i in odd:
            out[i] = np.frombuffer(b"".join(self._known(self._keys(texts[i]))), self.kind)
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        return out

    def _known(self, keys: list[str]) -> list[bytes]:
        """The ids of keys; those that are new are learned first."""
        known = self.recent
        found = list(map(known.get, keys))
        empty = [i for i, ids in enumerate(found) if ids is None]
        if empty:
            missing = []
            for key in {keys[i] for i in empty}:
                if key in self.older:
                    known[key] = self.older[key]
                else:
                    missing.append(key)
            self._learn(missing)
            for i in empty:
                found[i] = known[keys[i]]
        return found


def _steps(texts: list[str]) -> list[tuple[int, int]]:
    """Runs of texts of about STEP_CHARACTERS; a longer text ends its run."""
    ends = np.cumsum([len(text) for text in texts], dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // STEP_CHARACTERS)) + 2
    bounds = sorted({0, *cuts.tolist(), len(texts)})
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]


def _shards(path: str, bits: int, shard_ids: int, id_type: pa.DataType):
    def write(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state = worker_state()  # what is remembered serves the worker's next task too
        encoder = state.get(("encoder", path)) or state.setdefault(("encoder", path), Encoder(path))
        part, number = TaskContext.get().partitionId(), 0
        ids, lengths, gathered, total = [], [], [], 0

        def close():
            image = WaveletMatrix.build(np.concatenate(gathered), bits)
            row = [[part], [number], [total], [ids], [lengths], [image]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "number", "n", "ids", "lengths", "image"])

        for batch in slices(batches):
            names, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for start, end in _steps(texts):
                for name, found in zip(names[start:end], encoder.encode(texts[start:end])):
                    ids.append(name)
                    lengths.append(len(found) + 1)
                    gathered.append(np.append(found, np.array([END], found.dtype)))
                    total += len(found) + 1
                    if total >= shard_ids:
                        yield close()
                        ids, lengths, gathered, total, number = [], [], [], 0, number + 1
        if ids:
            yield close()

    return write


def write_shards(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every text, appends id 0, and writes shards in ascending id order; returns the written table.

    A null text is empty and so one id long; a null document id sorts first; repeated
    rows are encoded each; an empty table writes no shard. Other columns are ignored.
    ``tokenizer`` is a file of the tokenizers library. Each row of the table is a
    shard: (part, number) give the order, ``lengths`` the documents, ``image`` the ids.
    """
    from tokenizers import Tokenizer

    bits = max(1, (Tokenizer.from_file(tokenizer).get_vocab_size() - 1).bit_length())
    rows = two_columns(df, id_col, text_col)
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(
        trimmed(_shards(tokenizer, bits, shard_ids, to_arrow_type(kind))),
        f"part int, number int, n bigint, ids array<{kind.simpleString()}>, lengths array<bigint>, image binary",
    ).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _read(id_type: pa.DataType):
    def read(batches):
        for batch in batches:
            for ids, lengths, start, image in zip(*(batch.column(c) for c in ("ids", "lengths", "start", "image"))):
                lengths = np.array(lengths.as_py())
                ends = np.cumsum(lengths)
                values = WaveletMatrix(image.as_py()).to_array().astype("<u4")
                crc = [zlib.crc32(values[e - n : e]) for n, e in zip(lengths.tolist(), ends.tolist())]
                columns = [pa.array(ids.as_py(), id_type), pa.array(start.as_py() + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32"])
                yield from (whole.slice(i, 10_000) for i in range(0, len(whole), 10_000))

    return read


def read_shards(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the ids back: per document id, start, n_tokens and ids_crc32, from the shards' images."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = shards.schema["ids"].dataType.elementType
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard, a few for each GB; as a table its size is known before the join, so images stay in place while it is small
    starts = cut_lineage(shards.select("part", "number", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start")))
    placed = shards.select("part", "number", "ids", "lengths", "image").join(starts, ["part", "number"])
    return placed.mapInArrow(
        trimmed(_read(to_arrow_type(kind))), f"id {kind.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint"
    ).withColumnRenamed("id", id_col)


def token_shards(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes shards below the shared folder and reads them back."""
    return read_shards(write_shards(df, scratch_path(df.sparkSession, "shards"), tokenizer, **options), options.get("id_col", "doc_id"))
