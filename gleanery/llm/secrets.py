"""Secret scans with a recursive decoding worklist.

A text is the first layer. Encoded segments of a layer (percent escapes, Unicode
escapes and character references, base64, and compressed bytes inside base64) are
unwrapped into further layers, which are scanned and unwrapped in turn until nothing
new appears. Each layer carries, per character, the range of the original text it
comes from, so a secret found at any depth has a span in the original.
"""

import base64
import bz2
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import slices, trimmed, two_columns

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs of at least 16 are what is left of all runs
_UNBROKEN = re.compile(r"""[^\s"'<>]+""")
_PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Percent signs escaped over and over: what is beyond eight levels goes at once, as layers between differ in the number of 25s only.
_DEEP = re.compile("%(?:25)+(?=(?:25){8})")
_ESCAPED = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++(?=[=\"'<,;)\]}]|[ \t]*+(?:\r?\n|\Z)))++"
)
_PACKED = re.compile("H4sI|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])|Qlpo")  # gzip, zlib, bzip2
_LONE = re.compile("[\ud800-\udfff]")
_WIDE = re.compile(rb"[\x09-\x7e]\0[\x09-\x7e]\0[\x09-\x7e]")  # three characters of UTF-16, of either order
#: Decoded bytes without any of these hold no secret and no further layer.
_TELLING = re.compile(
    rb"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|%[0-9A-Fa-f]{2}|\\[ux]|&#|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-]\r?\n|" + _WIDE.pattern
)
#: Places behind which no match, escape or base64 run can go on: signs that none of them holds, spaces between words, ends of lines.
_CUT = re.compile(
    rb"""[!()*,@\[\]^`{|}~<>$?\x7f]|\0{4}|[\x80-\xbf](?=[\xc2-\xf4])|[^\s:="'\0] (?=[^\s:="'\0])|[^\0A-Za-z0-9+/_\s-]\n|\n\n"""
)
#: Compressed layers are inflated and scanned by about so many bytes, a piece ending at the last such place; no result depends on it.
PIECE_BYTES = 1 << 20
#: Compressed bytes are read by so many; a gzip or zlib stream that has given nothing after them is none.
READ_BYTES = 1 << 16


def scan(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in one layer: leftmost non-overlapping matches of each kind, those too short dropped."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(word in low for word in _WORDS):
            found += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _substituted(text: str, start: int, end: int, matches, decode):
    """A segment with its escapes decoded, and per character the place it comes from."""
    out, starts, ends, at = [], [], [], start

    def kept(upto):
        if upto > at:
            out.append(text[at:upto])
            places = np.arange(at, upto)
            starts.append(places)
            ends.append(places + 1)

    for m in matches:
        kept(m.start())
        chars, firsts, lasts = zip(*decode(m))
        out.append("".join(chars))
        starts.append(np.array(firsts))
        ends.append(np.array(lasts))
        at = m.end()
    kept(end)
    return "".join(out), np.concatenate(starts), np.concatenate(ends)


def _percent(m):
    raw, at = bytes.fromhex(m.group().replace("%", "")), m.start()
    valid = _valid(raw)
    for char in raw.decode() if valid else raw.decode("utf-8", "replace"):
        n = len(char.encode()) if valid else 1
        yield char, at, min(at + 3 * n, m.end())
        at = min(at + 3 * n, m.end() - 3)


def _deep(m):
    yield "%", m.start(), m.end()


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _escape(m):
    body = m.group()
    code = int(body[2:], 16) if body[0] == "\\" else int(body[3:-1], 16) if body[2] in "xX" else int(body[2:-1])
    yield chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", m.start(), m.end()


def _opener(raw: bytes):
    """What opens a compressed stream that begins like this; None for others."""
    if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78":
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if raw[:3] == b"BZh" else None


def _inflated(chunks, ended: list):
    """Decompressed bytes of all members of a stream, by PIECE_BYTES at most; ``ended`` grows with each whole member."""
    chunks, rest, opened = iter(chunks), b"", None
    while True:
        if opened is None:
            while len(rest) < 4 and (more := next(chunks, b"")):
                rest += more
            opened, read, given = _opener(rest), 0, False
            if opened is None:
                return
        try:
            part = opened.decompress(rest, PIECE_BYTES)
        except (zlib.error, OSError, ValueError):
            return
        read, given = read + len(rest), given or bool(part)
        rest = getattr(opened, "unconsumed_tail", b"")
        read -= len(rest)
        if part:
            yield part
        if opened.eof:
            ended.append(True)
            rest, opened = opened.unused_data, None
        elif not rest and getattr(opened, "needs_input", True):
            rest = next(chunks, b"")
            if not rest and not part or not given and hasattr(opened, "unconsumed_tail") and read >= READ_BYTES:
                return


def _unpacked(chunks, ended: list, met: frozenset = frozenset()):
    """What a compressed stream holds, unwrapped as long as that is compressed again; ``chunks()`` starts the stream anew.

    A stream inside that begins like one around it is a cycle and not entered.
    """
    whole = []
    inside = _inflated(chunks(), whole)
    head = next(inside, b"")
    deeper = []
    if head not in met and _opener(head) is not None:
        yield from _unpacked(lambda: _inflated(chunks(), []), deeper, met | {head})
    if not deeper and head not in met:
        yield from itertools.chain([head] if head else [], inside)
    if whole or deeper or head in met:
        ended.append(True)


def _pieces(parts):
    """The same bytes, cut only at places behind which nothing goes on; a piece without one grows."""
    held, searched = bytearray(), 0
    for part in parts:
        held += part
        size = 1 << 12
        while len(held) >= PIECE_BYTES:
            low = max(len(held) - size, searched)
            ends = [m.end() for m in _CUT.finditer(held, low)]
            if ends:
                yield bytes(held[: ends[-1]])
                del held[: ends[-1]]
            if ends or low == searched:
                searched = max(len(held) - 8, 0)
                break
            size *= 8
    if held:
        yield bytes(held)


def _percent_segments(text: str):
    """Unbroken runs with a percent escape in them."""
    for m in _UNBROKEN.finditer(text):
        if text.find("%", m.start(), m.end()) >= 0 and _PERCENT_RUN.search(text, m.start(), m.end()):
            yield m


def _raw(body: str) -> bytes:
    body = body.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _texts(raw: bytes):
    """(text, bytes before it, bytes of a character): as UTF-8, and as UTF-16 of either order and start if it looks like that."""
    if _TELLING.search(raw):
        text = raw.decode("utf-8", "surrogateescape")
        yield text, 0, lambda c: 1 if 0xDC80 <= ord(c) <= 0xDCFF else len(c.encode())
        if _WIDE.search(raw):
            for order, skip in itertools.product(("utf-16-le", "utf-16-be"), (0, 1)):
                text = raw[skip : skip + (len(raw) - skip) // 2 * 2].decode(order, "surrogatepass")
                yield text, skip, lambda c: 4 if ord(c) > 0xFFFF else 2


def _base64_runs(text: str):
    """(places, compressed) of every base64 run to read: one line, or lines in sequence.

    Nothing tells where in a run the encoding begins, as / - and _ belong to it, but starts
    that agree modulo 4 decode alike: four of them are enough for text. Compressed
    bytes are read from where they seem to begin, and from nowhere else.
    """
    for m in _BASE64.finditer(text):
        for packed in _PACKED.finditer(text, m.start(), m.end()):
            yield range(packed.start(), m.end()), True
        for at in range(m.start(), min(m.start() + 4, m.end() - 15)):
            yield range(at, m.end()), False
    for m in _WRAPPED.finditer(text):
        places, firsts = [], []
        for part in _RUN.finditer(text, m.start(), m.end()):
            firsts += [len(places) + p.start() - part.start() for p in _PACKED.finditer(text, part.start(), part.end())]
            places += range(part.start(), part.end())
        places = np.array(places)
        for at in firsts:
            yield places[at:], True
        for at in range(min(4, len(places) - 15)):
            yield places[at:], False


class _Same:
    """A sequence that is one place throughout."""

    def __init__(self, place: int, n: int) -> None:
        self.place, self.n = place, n

    def __getitem__(self, i):
        return self.place


def _through(outer, places):
    """Places of a layer's layer as places of the original; ``places`` may be one throughout, like ``outer``."""
    if isinstance(places, _Same):
        return _Same(int(outer[places.place]), places.n)
    return _Same(outer.place, len(places)) if isinstance(outer, _Same) else outer[places]


def _compressed(text: str, places):
    """Texts of a compressed run, whether or not it is whole; none if it is no such thing."""

    def chunks():
        for at in range(0, len(places), READ_BYTES):
            some = places[at : at + READ_BYTES]
            yield _raw(text[some[0] : some[-1] + 1] if isinstance(some, range) else "".join([text[i] for i in some]))

    for piece in _pieces(_unpacked(chunks, [])):
        yield from (inner for inner, _, _ in _texts(piece))


def _inner(text: str):
    """(how, text, starts, ends) of every encoded segment of a layer; large compressed ones come in pieces."""
    if "%" in text:
        for m in _percent_segments(text):
            deep = _DEEP.search(text, m.start(), m.end())
            signs, decode = (_DEEP, _deep) if deep else (_PERCENT_RUN, _percent)
            yield "url", *_substituted(text, m.start(), m.end(), signs.finditer(text, m.start(), m.end()), decode)
    if "\\" in text or "&#" in text:
        if _ESCAPED.search(text):
            yield "unicode", *_substituted(text, 0, len(text), _ESCAPED.finditer(text), _escape)
    for places, packed in _base64_runs(text):
        if packed:
            first, last = int(places[0]), int(places[-1])
            for inner in _compressed(text, places):
                yield "compressed", inner, _Same(first, len(inner)), _Same(last + 1, len(inner))
            continue
        raw = _raw(text[places[0] : places[-1] + 1] if isinstance(places, range) else "".join([text[i] for i in places]))
        for inner, skip, width in _texts(raw):
            at = np.fromiter(itertools.accumulate(map(width, inner), initial=skip), np.int64, len(inner) + 1)
            where = np.asarray(places)
            yield "base64", inner, where[np.minimum(at[:-1] * 8 // 6, len(where) - 1)], where[np.minimum(-(-at[1:] * 8 // 6), len(where)) - 1] + 1


def _digest(text: str, start: int, end: int) -> tuple[bytes, int, int]:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), start, end


def layers(text: str) -> list[tuple[int, int, int, str]]:
    """All (kind, start, end, path of decodings), the base layer's first in order.

    A layer is dropped as soon as its last inner one has been made, and large ones come in
    pieces, so no chain of layers is held as a whole.
    """
    found = {span: "" for span in scan(text)}
    seen, work = {_digest(text, 0, len(text))}, []

    def enter(layer, starts, ends, path):
        inside = _inner(layer)
        step = next(inside, None)
        if step is not None:
            work.append((inside, step, layer, starts, ends, path))

    enter(text, None, None, "")
    while work:
        inside, (how, inner, s, e), layer, starts, ends, path = work.pop()
        later = next(inside, None)
        if later is not None:
            work.append((inside, later, layer, starts, ends, path))
        inner = _LONE.sub("\ufffd", inner)
        if not inner or inner == layer:
            continue
        if starts is not None:
            s = _through(starts, s)
            e = _through(ends, _Same(e.place - 1, e.n) if isinstance(e, _Same) else e - 1)
        key = _digest(inner, int(s[0]), int(e[-1]))
        if key in seen:  # a cycle, or the same layer by another way
            continue
        seen.add(key)
        name = f"{path}>{how}" if path else how
        for kind, a, b in scan(inner):
            found.setdefault((kind, int(s[a]), int(e[b - 1])), name)
        enter(inner, s, e, name)
    ordered = sorted((start, kind, end, how) for (kind, start, end), how in found.items())
    return [(kind, start, end, how) for start, kind, end, how in ordered]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layer", pa.string())])


def _scan(batches):
    for batch in slices(batches):
        spans = [[{"kind": KINDS[k], "start": s, "end": e, "layer": how} for k, s, e, how in layers(text)] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(_SPAN))], ["id", "spans"])


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans (array of kind, start, end, layer).

    Spans count code points of the original text, end exclusive, ordered by start, then
    kind (assign, access, hex), then end; ``layer`` is empty for the text itself, else
    the decodings that led to the secret, such as ``url>base64``. A span found in the
    text itself is not repeated for a layer. Secrets in compressed bytes have the span of
    the whole run, which may be cut short or of any size. Null and empty texts have no spans;
    repeated rows are scanned each; other columns are ignored; an empty table gives no
    rows.
    """
    rows = two_columns(df, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    span = "struct<kind:string,start:bigint,end:bigint,layer:string>"
    return rows.mapInArrow(trimmed(_scan), f"id {kind}, spans array<{span}>").withColumnRenamed("id", id_col)


def joined_spans(spans):
    """kind:start:end of every span, comma-joined in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
