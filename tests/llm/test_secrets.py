import base64
import bz2
import gzip
import re
import time
import zlib
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from gleanery.llm import secrets as secrets_module
from gleanery.llm.secrets import joined_spans, layers, secrets

SF_DIR = "/root/testdata/sf0.01"
HEX = "0123456789abcdef0123"
KEYS = ("assign", "access", "hex")


def base(text):
    """The contract's three patterns, matches that are too short dropped afterwards."""
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, s, e) for s, k, e in sorted(found)]


def b64(raw):
    return base64.b64encode(raw.encode() if isinstance(raw, str) else raw).decode()


@pytest.mark.parametrize("text", [
    "token=secret=abcdefghijklmnop", "token=api_key:abcdefghijkl", "PASSWORD : 'abcdefghijkl'", "passwd=short", "AKIA" + "A" * 13, "AKIA" + "A" * 14,
    "é" * 50 + HEX, "toKen=" + "a" * 12, "ſecret=abcdefghijklmn", "api_key=" + HEX + ", apikey: " + HEX, "x" * 100_000 + " " + HEX, "AKIAAKIA" + "B" * 14,
])
def test_base_spans(text):
    assert [s[:3] for s in layers(text) if s[3] == ""] == base(text)


@pytest.mark.parametrize("encode, path", [
    (quote, "url"), (lambda s: quote(quote(s)), "url>url"), (lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "unicode"),
    (lambda s: "".join(f"&#{ord(c)};" for c in s), "unicode"), (b64, "base64"), (lambda s: b64(b64(s)), "base64>base64"),
    (lambda s: b64(gzip.compress(s.encode())), "compressed"), (lambda s: b64(zlib.compress(gzip.compress(s.encode()))), "compressed"),
    (lambda s: "".join(f"%{b:02x}" for b in b64("é " + s).encode()), "url>base64"), (lambda s: b64(quote("a b " + s)), "base64>url"),
])
def test_layers_are_unwrapped_and_spans_lead_to_the_original(encode, path):
    secret = 'password = "hunter2hunter2="'
    inner = encode(secret)
    found = layers(f"before {inner} after é")
    deep = [s for s in found if s[0] == 0]
    assert len(deep) == 1
    kind, start, end, how = deep[0]
    assert how == path
    assert 7 <= start < end <= 7 + len(inner)


def test_spans_in_layers_are_exact():
    text = "x=%41%4BIA" + "B" * 14 + " y"
    assert [s for s in layers(text) if s[0] == 1] == [(1, 2, len(text) - 2, "url")]
    inner = "zzz " + HEX + " z"
    start = 4 * 8 // 6
    span = next(s for s in layers(b64(inner)) if s[3] == "base64")
    assert span[:2] == (2, start) and span[2] == -(-(4 + len(HEX)) * 8 // 6)


def test_cycles_end():
    assert layers("%2525252525" * 100) == []
    for depth in (3, 12, 4_000):
        deep = "%" + "25" * depth + "41KIA" + "B" * 14
        assert any(kind == 1 and start == 0 for kind, start, _, _ in layers(deep))
    started = time.perf_counter()
    layers("%" + "25" * 500_000)
    assert time.perf_counter() - started < 10


def test_rows_of_every_kind(spark):
    rows = [(1, None), (2, ""), (3, f"token={HEX}"), (3, f"token={HEX}"), (None, HEX)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, spans string")
    found = secrets(df).select("doc_id", joined_spans("spans").alias("s"), F.size("spans").alias("n")).collect()
    assert sorted(((r.doc_id, r.s) for r in found), key=repr) == sorted(
        [(1, ""), (2, ""), (3, "assign:0:26,hex:6:26"), (3, "assign:0:26,hex:6:26"), (None, "hex:0:20")], key=repr
    )
    assert secrets(df.limit(0)).collect() == []


def test_base_columns_against_brute_force(spark):
    import hashlib

    from gleanery.llm.queries import QUERIES

    docs = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    for row in QUERIES["op7_secrets"](spark, SF_DIR).collect():
        spans = base(docs[row.doc_id] or "")
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[0] == k for s in spans) for k in range(3))
        text = ",".join(f"{KEYS[k]}:{s}:{e}" for k, s, e in spans)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(row.spans.split(","))


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lambda raw: zlib.compress(gzip.compress(raw))])
def test_layers_of_any_size_are_read_in_pieces(pack, monkeypatch):
    """Secrets at every place of a log of many pieces, borders included; a layer after it is scanned too."""
    monkeypatch.setattr(secrets_module, "PIECE_BYTES", 5_000)
    lines = [f"line {i} ok: password = '{i:016d}' {quote(f'token={i:020d}')}\n" for i in range(3_000)]
    sizes = []
    whole = secrets_module.scan
    monkeypatch.setattr(secrets_module, "scan", lambda text: sizes.append(len(text)) or (spans.extend(whole(text)) or whole(text)))
    spans = []
    run = b64(pack("".join(lines).encode()))
    found = layers(f"{run} {b64(b'password=abcdefgh12345678')}")
    assert {how for _, _, _, how in found} >= {"compressed", "base64"} and max(sizes[1:]) <= max(len(run), 10_000) < sum(map(len, lines)) / 4
    assert sum(kind == 0 for kind, _, _ in spans) >= 6_000 and (0, 0, len(run), "compressed") in [(*s[:2], len(run), s[3]) for s in found]


def test_a_compressed_layer_of_zeros_needs_little(monkeypatch):
    sizes = []
    scan = secrets_module.scan
    monkeypatch.setattr(secrets_module, "scan", lambda text: sizes.append(len(text)) or scan(text))
    bomb = b64(gzip.compress(bytes(1 << 25) + f" token={HEX} ".encode()))
    assert any(how == "compressed" and kind == 0 for kind, _, _, how in layers(bomb))
    assert max(sizes) <= max(len(bomb), 1 << 21)


@pytest.mark.parametrize("head", ["a/", "abc/", "/", "x_y-z/", "data/path/", "path-"])
def test_runs_with_something_before_the_encoding(head):
    for raw in (b"  password=abcdefgh12345678", gzip.compress(b"password=abcdefgh12345678")):
        assert any(kind == 0 for kind, *_ in layers(f"see {head}{b64(raw)} there"))


def test_decoded_spans_against_brute_force():
    """Random secrets in random nested encodings: what unwrapping the known way finds is among the spans, at places inside the segment."""
    import random

    rng = random.Random(3)
    ways = {"url": lambda x: "".join(f"%{b:02X}" for b in x.encode()), "base64": b64, "unicode": lambda x: "".join(f"\\u{ord(c):04x}" for c in x),
            "compressed": lambda x: b64(gzip.compress(x.encode()))}
    for _ in range(150):
        text = f"{'é' * rng.randint(0, 3)} api_key: {rng.randbytes(9).hex()} "
        names = [rng.choice(list(ways)) for _ in range(rng.randint(1, 4))]
        inner = text
        for name in names:
            inner = ways[name](inner)
        before = "x " * rng.randint(0, 5)
        met = [s for s in layers(f"{before}{inner} y") if s[0] == 0 and s[3]]
        assert met and all(len(before) <= s < e <= len(before) + len(inner) for _, s, e, _ in met)


@pytest.mark.parametrize("sign", ["\u00a0", "\ufeff", "\u200b", "\u3000", "\f", "\x1b", "\0"])
def test_layers_with_any_character_are_scanned(sign):
    inner = f"{sign} name\npassword=abcdefgh12345678\n"
    for raw in (inner.encode(), b"\xff" + inner.encode(), inner.encode("utf-16"), inner.encode("utf-16-be")):
        assert any(kind == 0 for kind, *_ in layers(f"x {b64(raw)} y"))
        assert any(kind == 0 and how == "compressed" for kind, _, _, how in layers(f"x {b64(gzip.compress(raw))} y"))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    "])
def test_base64_runs_continue_over_line_ends(end):
    import base64

    inner = "é" * 25 + " password=abcdefgh12345678" + "é" * 60
    wrapped = end.join(base64.encodebytes(inner.encode()).decode().split("\n")[:-1])
    text = f"begin:{end}{wrapped}{end}: end"
    first = inner.encode().index(b"password")
    places = [i for i in range(text.index(wrapped), len(text)) if text[i] not in " \r\n"]
    span = (0, places[first * 8 // 6], places[-(-(first + 25) * 8 // 6) - 1] + 1)
    assert span in [found[:3] for found in layers(text)]
    packed = base64.encodebytes(gzip.compress(inner.encode() + bytes(range(256)))).decode()
    assert any(kind == 0 and how == "compressed" for kind, _, _, how in layers(f"begin:\n{packed}"))


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, zlib.compress])
def test_every_member_of_a_compressed_stream_is_scanned(pack):
    """Rotated logs are streams one after the other; what follows the last whole one is passed over."""
    for tail in (b"", b"\x1f\x8bno member", b"other"):
        found = layers(b64(pack(b"first member\n") + pack(f"token={HEX}\n".encode()) + tail))
        assert any(s[0] == 0 for s in found)
    assert layers(b64(pack(b"cut short " * 50)[:-9])) == []


@pytest.mark.parametrize("run", ["日本" * 250_000 + "%", "x" * 500_000 + "%4", "%" * 300_000, "日" * 200_000 + "%41" + "本" * 200_000, "% " * 200_000])
def test_percent_segments_take_linear_time(run):
    started = time.perf_counter()
    layers(run)
    assert time.perf_counter() - started < 5
