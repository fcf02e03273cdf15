"""The splitter helper against a brute-force version that works on strings."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.operators.splitter import SEPARATORS_BY_KIND, split_ranges


def brute_force(text, separators, size, overlap):
    """Pieces as strings, one at a time, as the contract tells it."""
    if text == "":
        return []

    def merge(pieces):
        out, buffer = [], []
        for piece in pieces:
            if buffer and len("".join(buffer)) + len(piece) > size:
                out.append("".join(buffer).strip())
                while len("".join(buffer)) > overlap or (buffer and len("".join(buffer)) + len(piece) > size):
                    buffer.pop(0)
            buffer.append(piece)
        out.append("".join(buffer).strip())
        return [o for o in out if o]

    position = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[position], separators[position + 1:]
    if separator == "":
        pieces, finer = list(text), []
    else:
        head, *rest = text.split(separator)
        pieces = [p for p in [head] + [separator + r for r in rest] if p]
    out, small = [], []
    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
            continue
        if small:
            out.extend(merge(small))
            small = []
        out.extend(brute_force(piece, finer, size, overlap) if finer else [piece])
    return out + (merge(small) if small else [])


TEXTS = st.text(alphabet=st.sampled_from(list("ab \n\n\té😀#")), max_size=120)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(1, 30), st.integers(0, 30), st.sampled_from(sorted(SEPARATORS_BY_KIND)))
def test_equals_brute_force(text, size, overlap, kind):
    overlap = min(overlap, size)
    separators = SEPARATORS_BY_KIND[kind]
    got = [text[lo:hi] for lo, hi in split_ranges(text, separators, size, overlap)]
    assert got == brute_force(text, separators, size, overlap)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(2, 30), st.integers(0, 10))
def test_invariants(text, size, overlap):
    overlap = min(overlap, size)
    ranges = split_ranges(text, SEPARATORS_BY_KIND["text"], size, overlap)
    covered = set()
    for (lo, hi), before in zip(ranges, [None] + ranges[:-1]):
        assert 0 < hi - lo <= size
        assert text[lo:hi] == text[lo:hi].strip()
        if before:
            assert lo >= before[0] and hi >= before[1] and before[1] - lo <= overlap
        covered.update(range(lo, hi))
    assert all(c.isspace() for i, c in enumerate(text) if i not in covered)


def test_separators_without_a_last_resort_leave_long_words_whole():
    assert _texts("aaaaaaaa bb cc", [" "], 5, 0) == ["aaaaaaaa", "bb", "cc"]


def _texts(text, separators, size, overlap):
    return [text[lo:hi] for lo, hi in split_ranges(text, separators, size, overlap)]


def test_overlap_must_not_exceed_size():
    with pytest.raises(ValueError):
        split_ranges("abc", [""], 2, 3)


PYTHON = (
    "def hello(name):\n    '''Say hello to someone by name.'''\n    return 'Hello ' + name\n\n"
    "class Greeter:\n    '''A class that greets people.'''\n\n    def greet(self, name):\n        return hello(name)\n"
)


def test_python_chunks_hold_a_definition():
    chunks = _texts(PYTHON, SEPARATORS_BY_KIND["python"], 100, 20)
    assert len(chunks) > 1 and all("def " in c or "class " in c for c in chunks)


def test_text_chunks_by_paragraph():
    text = "This is the first paragraph.\n\nHere is a second one.\n\nAnd the third, last."
    chunks = _texts(text, SEPARATORS_BY_KIND["text"], 50, 10)
    assert len(chunks) > 1 and all(10 < len(c) <= 50 for c in chunks)
    assert re.sub(r"\s", "", "".join(chunks)) == re.sub(r"\s", "", text)
