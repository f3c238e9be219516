import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from quantloom.llm import suffix_array as sa


def check(text, depth):
    t = np.frombuffer(text, np.uint8)
    got = sa.suffix_array(t, depth)
    assert sorted(got.tolist()) == list(range(len(text)))
    keys = [text[i : i + depth] for i in got]
    assert keys == sorted(keys)
    if depth >= len(text):
        assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    shared = sa.permuted_common_prefixes(t, got, depth)
    for r in range(1, len(got)):
        a, b = text[got[r] :], text[got[r - 1] :]
        n = next((k for k in range(min(len(a), len(b), depth)) if a[k] != b[k]), min(len(a), len(b), depth))
        assert shared[got[r]] >= n and (shared[got[r]] == n or b"\0" in text or len(a) < depth or len(b) < depth)


@settings(max_examples=300, deadline=None)
@given(s.text("ab", max_size=60) | s.text("abc\x00", max_size=80) | s.text(max_size=40), s.sampled_from([1000, 16, 5]))
def test_random(text, depth):
    check(text.encode(), depth)


@pytest.mark.parametrize("text", [b"", b"a", b"ba", b"mississippi" * 9, b"a" * 300, b"ab" * 150, b"z" * 50 + b"a" * 50, bytes(range(256)) * 2, b"the cat sat on the mat " * 12])
def test_shapes(text):
    check(text, 1000)
    check(text, 100)
