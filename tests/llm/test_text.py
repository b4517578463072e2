"""The byte-level words, hashes and minima against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB9 -.\néß漢\t", max_size=40)), max_size=12)


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words(texts, limit):
    column = pa.array(["x", *texts, "y"], pa.string()).slice(1, len(texts))
    seen, rows = {}, 0
    for c in T.chunks(column, limit):
        w = T.words(c)
        for r in range(c.low, c.high):
            lo, hi = w.first[r - c.low], w.first[r - c.low + 1]
            own = [c.data[w.start[i] : w.end[i]].tobytes() for i in range(lo, hi)]
            assert [T.LOWER[np.frombuffer(x, np.uint8)].tobytes().decode() for x in own] == plain_words(texts[r])
            for word, h in zip(plain_words(texts[r]), w.hash[lo:hi], strict=True):
                assert seen.setdefault(word, h) == h
            rows += 1
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_lines(texts):
    for c in T.chunks(pa.array(texts, pa.string())):
        w = T.lines(c)
        for r in range(c.high - c.low):
            lines = [x for x in (texts[c.low + r] or "").split("\n") if x.strip(" \t")]
            assert w.counts[r] == len(lines)
            assert len({x.strip(" \t") for x in lines}) == len(set(w.hash[w.first[r] : w.first[r + 1]]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=12), max_size=5), st.integers(1, 5))
def test_window_minima(rows, window):
    values = np.array([x for r in rows for x in r], np.uint64)
    first = np.cumsum([0, *map(len, rows)])
    keep = T.window_minima(values, first, window)
    want = np.zeros(len(values), bool)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        for i in range(lo, hi - window + 1):
            want[i : i + window] |= values[i : i + window] == values[i : i + window].min()
    assert (keep == want).all()


def test_grams_and_null_columns():
    x = np.arange(10, dtype=np.uint64)
    assert len(T.grams(x, 4)) == 7 and len(T.grams(x, 11)) == 0
    assert T.grams(x[2:], 4)[0] == T.grams(x, 4)[2]
    assert [(c.low, c.high, len(c.data)) for c in T.chunks(pa.nulls(3))] == [(0, 3, 0)]
    assert list(T.chunks(pa.array([], pa.string()))) == []
