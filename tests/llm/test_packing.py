import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing
from tidemark.llm import text as T


@pytest.fixture(scope="module")
def reference():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_same_ids_as_the_tokenizer(reference, make):
    for t in [make(1, 300), "", " ", "  a\n\n b\t", "été über ñandú 漢字 😀", "it's 12,345.67!!  ", "x" * 3000, "a b c", "\r\n\r\n "]:
        assert [*packing.encoder().encode_ordinary(t), 0] == reference(t)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_same_ids_for_any_text(text):
    global _fuzzed
    from public_tokenizers import path
    from tokenizers import Tokenizer

    _fuzzed = _fuzzed or Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert packing.encoder().encode_ordinary(text) == _fuzzed.encode(text, add_special_tokens=False).ids


_fuzzed = None


def test_round_trip(spark, reference, make):
    texts = {i: make(i, 5 + 37 * i) for i in range(30)} | {30: None, 31: "", 32: make(7, 9000), 33: make(3, 116), 34: "x"}
    rows = [*texts.items(), (33, texts[33]), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, key int, ids int, start int").repartition(3)
    got = packing.pack(df).toPandas()
    whole = defaultdict(list)
    for r in got.itertuples():
        whole[None if r.doc_id != r.doc_id else int(r.doc_id)].append(r)
    for i, t in {**texts, None: "no id"}.items():
        ids, times = reference(t), 2 if i == 33 else 1
        parts = sorted(whole.pop(i), key=lambda r: r.start)
        assert sum(r.length for r in parts) == times * len(ids) and {r.doc_tokens for r in parts} == {len(ids)}
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        if times == 1:
            assert [r.start for r in parts] == list(np.cumsum([0, *[r.length for r in parts]])[:-1])
    assert not whole
    padding = 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == list(np.cumsum([0, *s.length])[:-1])
        n = s.length.sum()
        assert 0 < n <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding == 0


END = "<|endoftext|>"
ENDS = [END, f"{END} b", f"a {END} b", f"a {END}", f"{END}{END}", f"a{END}  {END}b \n", f"x <|endoftext|{END} <|ENDOFTEXT|>", f"it's  {END}\n\n 12 {END}é"]


@pytest.mark.parametrize("text", ENDS)
def test_added_token_in_text(reference, text):
    assert [*packing.encoder().encode(text, allowed_special="all"), 0] == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(END), st.text(st.characters(exclude_categories=["Cs"]), max_size=9)), max_size=7).map("".join))
def test_added_token_in_any_text(text):
    global _fuzzed
    from public_tokenizers import path
    from tokenizers import Tokenizer

    _fuzzed = _fuzzed or Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert packing.encoder().encode(text, allowed_special="all") == _fuzzed.encode(text, add_special_tokens=False).ids


def test_packs_added_tokens(spark, reference):
    got = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(ENDS)), "doc_id long, text string"), length=1 << 20).groupBy("doc_id", "doc_tokens").count().collect()}
    assert {i: got[i].doc_tokens for i in got} == {i: len(reference(t)) for i, t in enumerate(ENDS)}
    one = packing.pack(spark.createDataFrame([(1, f"a {END} b")], "doc_id long, text string")).collect()
    ids = np.array(reference(f"a {END} b"), "<u4")
    assert sum(r.length for r in one) == len(ids) and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in one)


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hilbert_is_a_curve():
    """On a full small grid each index comes once, and neighbours on the curve are neighbours in space."""
    n = 4
    grid = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(grid))
    assert len(set(packing.hilbert(grid).tolist())) == n**3
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_like_texts_lie_near(make):
    base = [make(i, 200) for i in range(40)]
    near = [t + " and one more" for t in base]
    c = next(T.chunks(pa.array([*base, *near])))
    key = packing.hilbert(packing.cells(packing.vectors(c)))
    place = np.argsort(np.argsort(key))
    assert np.median(np.abs(place[:40] - place[40:])) <= 6
