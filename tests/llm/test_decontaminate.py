import hashlib
import re

import pytest

from tidemark.llm import decontaminate as D

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            m = min(8, len(v))
            if item is None or not m:
                continue
            grams = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)}
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in grams:
                    hit |= set(range(k, k + m))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case(make):
    a, b, c = make(1, 40), make(2, 30), make(3, 8)
    items = [(1, a), (2, b), (3, c), (10, a), (4, "Just Five Words of Text"), (5, "one"), (6, None), (None, b), (7, "..."), (8, "x x x x x x x x x x"), (1, a)]
    w = a.split()
    docs = [
        (1, make(9, 50) + " " + a + " " + make(8, 50)), (2, " ".join(w[:7])), (3, " ".join(w[5:13])), (4, a.upper() + ", " + b.replace(" ", " - ")), (5, None), (6, ""), (7, "?!"),
        (8, "so just five WORDS, of text. and one more one"), (9, "x " * 40), (10, make(20, 9000) + " " + c + " " + make(21, 400)), (11, " ".join(w[:12]) + " Z " + " ".join(w[12:24])),
        (12, "just five words"), (13, "été " + c + " été"), (None, a), (2, " ".join(w[:9])), (3, " ".join(w[5:13])), (14, "one"),
    ]
    return docs, items


@pytest.mark.parametrize("limit", [D.MAX_INDEX_BYTES, 0, 1])
def test_against_brute_force(spark, case, limit, monkeypatch):
    docs, items = case
    if limit == 1:  # a filter that lets nearly everything through
        monkeypatch.setattr(D, "FILTER_BITS", 64)
    d = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, n_hit int, k string").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in D.decontaminate(d, b, max_index_bytes=limit).select(COLUMNS).collect()), key=str)
    assert got == brute(docs, items)
    kept = D.reject(d, b, max_index_bytes=limit)
    assert kept.columns == d.columns and all(brute([(r.doc_id, r.text)], items)[0][3] == 0 for r in kept.collect())
    assert kept.count() == sum(brute([x], items)[0][3] == 0 for x in docs)


@pytest.mark.parametrize("limit", [D.MAX_INDEX_BYTES, -1])
def test_empty_tables(spark, limit):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(d, b, max_index_bytes=limit).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in D.decontaminate(some, b, max_index_bytes=limit).select(COLUMNS).collect()] == [(1, 3, 0, 0)]
    assert D.reject(some, b, max_index_bytes=limit).count() == 1


def test_random_spans(spark, make):
    """Spans of eight words are found wherever they are; seven are not."""
    item = make(50, 60).split()
    docs = []
    for k in range(0, 52, 3):
        docs += [(2 * k, f"{make(k + 100, 30)} zz {' '.join(item[k : k + 8])} zz {make(k + 200, 10)}"), (2 * k + 1, f"{make(k + 100, 30)} zz {' '.join(item[k : k + 7])} zz")]
    items = [(1, " ".join(item))]
    got = sorted((tuple(r) for r in D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select(COLUMNS).collect()), key=str)
    assert got == brute(docs, items) and all((r[2] == 8) == (r[0] % 2 == 0) for r in got)
