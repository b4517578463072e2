from collections import defaultdict

import pytest

from tests.llm.test_decontaminate import words
from tidemark.llm import passages as P

N = P.LENGTH


def brute(rows):
    """Maximal passages of which every window of N words occurs elsewhere: (doc_id, start, n_words)."""
    seen = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        if i is None or t is None:
            continue
        w = words(t)
        for s in range(len(w) - N + 1):
            seen[tuple(w[s : s + N])].append((k, s))
    inside = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                inside[k].add(s)
    out = []
    for k, starts in inside.items():
        now = None
        for s in sorted(starts):
            if now and s <= now[1]:
                now[1] = s + N
            else:
                now = [s, s + N]
                out.append((k, now))
    return sorted((rows[k][0], a, b - a) for k, (a, b) in out)


@pytest.fixture(scope="module")
def rows(make):
    p, q = make(1, 80), make(2, 50)
    r = p.split()
    return [
        (1, f"{make(10, 100)} {p} {make(11, 30)}"), (2, f"{p} {make(12, 60)} {q}"), (3, f"{make(13, 40)} {' '.join(r[10:70])} x {q} y"), (4, " ".join(r[:49])), (5, f"a {' '.join(r[30:80])}"),
        (6, f"{make(14, 200)}"), (7, make(15, 120)), (8, make(15, 120)), (9, make(15, 120)), (10, None), (11, ""), (12, "word " * 300), (13, "some pair " * 120), (14, "some pair " * 90 + "end"),
        (15, f"{q} {make(16, 20)} {q.upper()}"), (None, p), (16, make(17, 15_000)), (17, f"{make(18, 70)} {' '.join(make(17, 15_000).split()[7000:9000])}"), (18, make(19, 50)), (18, make(19, 50)), (19, q),
    ]


@pytest.mark.parametrize("hot", [P.HOT_ROWS, 2])
def test_against_brute_force(spark, rows, hot):
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, start int, lead string").repartition(4)
    out = P.repeated_passages(df, hot_rows=hot).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words) for r in out) == brute(rows)
    by = {(r.doc_id, r.start_word): r for r in out}
    assert by[7, 0].is_first and not by[8, 0].is_first and (by[9, 0].first_doc_id, by[9, 0].last_doc_id, by[9, 0].n_places) == (7, 9, 3)
    assert by[1, 100].is_first and not by[2, 0].is_first
    assert {r.doc_id for r in out}.isdisjoint({4, 6, 10, 11})


def test_no_rows(spark, make):
    assert P.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert P.repeated_passages(spark.createDataFrame([(1, make(1, 200)), (2, make(2, 200)), (3, None)], "doc_id long, text string")).count() == 0


def test_held_groups_are_whole(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "HELD", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.start_word, r.n_words) for r in P.repeated_passages(df).collect()) == brute(rows)
