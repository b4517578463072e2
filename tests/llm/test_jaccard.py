import itertools
import random

import pytest

from tidemark.llm import graph
from tidemark.llm import jaccard as J
from tests.llm.test_decontaminate import words


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    n, root = len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for a, b in itertools.combinations(range(n), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(str((i, None if i is None else least[find(k)], links[k])) for k, (i, _) in enumerate(rows))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(999)}" if r.random() < share else w for w in text.split())


@pytest.mark.parametrize("local", [graph.LOCAL_EDGES, -1])
def test_against_brute_force(spark, make, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rows = []
    for k in range(25):
        base = make(k, 60 + 20 * k)
        rows += [(100 * k, base), (100 * k + 1, base), (100 * k + 2, base.upper() + "!")] + [(100 * k + 3 + j, edited(base, s, j)) for j, s in enumerate((0.005, 0.01, 0.02, 0.04, 0.1))]
    rows += [(5000, None), (5001, ""), (5002, "?"), (5003, "one two"), (5004, "One, two!"), (5005, "two one"), (None, rows[0][1]), (5006, make(77, 30_000)), (5007, edited(make(77, 30_000), 0.01, 5)), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, node int, class_id string").repartition(5)
    got = sorted(str(tuple(r)) for r in J.jaccard_join(df).select("doc_id", "class_id", "n_links").collect())
    assert got == brute(rows)


def test_large_group_in_blocks(spark, make, monkeypatch):
    """More near copies than a block holds, and a chain whose ends are unlike."""
    monkeypatch.setattr(J, "BLOCK", 16)
    base = make(1, 300)
    rows = [(i, edited(base, 0.003, i)) for i in range(70)]
    chain = [make(2, 400).split()]
    for i in range(12):
        w = list(chain[-1])
        w[30 * i : 30 * i + 25] = [f"c{i}x{j}" for j in range(25)]
        chain.append(w)
    rows += [(1000 + i, " ".join(w)) for i, w in enumerate(chain)]
    got = sorted(str(tuple(r)) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect())
    assert got == brute(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_join(empty).count() == 0
    assert [tuple(r) for r in J.jaccard_join(spark.createDataFrame([(1, None)], empty.schema)).collect()] == [(1, 1, 0)]


def test_runs_of_any_length(spark, make, monkeypatch):
    """Runs that are compared, linked whole because they are long, and cut by partitions give the same."""
    rows = [(100 * k + j, edited(make(k, 120), 0.004, j)) for k in range(6) for j in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for run, held in ((2048, 1 << 22), (3, 1 << 22), (2048, 400)):
        monkeypatch.setattr(J, "RUN", run)
        monkeypatch.setattr(J, "HELD", held)
        assert sorted(str(tuple(r)) for r in J.jaccard_join(df).select("doc_id", "class_id", "n_links").collect()) == want


def test_chance_matches_connect_nothing(spark, make):
    """Texts with half of their words in common often share a prefix, and no link."""
    half = make(1, 100)
    nodes = spark.createDataFrame([(i, f"{half} {make(100 + i, 100)}") for i in range(150)], "doc_id long, text string")
    found = J.map_arrow(nodes, J._nodes, "doc_id long, node long, size int, labels binary")
    assert J.candidates(found.select("node", "labels"), 0.8).count() <= 5
    assert J.least_agreement(0.8) < 0.8 * J.TREES * J.DEPTH - 20


def test_blocks_by_bytes(spark, make, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_BYTES", 4000)
    rows = [(i, edited(make(7, 300), 0.003, i)) for i in range(20)]
    got = sorted(str(tuple(r)) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect())
    assert got == brute(rows)


def test_depth():
    assert J.match_depth(0.8) == 6 and J.match_depth(0.95) == 8 and J.match_depth(0.5) < 4
    assert 1 - (1 - 0.8 ** J.match_depth(0.8)) ** J.TREES >= J.RECALL


@pytest.mark.parametrize("local", [None, 0])
@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed, local):
    r = random.Random(seed)
    edges = [(r.randrange(-50, 200), r.randrange(-50, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(3, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long"), local_edges=local).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long"), local_edges=local).count() == 0
