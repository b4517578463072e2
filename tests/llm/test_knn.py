import math

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import knn

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def ask(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in knn.top_k(df, **more).collect())


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.2, 16).tolist()) for i in range(700)]
    same = r.normal(0, 0.2, 16).tolist()
    rows += [(i, same) for i in range(700, 1100)]  # one vector is a third of all
    rows += [(2000, None), (2050, [None] * 16), (2100, [float("nan")] * 16), (2150, [float("inf")] * 16), (None, same), (2200, [0.0] * 16), (2250, []), (2251, []), (2300, [1.0, 2.0]), (2301, [3.0, -1.0]), (2302, [0.5, 0.001])]
    assert ask(spark, rows) == brute(rows)


@pytest.mark.parametrize("block,query_block", [(64, 4), (7, 1), (2048, 2048)])
def test_blocks_and_pruning(spark, block, query_block):
    r = np.random.default_rng(2)
    centres = r.normal(0, 3, (6, 8))
    rows = [(i, (centres[i % 6] + r.normal(0, 0.05, 8)).tolist()) for i in range(900)]
    report = {}
    assert ask(spark, rows, block=block, query_block=query_block, report=report) == brute(rows)
    if block < 900:  # vectors in clusters: most blocks are never looked at
        assert report["solved"] < 0.5 * report["all"]


def test_a_query_sees_every_bin_that_can_matter(spark):
    """Vectors without clusters, queries whose best are far from them, and one id that very many rows repeat."""
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(0, 1, 4) * r.choice([0.1, 1, 10])).tolist()) for i in range(400)] + [(7, [9.0, 9.0, 9.0, 9.0])] * 30
    assert ask(spark, rows, block=20, query_block=3) == brute(rows)


def test_a_repeated_query(spark):
    """Copies of a query are no candidates, however many there are, and don't hide others."""
    rows = [(50, [100.0, 1.0])] * 10 + [(i, [1.0, float(i)]) for i in range(1, 30)]
    assert ask(spark, rows, block=8) == brute(rows[9:])


def test_bins_and_bounds():
    r = np.random.default_rng(3)
    centres = r.normal(0, 5, (12, 4)).round()
    x = np.concatenate([c + r.normal(0, 0.1, (30, 4)) for c in centres])
    pivots = knn.Pivots(centres.astype(int).tolist())
    g, d = pivots.nearest(x)
    groups = [{"g": k, "n": 30, "radius": d[g == k].max(), "norm": np.sqrt((x[g == k] ** 2).sum(1)).max()} for k in range(12)]
    of = knn.bins(groups, pivots, 60)
    assert sorted(of) == list(range(12)) and len(set(of.values())) == 6
    scores = np.sort(x @ x.T, axis=1)[:, ::-1]
    batch = pa.RecordBatch.from_pydict({"query_id": pa.array(range(len(x))), "v": pa.array(x.tolist()), "bin": pa.array([of[k] for k in g.tolist()], pa.int32()), "least": pa.array(scores[:, 5])})
    found = next(knn._targets(pivots, groups, of)(batch)).column("bins").to_pylist()
    assert sum(map(len, found)) < 0.5 * 5 * len(x)  # most are pruned, and never one that is needed
    for i in range(len(x)):
        assert {of[k] for k in g[np.argsort(-(x @ x[i]))[:6]].tolist()} <= {*found[i], of[int(g[i])]}


def test_few_rows_and_large_numbers(spark):
    assert ask(spark, []) == []
    rows = [(0, [1.0]), (1, [2.0])]
    assert ask(spark, rows) == brute(rows) == [(0, 1, 1, 512 * 256)]
    assert ask(spark, [(50, [1.0])]) == []
    big = [(0, [3e6, 1.0]), (1, [2e6, 5.0]), (2, [2e6, 4.0])]
    assert ask(spark, big) == brute(big)
    assert len(ask(spark, [(0, [3e38]), (1, [1e30])])) == 1  # beyond a long: no error


def test_own_queries(spark):
    data = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    out = knn.top_k(data, data.where("vec_id = 7"), k=2).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(out, key=lambda r: r["rank"])] == [(7, 1, 19), (7, 2, 18)]


@pytest.mark.parametrize("k", [1, 30])
def test_fewer_than_k(spark, k):
    rows = [(i, [float(i % 3), 1.0]) for i in range(0, 20)]
    assert ask(spark, rows, k=k) == brute(rows, k)
