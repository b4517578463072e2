import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import text as T
from tidemark.llm import toxicity as X

INSULTS = ["numbskull", "blockhead", "dimwit", "lickspittle"]


def labelled(make, n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w, bad = make(seed * 10_000 + i, r.randrange(3, 120)).split(), r.random() < 0.3
        for _ in range(r.randrange(1, 4) if bad else 0):
            w.insert(r.randrange(len(w) + 1), r.choice(INSULTS))
        rows.append((i, " ".join(w), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model(make):
    rows = labelled(make, 600)
    return X.fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))


def scores(model, texts):
    return np.concatenate([model.scores(c) for c in T.chunks(pa.array(texts, pa.string()))])


def test_held_out(model, make):
    rows = labelled(make, 300, seed=1)
    s, y = scores(model, [t for _, t, _ in rows]), np.array([y for *_, y in rows])
    assert ((s >= 0.5) == (y == 1)).mean() > 0.98


def test_gaps_and_insertions(model):
    bad = ["you dim-wit", "a d.i.m.w.i.t here", "b l o c k h e a d", "NUMBSKULL!!", "numbxskull", "some blockkhead", "lick*spittle", "numbskll", "blozckhead"]
    assert (scores(model, bad) > 0.5).all()
    assert (scores(model, ["a river of stone", "", None, "12 34", "\n\t", "a silver garden under snow"]) < 0.5).all()


def test_whole_text_counts(model, make):
    long = make(5, 60_000)
    s = scores(model, [long, long + " dimwit", "dimwit " + long])
    assert s[0] < 0.5 < min(s[1:])


def test_table_is_the_kernel_machine():
    """The folded table gives the sum over landmarks of the kernel, computed by definition."""
    def phi(w):
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < X.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + X.DECAY ** (k - i + 1)
        return out

    kernel = lambda a, b: sum(v * phi(b).get(u, 0) for u, v in phi(a).items())
    code = lambda u: (int(X._FOLD[ord(u[0])]) * X.SYMBOLS + int(X._FOLD[ord(u[1])])) * X.SYMBOLS + int(X._FOLD[ord(u[2])])
    landmarks, alpha = ["blockhead", "dimwit", "stone"], [1.5, -0.5, 0.25]
    table = np.zeros(X.SYMBOLS**3, np.float32)
    for x, a in zip(landmarks, alpha, strict=True):
        for u, v in phi(x).items():
            table[code(u)] += a * v
    words = ["blockhead", "bloxckhead", "wit", "at", "stones"]
    _, f = X.word_scores(next(T.chunks(pa.array([" ".join(words)]))), table)
    for w, got in zip(words, f, strict=True):
        assert got * X._NORM[len(w)] == pytest.approx(sum(a * kernel(w, x) for x, a in zip(landmarks, alpha, strict=True)), abs=1e-4)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(9, 0), (9, None)]):
        texts, y = X.labelled(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        got = X.score(docs, X.fit(texts, y)).collect()
        assert sorted(r.doc_id for r in got) == [1, 2] and all(r.score < 1e-9 for r in got)
    assert X.score(docs.limit(0), X.fit([], np.array([]))).count() == 0


def test_query_uses_other_rows_only(spark, make, tmp_path):
    """Held-out labels may be anything: they don't change a score."""
    from tidemark.llm import queries

    rows = labelled(make, 400, seed=2)
    out = []
    for name, flip in (("a", False), ("b", True)):
        spark.createDataFrame([(i, t, "l", 1) for i, t, _ in rows], "doc_id long, text string, score string, held_out int").write.parquet(str(tmp_path / name / "documents.parquet"))
        labels = [(i, 1, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        out.append({r.doc_id: r for r in queries.op9_toxicity(spark, str(tmp_path / name)).collect()})
    assert {i: r.score for i, r in out[0].items()} == {i: r.score for i, r in out[1].items()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in out[0].items())


def test_rejection_keeps_columns(spark, model):
    docs = spark.createDataFrame([(1, "you dimwit", "x", 2.5), (2, "a river", None, None), (None, None, "y", 1.0), (2, "a river", None, None)], "doc_id int, text string, score string, row double")
    kept = X.reject(docs, model)
    assert kept.schema == docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "None"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_rows_of_a_table(spark):
    """Some labels there have no word to tell them by; the bounds leave room for them."""
    from tidemark.llm.queries import op9_toxicity

    sf = "/root/testdata/sf0.1"
    rows = op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}), "doc_id").collect()
    held = [(r.predicted, r["max(toxic)"]) for r in rows if r.held_out]
    toxic, clean = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert len(toxic) > 50 and sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_no_bound_on_the_words_of_a_text(model, make):
    """All words of a text count, also beyond any length that examples have."""
    sizes = [model.rows(c)[0, -1] for n in (5_000, 20_000) for c in T.chunks(pa.array([make(1, n)]))]
    assert sizes[0] == pytest.approx(np.log1p(5_000)) and sizes[1] == pytest.approx(np.log1p(20_000))
    harmless = make(2, 20_000)
    assert (scores(model, [harmless]) < 0.5).all()
