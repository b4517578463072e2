import duckdb
import pytest

from tidemark.llm import licenses as L


@pytest.fixture(scope="module")
def docs(make):
    t = [x for _, x in L.TEMPLATES]
    half = " ".join(t[3].split()[:30])
    most = t[3].replace("merge, publish,", "join, show,")
    rows = [(i, make(i, 40) + "\n" + x + "\n" + make(i + 50, 30)) for i, x in enumerate(t)]
    rows += [(100, None), (101, ""), (102, "Released under the"), (103, make(3, 8000) + " " + t[0].upper()), (104, half), (105, most), (106, " ".join(t)), (107, "Released under the MIT-License"), (108, "released, under the mit license " * 500), (109, make(1, 300)), (None, t[0]), (0, t[9])]
    return rows


def test_against_every_window(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, s int, license string").repartition(3)
    got = sorted((str(r.doc_id), r.license, round(r.containment, 9), r.start_word) for r in L.scan(df).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [d for d in docs if d[0] is not None])
    want = sorted((str(a), b, round(c, 9), d) for a, b, c, d in con.execute(L.oracle()).fetchall())
    assert [g for g in got if g[0] != "None"] == want and ("None", "MIT", 1.0, 0) in got
    by = {(g[0], g[1]) for g in got}
    assert {("105", "MIT"), ("107", "MIT"), ("108", "MIT"), ("103", "MIT")} <= by and not {g for g in by if g[0] in ("100", "101", "102", "104", "109")}


def test_notices_that_share_words(spark, make):
    """Each notice alone is that of its license and of no other; two in one document are both told."""
    rows = [(i, f"{make(i, 30)}. {x} {make(i + 70, 30)}") for i, (_, x) in enumerate(L.TEMPLATES)]
    by = dict(L.TEMPLATES[::-1])
    rows += [(100, f"{by['LGPL-3.0']} {make(5, 400)} {by['GPL-3.0']}")]
    got = {}
    for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {i: {k} for i, (k, _) in enumerate(L.TEMPLATES)} | {100: {"LGPL-3.0", "GPL-3.0"}}


def test_no_rows_and_own_templates(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "do what you want with this text please")], "doc_id long, text string")
    assert [tuple(r) for r in L.scan(df, [("X", "Do what you want with this"), ("Y", "too short")]).collect()] == [(1, "X", 1.0, 0)]
    assert L.scan(df, []).count() == 0


def test_no_python_in_the_plan(spark):
    plan = L.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bands_meet():
    s, c = 10, 0.8
    for s in range(1, 200):
        w = s + L.step(s)
        assert 1 - (1 - c * s / (w + (1 - c) * s)) ** L.BANDS > 0.998
