import pyarrow as pa
import pytest

from tidemark.llm import frames
from tests.llm.test_decontaminate import words
from tidemark.llm import lines as L


def brute(rows):
    """rows: (doc_id, text). Later runs of three lines, or of fewer with 50 words, go."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        text = rows[i][1]
        if text is None:
            out[i] = (rows[i][0], None, 0)
            continue
        parts = text.split("\n")
        black = [k for k, x in enumerate(parts) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(black)):
            own = next((black[k : k + m] for m in (1, 2, 3) if k + m <= len(black) and (m == 3 or sum(len(words(parts[j])) for j in black[k : k + m]) >= 50)), None)
            if own is None:
                continue
            run = tuple(parts[j].strip(" \t\r") for j in own)
            if run in seen:
                gone |= set(own)
            seen.add(run)
        out[i] = (rows[i][0], "\n".join(x for k, x in enumerate(parts) if k not in gone), len(gone))
    return sorted(map(str, out.values()))


def n_words(n, of="w"):
    return " ".join(f"{of}{k}" for k in range(n))


CASES = {
    "words": [(1, n_words(50)), (2, "x\n" + n_words(50) + "\ny"), (3, n_words(49)), (4, n_words(49)), (5, n_words(30, "a") + "\n" + n_words(20, "b")), (6, "q\n" + n_words(30, "a") + "\n\n " + n_words(20, "b") + "\nz"), (7, n_words(20, "b") + "\n" + n_words(30, "c")),
              (8, n_words(20, "b") + "\n" + n_words(30, "c") + "\n" + n_words(60)), (9, n_words(60).upper()), (10, n_words(60) + "\n" + n_words(60)), (11, "é " * 50), (12, "é " * 50 + "\nend")],
    "copies": [(i, "a b\nc d\ne f\ng h") for i in range(6)] + [(9, "zz\na b\nc d\ne f\nyy")],
    "chain": [(1, "l1\nl2\nl3\nl4\nl5\nl6\nl7"), (2, "x\nl2\nl3\nl4\nl5\ny"), (3, "l1\nl2\nq\nl3\nl4\nl5"), (4, "l6\nl7")],
    "inside one": [(1, "a\nb\nc\nd\na\nb\nc\nb\nc\nd")], "same line": [(1, "a\n" * 9), (2, "a\na\na\n")],
    "blank": [(1, "a\n\n  b \n\t\nc\n"), (2, "\n\na\nb\nc\n\n\nend"), (3, "a \r\nb\r\nc\r\n")],
    "nulls": [(1, None), (None, "a\nb\nc\nd"), (3, "a\nb\nc\nd"), (4, ""), (5, "\n\n"), (None, None)],
    "one id": [(1, "a\nb\nc\nd"), (1, "q\na\nb\nc")],
    "unicode": [(1, "é\nñ\n漢\n字"), (2, "x\né\nñ\n漢\n字\ny")],
}


@pytest.mark.parametrize("name", list(CASES))
def test_against_brute_force(spark, name):
    rows = CASES[name]
    if name == "one id":  # told apart by text: either may be first
        first, second = brute(rows), brute(rows[::-1])
    df = spark.createDataFrame([(i, t, f"r{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, row string").repartition(3)
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "row", "n_lines_deleted"]
    got = sorted(str((r.doc_id, r.text, r.n_lines_deleted)) for r in out.collect())
    assert got in ([first, second] if name == "one id" else [brute(rows)])


def test_equal_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 5, 1.5)] * 3 + [(2, "a\nb\nc", 6, None)], "doc_id int, text string, n_lines_deleted long, repeated double")
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "repeated", "n_lines_deleted"] and dict(out.dtypes)["doc_id"] == "int"
    assert sorted((r.text, r.n_lines_deleted) for r in out.collect()) == [("", 3)] * 3 + [("a\nb\nc", 0)]


def test_no_rows_and_a_long_text(spark, make):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "\n".join(make(k, 6) for k in range(20_000))
    got = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame([(1, text), (2, "new\n" + text)], "doc_id long, text string")).collect()}
    assert got[1].text == text and got[2].text == "new" and got[2].n_lines_deleted == 20_000


def test_fingerprints_are_thinned(make):
    """Window minima are far fewer than runs, and equal runs have the same one."""
    lines = [make(k, 5) for k in range(400)]
    texts = pa.array(["\n".join(lines), "\n".join([make(999, 5), *lines[100:140], make(998, 5)])])
    batch = pa.RecordBatch.from_pydict({"row": pa.array([1, 2]), "doc_id": pa.array([1, 2]), "text": texts})
    rows = [r for b in L._selected(batch) for r in b.to_pylist()]
    runs = [x for r in rows for x in r["runs"]]
    assert len(runs) == 398 + 40 and len(rows) < 0.6 * len(runs)
    by_run = {}
    for r in rows:
        for x in r["runs"]:
            by_run.setdefault(x["run"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_run.values()) and len(by_run) == 398 + 2 + 0  # 38 of the second text's are the first's


@pytest.mark.parametrize("shares", [1, 3, 2048])
def test_hot_keys_and_others(spark, monkeypatch, shares):
    monkeypatch.setattr(frames, "HOT_SHARES", shares)
    rows = [(k, i) for k, n in ((1, 50), (2, 7), (3, 1), (None, 4), (5, 20)) for i in range(n)]
    left = spark.createDataFrame(rows, "k long, i long")
    right = spark.createDataFrame([(1, 50, "a"), (2, 7, "b"), (5, 20, "c")], "k long, n long, x string")
    got = sorted(map(tuple, frames.hot_join(left, right, ["k"], "n").select("k", "i", "x").collect()))
    assert got == sorted((k, i, {1: "a", 2: "b", 5: "c"}[k]) for k, i in rows if k in (1, 2, 5))
    assert frames.hot_join(left, right.limit(0), ["k"], "n").count() == 0
