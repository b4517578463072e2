import re

import pytest

from tidemark.llm import urls as U

URLS = [
    "http://a.com/x", "http://com/", "http://a.com", "https://EXAMPLE.com/en/1", "https://www.example.com/en/1", "http://x.www.example.com/en/", "http://example.com/fr/", "http://notexample.com/en/2", "http://a.net/es/1?q=1",
    "http://net/fr/", "http://a.net/esx", "http://a.net/de/", "http://a.b.org/p/q?x=1&y=2#z", "http://a.com?x=/", "http://a.com#/en/", "no scheme/com/", "", None, "ftp://h.com:80/en/", "http:///p", "x://a.com/b://c.net/fr/", "HTTP://Ä.Com/É",
    "http://m.example.com/EN/", "http://a.net/es/\n/x", "http://.com/",
    "http://long.org/" + "a/b?c=1&" * 30_000, "http://" + "h" * 50_000 + ".net/fr/x",
]


def brute(url, rules=U.RULES):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(r), r, v) for v, r in rules for name, _, rest in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, None)


@pytest.mark.parametrize("rules", [U.RULES, [], [("block", "org/"), ("allow", "b.org/p/"), ("block", "com/x")]])
def test_rules_against_brute_force(spark, rules):
    rows = [(i, u, 1, "r") for i, u in enumerate(URLS)] + [(3, URLS[3], 2, "r"), (None, URLS[0], 3, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int, rule string")
    got = sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in U.judge(df, rules).collect()), key=str)
    want = sorted(((str(i), *brute(u, rules)) for i, u, *_ in rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4] == w[4] if w[3] else g[4] in ("allow", "block") for g, w in zip(got, want, strict=True))


def test_learns_from_labelled_urls(spark):
    good = [(f"https://shop{i % 7}.example.org/item/{i}", "allow") for i in range(200)]
    bad = [(f"http://free-bets-4u-{i}.example.org/?id={i * 7919}&s=1&t=99&click=1", "block") for i in range(200)]
    labelled = spark.createDataFrame([*good[:150], *bad[:150]], "url string, verdict string")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(good[150:] + bad[150:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, [], labelled).collect()}
    assert got == {i: v for i, (_, v) in enumerate(good[150:] + bad[150:])}


def test_a_suffix_labelled_in_one_way_tells_nothing(spark):
    """Of two suffixes with one label each, urls without a label are judged by what their own look is."""
    look = {"allow": "https://shop{}.example.{}/item/{}", "block": "http://free-bets-4u-{}.example.{}/?id={}9731&s=1&t=99&click=1"}
    told = [(look["allow"].format(i, "org", i), "allow") for i in range(150)] + [(look["block"].format(i, "net", i), "block") for i in range(150)]
    told += [(look[v].format(i, "info", i), v) for i in range(150) for v in look]
    asked = [(k, look[v].format(1000 + i, s, i)) for k, (v, s, i) in enumerate((v, s, i) for v in look for s in ("org", "net", "info") for i in range(10))]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(asked, "page_id long, url string"), [], spark.createDataFrame(told, "url string, verdict string")).collect()}
    assert [got[k] for k, _ in asked] == ["allow"] * 30 + ["block"] * 30


def test_one_class_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    one = spark.createDataFrame([("http://b.org/", "block")], "url string, verdict string")
    assert U.judge(pages, U.RULES, one).first().verdict == "block" and U.judge(pages).first().verdict == "allow"
    assert U.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("case", ["hot", "rare"])
def test_learns_both_classes_of_skewed_labels(spark, case):
    from pyspark.sql import functions as F

    good = [f"https://shop{i % 7}.example.org/item/{i}" for i in range(200)]
    bad = [f"http://free-bets-4u-{i}.example.org/?id={i * 7919}&s=1&t=99&click=1" for i in range(200)]
    told = spark.createDataFrame([*((u, 0.0) for u in good), *((u, 1.0) for u in bad)], "url string, label double")
    by_hash = [(r.url, r.label) for r in told.orderBy(F.xxhash64("url", "label")).collect()]
    allow, block = ([u for u, y in by_hash if y == k] for k in (0.0, 1.0))
    if case == "hot":  # copies of one url fill the rows of least hash
        rows = [*allow[:100], *allow[:1] * 100], [u for u in block if by_hash.index((u, 1.0)) > by_hash.index((allow[0], 0.0))][:100]
    else:  # the three of greatest hash
        rows = allow[:100], block[-3:]
    labelled = spark.createDataFrame([*((u, "allow") for u in rows[0]), *((u, "block") for u in rows[1])], "url string, verdict string")
    pages = spark.createDataFrame([(0, allow[-1]), (1, bad[0] + "&x=1")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.score) for r in U.judge(pages, [], labelled, max_train=40).collect()}
    assert got[0][0] == "allow" and got[1][0] == "block" and got[0][1] < got[1][1]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    plan = U.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_features(spark):
    host, path = "a-b.com", "/p/q"
    df = spark.createDataFrame([("http://a-b.com/p/q?x=12&y=3", host, path)], "url string, host string, path string")
    from pyspark.sql import functions as F

    r = df.select(*[v.alias(k) for k, v in U.lexical(F.col("url"), F.col("host"), F.col("path")).items()]).first()
    assert (r.n_url, r.n_host, r.n_path, r.host_depth, r.path_depth, r.params, r.hyphens, r.longest_label) == (27, 7, 4, 1, 2, 2, 1, 3) and abs(r.digits - 3 / 27) < 1e-9
    import math
    from collections import Counter

    assert abs(r.entropy + sum(n / 27 * math.log2(n / 27) for n in Counter("http://a-b.com/p/q?x=12&y=3").values())) < 1e-9
