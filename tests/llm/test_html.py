import random

import pytest

from tidemark.llm import html as H

SCHEMA = "page_id long, url string, html string"


def page(title, *paragraphs, nav="<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>More</a></li></ul></nav>", tail="", article="article"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body>{nav}<!-- <p>ad</p> --><div class='ad box-3'>Buy now</div><{article}><h1>{title}</h1>{body}</{article}>{tail}<footer>&copy; us</footer></body></html>"


def texts(spark, rows, **more):
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA + ", n_chars int, host string").repartition(2)
    out = H.main_text(df, **more).collect()
    assert all(r.n_chars == len(r.text) for r in out)
    return {r.page_id: r.text for r in out}


@pytest.mark.parametrize("limit", [H.MAX_WRAPPER_BYTES, -1])
def test_article_text(spark, limit):
    rows = [
        (1, "http://a.com/1", page("One", "First &amp; <b>bold</b>\n  text&nbsp;x.", "Second &lt;p&gt; &eacute;&#233;&#x e9;")),
        (2, "http://a.com/2", page("Two", *[f"Paragraph {i}" for i in range(40)])),
        (3, "http://A.COM/3", page("Three", "Only", tail="<section id='comments'><p>Great post!</p></section><aside><p>Side</p></aside>")),
        (4, "http://a.com/4", page("Four", "x<br>y", "<form><p>Mail</p><input></form>z")[:-30]),
        (5, "http://a.com/5", None), (6, "http://a.com/6", ""), (7, None, page("Seven", "No host")), (8, "http://b.com/", "plain text, no markup"), (9, "http://a.com/2", page("Two", "again")),
        (None, "http://a.com/1", page("Ten", "null id")), (11, "http://c.com/", "<article><p>cut in a tag<p>next</artic"), (12, "http://d.com", "<p>1 < 2 & 3"), (13, "http://e.com/", "<script>never closed"),
    ]
    got = texts(spark, rows, max_wrapper_bytes=limit)
    assert got[1].split("\n")[:2] == ["One", "First & bold text x."] and got[1].split("\n")[2].startswith("Second <p> éé")
    assert got[2] == "\n".join(["Two", *[f"Paragraph {i}" for i in range(40)]])
    assert got[3] == "Three\nOnly" and got[4] == "Four\nx y\nz"
    assert got[5] == got[6] == got[13] == "" and got[7] == "Seven\nNo host" and got[8] == "plain text, no markup" and got[9] == "Two\nagain"
    assert got[None] == "Ten\nnull id" and got[11] == "cut in a tag\nnext" and got[12] == "1 < 2 & 3"


def test_template_text_goes(spark):
    """Without telling names, what all pages of a host share is template; what differs is text."""
    rows = [(i, "http://t.org/x", f"<body><div><p>Welcome to our site</p></div><div><h2>Title {i}</h2><p>Story {i} a.</p><p>Story {i} b.</p></div><div><p>All rights reserved</p></div></body>") for i in range(8)]
    got = texts(spark, rows)
    assert got == {i: f"Title {i}\nStory {i} a.\nStory {i} b." for i in range(8)}
    few = texts(spark, rows[:2])  # two pages are no evidence
    assert few[0].startswith("Welcome")


def test_copies_are_no_evidence(spark):
    rows = [(i, "http://t.org/x", page("Same", "Same text")) for i in range(9)]
    assert set(texts(spark, rows).values()) == {"Same\nSame text"}


def test_lists_of_links_go_where_there_is_no_article(spark):
    rows = [(i, "http://l.org/", f"<body><ul><li><a href=1>Some link {i}</a></li><li><a>Other {i}</a></li></ul><p>Text {i} with <a href=2>a link</a> in it.</p><ul><li>A point {i}</li></ul></body>") for i in range(7)]
    assert texts(spark, rows)[3] == "Text 3 with a link in it.\nA point 3"


def test_text_of_a_group_that_one_page_has_stays(spark):
    group = "<h2>Note</h2><p>First.</p><h2>Note</h2><p>Second.</p>"
    rows = [(i, "http://g.org/x", f"<body><article>{group if i == 0 else f'<p>Story {i}.</p><p>More of {i}.</p>'}</article></body>") for i in range(6)]
    assert texts(spark, rows) == {0: "Note\nFirst.\nNote\nSecond."} | {i: f"Story {i}.\nMore of {i}." for i in range(1, 6)}
    rows = [(i, "http://g.org/x", f"<body><article><dl><dt>Label</dt><dd>a {i}</dd><dt>Label</dt><dd>b {i}</dd></dl></article></body>") for i in range(6)]
    assert texts(spark, rows)[3] == "a 3\nb 3"  # a group that all pages have is template


def test_only_the_template_text_itself_goes():
    one = H.wrapper(H.tree("<article><h1>Welcome</h1><p>x</p></article>"))
    assert H.extract(H.tree("<article><h1>Welcome</h1><p>x</p></article>"), one, 6) == ""
    assert H.extract(H.tree("<article><h1>Another</h1><p>x</p></article>"), one, 6) == "Another"


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def opaque(i, r):
    """A page whose names tell nothing, and its article."""
    word = lambda n: " ".join(r.choice("alpha beta gamma delta omega sigma kappa lambda".split()) + str(r.randrange(99)) for _ in range(n))
    title, body = f"On {word(4)}", [word(r.randrange(12, 40)) for _ in range(r.randrange(2, 6))]
    links = "".join(f"<div><a href='/{word(1)}'>{word(2)}</a></div>" for _ in range(r.randrange(3, 7)))
    inner = [f"<p>{p}</p>" for p in body]
    if r.random() < 0.5:  # a block that only some pages have
        body.insert(1, word(6))
        inner.insert(1, f"<blockquote>{body[1]}</blockquote>")
    extra = f"<div class='k9'><p>{word(5)}</p></div>" if r.random() < 0.6 else ""
    page = f"<html><body><div class='a1'><div>Zeta Daily</div>{links}</div><div class='b2'><p>{word(6)}</p></div><div class='c3'><div class='d4'><h2>{title}</h2>{''.join(inner)}<div>Share this</div></div></div>{extra}<div class='e5'><p>Read more: <a>{word(3)}</a></p><p>{word(2)}</p></div></body></html>"
    return page, "\n".join([title, *body])


def test_the_wrapper_alone_finds_the_article(spark):
    """Neither tags nor classes tell the article. Read by names alone, hardly any page would come out right."""
    r = random.Random(3)
    made = [opaque(i, r) for i in range(60)]
    got = texts(spark, [(i, "http://o.org/x", p) for i, (p, _) in enumerate(made)])
    assert got == {i: t for i, (_, t) in enumerate(made)}
    by_names = [H.extract(H.tree(p), None, 0) for p, _ in made]
    assert sum(a == t for a, (_, t) in zip(by_names, made)) == 0


def test_same_text_however_pages_are_dealt_out(spark):
    r = random.Random(4)
    rows = [(i, f"http://o{i % 3}.org/x", opaque(i, r)[0] if i % 4 else page(f"T{i}", *[f"p {i} {j}" for j in range(i % 5)], tail="<section><p>x</p></section>" * (i % 3))) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = [sorted(map(str, H.main_text(df.repartition(n)).collect())) for n in (1, 7, 200)]
    assert found[0] == found[1] == found[2]
    made = [sorted(map(str, H.wrappers(df.repartition(n).selectExpr("split(url, '/')[2] as host", "html")).collect())) for n in (1, 200)]
    assert made[0] == made[1]


def test_place_by_name_where_mass_leaves_it_open():
    """An article element is followed although a second block holds as much text."""
    pages = [f"<body><main><article><p>story {i} of some length</p></article><div class=x><p>teaser {i} of some length</p></div></main></body>" for i in range(6)]
    whole = H.wrapper(H.tree(pages[0]))
    for p in pages[1:]:
        whole = H.merge(whole, H.wrapper(H.tree(p)))
    assert H.focus(whole, 4) is None and H.focus(whole, 6)[0] == "article"
    assert H.extract(H.tree(pages[2]), whole, 6, H.focus(whole, 6)) == "story 2 of some length"
    other = "<body><p>no such place, but text</p></body>"
    assert H.extract(H.tree(other), whole, 6, H.focus(whole, 6)) == "no such place, but text"


def test_long_rows_match_as_far_as_they_can():
    names = [f"n{i % 50}" for i in range(700)]
    assert H.matches(["z", *names], [*names, "z"]) == [(i + 1, i) for i in range(700)]
    r = random.Random(5)
    for k in range(300):
        a, b = ([r.choice("abcde"[: 2 + k % 4]) for _ in range(r.randrange(30))] for _ in "ab")
        want = len(H.matches(a, b))
        for held in (1 << 28, 40, 1):
            got = H.matches(a, b, held)
            assert len(got) == want == subsequence(a, b) and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_repeats_and_options():
    one = H.wrapper(H.tree("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>"))
    assert one[4][0][4][0][0] == "(h2 p)" and one[4][0][4][0][2] == 1
    two = H.merge(one, H.wrapper(H.tree("<div><h2>a</h2><p>b</p><h2>a</h2><p>d</p><blockquote>q</blockquote></div>")))
    group, quote = two[4][0][4]
    assert group[0] == "(h2 p)" and quote[0] == "blockquote" and quote[3] == 1
    assert H.shape(H.merge(two, one)) == H.shape(two)  # what it has seen adds weight only
    a = H.wrapper(H.tree("<p>x</p>"))
    assert H.merge(a, H.wrapper(H.tree("<p>x</p>")))[4][0][4][0][1] != H.SLOT and H.merge(a, H.wrapper(H.tree("<p>y</p>")))[4][0][4][0][1] == H.SLOT


def test_no_rows_and_a_long_page(spark):
    assert H.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
    long = page("Long", *[f"Paragraph number {i} of very many" for i in range(20_000)])
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    got = texts(spark, [(1, "http://a.com", long), (2, "http://b.com", deep), (3, "http://c.com", "<p" * 5000)])
    assert got[1].count("\n") == 20_000 and got[2] == "deep" and got[3] == ""
