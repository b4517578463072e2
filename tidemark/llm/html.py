"""HTML extraction by wrappers: union-free regular expressions inferred from pages of one host.

A page is read as a tree of block elements and texts; inline tags dissolve. Equal neighbours in a
row of children fold into a repeated group, also neighbours in groups of up to four. The pages of
a host are aligned one after another: children that match are merged, those that one side lacks
become optional, a text that differs becomes a slot, one that all pages have alike is template text.
The result is the host's wrapper, a union-free expression over its pages (Crescenzi et al. 2001).

Aligning depends on the order of pages, so the order is fixed by what they are: pages of one shape (the same
expression but for texts) are merged first, in any order, as that gives the same; then a host's shapes are merged in
the order of their hashes, in groups of equal hash modulo SHAPE_GROUPS and then group after group. So the wrapper
doesn't depend on how pages are dealt out, and a host with a third of all pages is a tree of merges: by shape inside
each partition, by shape over partitions (in two steps), by group, and at last SHAPE_GROUPS expressions at most.

The wrapper tells the main text by what it holds: slots. From the root it is followed into the one part that holds
MOST of the varying text outside links of the part around it, as long as that part is a container and comes once; where it
stops is the article's place (``focus``), and what pages have there is the text, without template text and without
lists and tables that consist of links. Names only help: an element called article or main is followed where it holds SOME of the
varying text; what is navigation, header, footer, aside, form, script and the like by name, or by the words of its
class, id or role, holds none. A main heading beside the place that varies belongs to the text.
Hosts with fewer than TEMPLATE_PAGES distinct pages show nothing that way; their pages, and pages without the
place, are read by names alone: the article or main element, or the body.

Wrappers are sent to all tasks while they take less than MAX_WRAPPER_BYTES together; beyond that
they are joined to the pages by host.

Defined results: null and empty pages have an empty text; pages without a host form one host; a
page cut short ends where it is cut, and an unfinished tag at its end is dropped; elements more than MAX_DEPTH deep
dissolve as inline ones do, but end a block; repeated rows give repeated rows; other columns are ignored. A very long
page is held alone, in memory of some times its size.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, map_arrow, map_partitions

MAX_WRAPPER_BYTES = 32 << 20
#: Wrappers that a partition holds before it passes them on.
HELD_SHAPES = 5_000
#: Groups that a host's shapes are merged in, and parts that what partitions have of one shape is merged in first.
SHAPE_GROUPS, PARTS = 1024, 256
#: Distinct pages of a host from which on a text that all pages have alike is template text.
TEMPLATE_PAGES = 5
#: The share of the varying text that a part must hold to be followed, and that an article or main element must.
MOST, SOME = 0.6, 0.25
MAX_DEPTH = 256

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCKS = frozenset("html head body nav header footer aside main article section div form ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption fieldset address details summary menu dialog button select option label hgroup center".split())
_OWN_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = _BLOCKS - {"button", "label", "option", "select"}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_NEVER = frozenset("head nav header footer aside form menu dialog button select option label fieldset".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer comment comments commentlist respond reply replies disqus discussion share sharing social related recommended widget login signup search searchbox pagination pager copyright toolbar skip hidden".split()
)
SLOT = "*"
#: Elements that hold a run of text rather than an article.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption summary address th".split())


def symbol(name: str, attrs: str) -> str:
    """An element's name with the words of its class and role; numbers in them don't tell elements apart. Of an id, which
    tells single elements, only words that say what an element is for."""
    if not attrs or "=" not in attrs:
        return name
    words = set()
    for m in _NAMED.finditer(attrs):
        found = {w.replace(".", "") for w in re.split(r"[\s_\-:]+", re.sub(r"\d+", "", next(x for x in m.groups()[1:] if x is not None)).lower())}
        words |= found & _WORDS if m[1].lower() == "id" else found
    words.discard("")
    return f"{name}.{'.'.join(sorted(words))}" if words else name


def unwanted(sym: str) -> bool:
    name, *words = sym.split(".")
    return name in _NEVER or name not in ("html", "body", "article", "main") and not _WORDS.isdisjoint(words)


def tree(page: str) -> list:
    """[symbol, children]; a child is such a list or a pair (text, characters of it in links)."""
    root: list = ["", []]
    stack, text, linked, in_link, sunk = [root], [], 0, False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                stack[-1][1].append((whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    for m in _TOKEN.finditer(page):
        if (t := m["text"]) is not None:
            text.append(t)
            linked += len(t.strip()) if in_link else 0
        elif m["name"] is not None:
            name = m["name"].lower()
            if name not in _BLOCKS:
                if name == "br" or name == "hr":
                    text.append(" ")
                elif name == "a":
                    in_link = not m["end"]
                continue
            if sunk or not m["end"] and len(stack) > MAX_DEPTH:  # too deep for an element of its own
                sunk = max(0, sunk + (-1 if m["end"] else 1))
                flush()
                continue
            if m["end"]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0].partition(".")[0] == name), 0)
                if depth:
                    close(depth)
                else:
                    flush()
                in_link = False
                continue
            ends = _OWN_END.get(name, set()) | ({"p"} if name in _ENDS_P else set())
            for i in range(len(stack) - 1, 0, -1):
                own = stack[i][0].partition(".")[0]
                if own in ends:
                    close(i)
                    break
                if own in _SCOPE.get(name, ()) or own not in ("p", "b") and name not in _OWN_END:
                    break
            flush()
            node: list = [symbol(name, m["attrs"]), []]
            stack[-1][1].append(node)
            stack.append(node)
    flush()
    return root


# a wrapper: [symbol, text, repeated, optional, children, weight]; a text has the symbol "#", and its length without links as weight


def wrapper(node: list) -> list:
    """The expression of one page."""
    parts = [["#", zlib.crc32(c[0].encode()), 0, 0, [], len(c[0]) - c[1]] if isinstance(c, tuple) else wrapper(c) for c in node[1]]
    return [node[0], None, 0, 0, fold(parts), 0]


def shape(expression: list) -> int:
    """A hash of all but the texts. Expressions of one shape merge part by part, in any order."""

    def write(p: list) -> None:
        out.append(f"{p[0]} {p[2]}{p[3]}(")
        for q in p[4]:
            write(q)
        out.append(")")

    out: list[str] = []
    write(expression)
    return int.from_bytes(hashlib.blake2b("".join(out).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def alike(a: list, b: list) -> bool:
    """Whether neighbours are one repeated part: the same symbol, and children of the same symbols or none."""
    return a[0] == b[0] and (not a[4] or not b[4] or [x[0] for x in a[4]] == [x[0] for x in b[4]])


def fold(parts: list) -> list:
    """Like neighbours, and then groups of two to four that come again at once, as one repeated part."""
    out = _joined(parts)
    for k in (2, 3, 4):
        i, done = 0, []
        while i < len(out):
            j = i + k
            names = [x[0] for x in out[i:j]]
            while j + k <= len(out) and [x[0] for x in out[j : j + k]] == names:
                j += k
            if j > i + k and len(set(names)) > 1:
                group = out[i : i + k]
                for s in range(i + k, j, k):
                    group = [merge(a, b) for a, b in zip(group, out[s : s + k], strict=True)]
                done.append([f"({' '.join(names)})", None, 1, 0, group, 0])
                i = j
            else:
                done.append(out[i])
                i += 1
        out = done
    return out


def _joined(parts: list) -> list:
    out: list = []
    for p in parts:
        if out and alike(out[-1], p):
            out[-1] = merge(out[-1], p)
            out[-1][2] = 1
        else:
            out.append(p)
    return out


def merge(a: list, b: list) -> list:
    text = a[1] if a[1] == b[1] else SLOT
    return [a[0], text, a[2] | b[2], a[3] | b[3], align(a[4], b[4]), a[5] + b[5]]


def _columns(a: list[str], b: list[str]) -> Iterator[int]:
    """For each start of b, in bits: bit i is 0 where a[i] makes the longest common subsequence longer (Hyyro 2004)."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    column = mask = (1 << len(a)) - 1
    for x in b:
        hit = column & where.get(x, 0)
        column = (column + hit | column - hit) & mask
        yield column


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of b and each start of a."""
    column = (1 << len(a)) - 1
    for column in _columns(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(column.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def matches(a: list[str], b: list[str], held: int = 1 << 28) -> list[tuple[int, int]]:
    """A longest common subsequence with at most ``held`` bits kept; beyond that b is halved first (Hirschberg 1975)."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    if low or high:  # what is alike at both ends needs no search
        inner = matches(a[low : len(a) - high], b[low : len(b) - high], held)
        return [*((i, i) for i in range(low)), *((i + low, j + low) for i, j in inner), *((len(a) - k, len(b) - k) for k in range(high, 0, -1))]
    if not a or not b:
        return []
    if len(a) * len(b) > held and len(b) > 1:
        half = len(b) // 2
        k = int(np.argmax(_lengths(a, b[:half]) + _lengths(a[::-1], b[:half - 1 : -1])[::-1]))
        return [*matches(a[:k], b[:half], held), *((i + k, j + half) for i, j in matches(a[k:], b[half:], held))]
    columns = list(_columns(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if columns[j - 1] >> i - 1 & 1:
            i -= 1
        else:
            j -= 1
            if not j or columns[j - 1] >> i - 1 & 1:
                i -= 1
                out.append((i, j))
    return out[::-1]


def align(a: list, b: list) -> list:
    x, y = [p[0] for p in a], [p[0] for p in b]
    if x == y:
        return [merge(p, q) for p, q in zip(a, b, strict=True)]
    out: list = []
    i = j = 0
    for p, q in [*matches(x, y), (len(a), len(b))]:
        out += [[*n[:3], 1, *n[4:]] for n in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold(out)


def _named(part: list) -> bool:
    return part[0].partition(".")[0] in ("article", "main")


def focus(expression: list, pages: int) -> list | None:
    """The part of a wrapper that is the article's place, or None where too few pages tell it."""
    if pages < TEMPLATE_PAGES:
        return None
    masses: dict[int, int] = {}

    def mass(p: list) -> int:
        """How much text of slots a part holds outside links."""
        if p[0] == "#":
            own = p[5] if p[1] == SLOT else 0
        else:
            own = 0 if unwanted(p[0]) else sum(map(mass, p[4]))
        masses[id(p)] = own
        return own

    if not mass(expression):
        return None
    at = expression
    while True:
        inner = [p for p in at[4] if p[0] != "#" and p[0][0] != "(" and not p[2] and p[0].partition(".")[0] not in _TEXTUAL]
        named = [p for p in inner if _named(p) and masses[id(p)] >= SOME * masses[id(at)]]
        best = named[0] if len(named) == 1 else max(inner, key=lambda p: masses[id(p)], default=None)
        if best is None or masses[id(best)] < (SOME if named else MOST) * masses[id(at)] or not masses[id(best)]:
            return at
        at = best


def extract(page: list, expression: list | None, pages: int, place: list | None = None) -> str:
    """The blocks of a page that are at the wrapper's place, joined by line feeds. Without a place, names tell them."""
    out: list[str] = []
    named = place is None and _has_article(page)
    met = False

    def walk(node: list, known: list | None, inside: bool, article: bool, always: bool) -> None:
        nonlocal met
        for child, own in zip(node[1], aligned(node[1], known), strict=True):
            every = always and own is not None and not own[3]  # in all pages of the host
            if isinstance(child, tuple):
                if inside and not (every and own[1] == zlib.crc32(child[0].encode())):
                    out.append(child[0])
            elif not unwanted(child[0]):
                name = child[0].partition(".")[0]
                here = own is place if place is not None else name in ("article", "main")
                met |= here
                if not article and name in ("ul", "ol", "table", "dl") and _links(child):
                    continue
                title = place is not None and name == "h1"
                walk(child, own, inside or here or title, article or name in ("article", "main"), every)

    met = place is expression and place is not None
    walk(page, expression, met or place is None and not named, False, pages >= TEMPLATE_PAGES)
    if place is not None and not met:
        return extract(page, expression, pages)
    return "\n".join(out)


def _has_article(node: list) -> bool:
    return any(not isinstance(c, tuple) and not unwanted(c[0]) and (c[0].partition(".")[0] in ("article", "main") or _has_article(c)) for c in node[1])


def _links(node: list) -> bool:
    def sums(n: list) -> tuple[int, int]:
        a = b = 0
        for c in n[1]:
            x, y = (len(c[0]), c[1]) if isinstance(c, tuple) else sums(c)
            a, b = a + x, b + y
        return a, b

    total, linked = sums(node)
    return total > 0 and 2 * linked >= total


def aligned(children: list, known: list | None) -> list:
    """For each child its part of the expression, or None."""
    if known is None:
        return [None] * len(children)
    # what is in an optional group is optional itself
    flat = [q for p in known[4] for q in ([[*q[:3], q[3] | p[3], *q[4:]] for q in p[4]] if p[0].startswith("(") else [p])]
    by_name: dict[str, list] = {}
    for q in flat:
        by_name.setdefault(q[0], []).append(q)
    names = ["#" if isinstance(c, tuple) else c[0] for c in children]
    if all(len(v) == 1 for v in by_name.values()):
        return [by_name.get(n, [None])[0] for n in names]
    # several parts of one symbol: runs of like children are matched with parts in order
    shapes = [None if isinstance(c, tuple) else wrapper(c) for c in children]
    heads = [i for i in range(len(names)) if not i or names[i] != names[i - 1] or shapes[i] is not None and not alike(shapes[i - 1], shapes[i])]
    runs = [names[i] for i in heads]
    parts = [q[0] for q in flat]
    pairs = {i: i for i in range(len(runs))} if runs == parts else dict(matches(runs, parts))
    of: list = [None] * len(names)
    for k, i in enumerate(heads):
        part = flat[pairs[k]] if k in pairs else None
        for j in range(i, heads[k + 1] if k + 1 < len(heads) else len(names)):
            of[j] = part
    return of


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An expression of each shape that a host's pages in a partition have, with marks of distinct pages."""
    held: dict[tuple[str, int], list] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in held], pa.string()), "at": pa.array([s for _, s in held], pa.int64()), "wrapper": pa.array([json.dumps(w) for w, _ in held.values()], pa.string()), "pages": pa.array([p for _, p in held.values()], pa.list_(pa.int64()))})

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not page:
                continue
            own, mark = wrapper(tree(page)), zlib.crc32(page.encode("utf-8", "replace"))
            key = (host, shape(own))
            if key in held:
                kept = held[key]
                kept[0], kept[1] = merge(kept[0], own), _marks(kept[1], [mark])
                continue
            held[key] = [own, [mark]]
            if len(held) >= HELD_SHAPES:
                yield out()
                held.clear()
    yield out()


def _marks(a: list[int], b: list[int]) -> list[int]:
    """As many marks of distinct pages as matter; which ones doesn't depend on the order."""
    return sorted({*a, *b})[:TEMPLATE_PAGES]


def _combine(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    made, pages = [], []
    for found in batch.column("found").to_pylist():
        own = sorted(found, key=lambda x: (x["at"], x["wrapper"]))
        whole, marks = json.loads(own[0]["wrapper"]), own[0]["pages"]
        for x in own[1:]:
            whole, marks = merge(whole, json.loads(x["wrapper"])), _marks(marks, x["pages"])
        made.append(json.dumps(whole))
        pages.append(marks)
    names = [n for n in batch.schema.names if n != "found"]
    yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(made, pa.string()), pa.array(pages, pa.list_(pa.int64()))], [*names, "wrapper", "pages"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, n_pages) of pages (host, html)."""
    some = map_partitions(pages.select("host", "html"), _infer, "host string, at bigint, wrapper string, pages array<bigint>")
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    group = F.pmod("at", F.lit(SHAPE_GROUPS)).alias("at")
    for keys in ([F.col("at"), part], [F.col("at")], [group], []):
        names = [c for c, use in (("host", True), ("at", keys), ("part", len(keys) > 1)) if use]
        grouped = some.groupBy("host", *keys).agg(F.collect_list(F.struct("at", "wrapper", "pages")).alias("found"))
        ddl = ", ".join(f"{c} {t}" for c, t in (("host", "string"), ("at", "bigint"), ("part", "int")) if c in names)
        some = map_arrow(grouped, _combine, f"{ddl}, wrapper string, pages array<bigint>")
    return some.select("host", "wrapper", F.size("pages").alias("n_pages"))


_OUT = "page_id long, url string, text string, n_chars long"


def _rows(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def main_text(pages: DataFrame, *, max_wrapper_bytes: int = MAX_WRAPPER_BYTES) -> DataFrame:
    """Per page (page_id, url, text, n_chars) of pages (page_id, url, html)."""
    from .urls import parts

    host = parts(F.col("url"))[0]
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    known = cut(wrappers(rows))
    size = known.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    small = size <= max_wrapper_bytes
    shared = rows.sparkSession.sparkContext.broadcast({r["host"]: (r["wrapper"], r["n_pages"]) for r in known.collect()} if small else {})

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        read: dict[str, tuple] = {}
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            texts = []
            own = [shared.value.get(h, (None, 0)) for h in part.column("host").to_pylist()] if small else zip(part.column("wrapper").to_pylist(), part.column("n_pages").to_pylist(), strict=True)
            for page, (code, n) in zip(part.column("html").to_pylist(), own, strict=True):
                if code not in read:
                    if len(read) > 1000:
                        read.clear()
                    expression = json.loads(code) if code else None
                    read[code] = expression, focus(expression, n) if code else None
                expression, place = read[code]
                texts.append(extract(tree(page), expression, n or 0, place) if page else "")
            yield _rows(part, texts)

    return map_arrow(rows if small else rows.join(known, "host", "left"), run, _OUT)
