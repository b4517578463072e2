"""Benchmark decontamination by winnowing.

Every text is read as words (see ``text``). For each window of ``WINDOW`` neighbouring k-grams
the least hash is kept; a span of K + WINDOW - 1 = SPAN words that two texts share holds such a
minimum in both. Document minima meet the benchmark's, and each meeting is extended to the left
and right over word hashes; where SPAN words agree, the benchmark window occurs.

Items of fewer words than SPAN are one window of their own length. No k-gram minimum is
guaranteed for them, so they are looked up by the hash of all their words.

The benchmark's index goes to every task while it is smaller than ``max_index_bytes``; each
document is then settled where it is read, with no shuffle. A larger benchmark meets the
documents' fingerprints in a shuffled join instead, and the windows around those that meet are compared.

Defined results: null, empty and wordless texts have no words and no hits; an item without
words, or with a null id or text, occurs nowhere; repeated items count by item_id, once; rows
of the documents that repeat give repeated rows; a very long text is expanded alone, in memory of some times its
size; other columns of both tables are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .frames import cut, hot_join, map_arrow

SPAN, K = 8, 5
WINDOW = SPAN - K + 1
REACH = SPAN - K
#: Above this the benchmark isn't sent to every task.
MAX_INDEX_BYTES = 64 << 20
#: Bits, at most, of the filter of fingerprints that is sent instead; what it lets through wrongly the join takes out.
FILTER_BITS = 1 << 28

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


@dataclass
class Index:
    """The benchmark: words side by side, its minima sorted by hash, and the short items by length."""

    words: np.ndarray
    low: np.ndarray
    high: np.ndarray
    item: np.ndarray
    key: np.ndarray
    at: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.words, self.low, self.high, self.item, self.key, self.at)) + sum(a.nbytes + b.nbytes for a, b in self.short.values())


def index(items: list[tuple[int, str]]) -> Index:
    """The index of the benchmark's (item_id, text) rows."""
    items = [(i, t) for i, t in items if i is not None and t is not None]
    ids, column = np.array([i for i, _ in items], np.int64), pa.array([t for _, t in items], pa.large_string())
    parts = [(c.low, T.words(c)) for c in T.chunks(column)]
    words = np.concatenate([w.hash for _, w in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([w.counts for _, w in parts]) if parts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), counts)
    at, key = _minima(words, first)
    order = np.argsort(key, kind="stable")
    short = {}
    for m in range(1, SPAN):
        use = np.flatnonzero(counts == m)
        if len(use):
            h = T.grams(words, m)[first[use]]
            by = np.argsort(h, kind="stable")
            short[m] = (h[by], ids[use][by])
    return Index(words, first[row], first[row + 1] if len(row) else first[row], ids[row] if len(row) else np.zeros(0, np.int64), key[order], at[order], short)


def _minima(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that winnowing keeps."""
    key = T.grams(words, K)
    ok = T.whole(first, len(words), SPAN)
    if not len(key) or not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = key[: len(words) - SPAN + 1].copy()
    for j in range(1, WINDOW):
        np.minimum(least, key[j : j + len(least)], out=least)
    keep = np.zeros(len(key), bool)
    for j in range(WINDOW):
        keep[j : j + len(least)] |= ok[: len(least)] & (key[j : j + len(least)] == least)
    at = np.flatnonzero(keep)
    return at, key[at]


def _meet(key: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with wanted[i] == key[j]; key is sorted."""
    low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
    n = high - low
    i = np.repeat(np.arange(len(wanted)), n)
    return i, np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else i


def occurrences(words: T.Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words from a to b in which a window of an item occurs: (a, b, item_id)."""
    first, n = words.first, len(words.hash)
    row = words.row()
    found = []
    if len(index.key):
        at, key = _minima(words.hash, first)
        near = np.flatnonzero(np.isin(key, index.key))
        i, j = _meet(index.key, key[near])
        p, q = at[near[i]], index.at[j]
        left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        going_left, going_right = np.ones(len(p), bool), np.ones(len(p), bool)
        d_low, d_high = first[row[p]], first[row[p] + 1]
        for s in range(1, REACH + 1):
            going_left &= (p - s >= d_low) & (q - s >= index.low[q])
            going_left[going_left] = words.hash[p[going_left] - s] == index.words[q[going_left] - s]
            left += going_left
            e = K + s - 1
            going_right &= (p + e < d_high) & (q + e < index.high[q])
            going_right[going_right] = words.hash[p[going_right] + e] == index.words[q[going_right] + e]
            right += going_right
        ok = left + K + right >= SPAN
        found.append((p[ok] - left[ok], p[ok] + K + right[ok], index.item[q[ok]]))
    for m, (key, ids) in index.short.items():
        if n < m:
            continue
        at = np.flatnonzero(T.whole(first, n, m)[: n - m + 1])
        own = T.grams(words.hash, m)[at]
        near = np.flatnonzero(np.isin(own, key))
        i, j = _meet(key, own[near])
        p = at[near[i]]
        found.append((p, p + m, ids[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _covered(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    return np.cumsum(step[:-1]) > 0


def _digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


_NONE = _digest([])


def _settled(ids: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, pairs: list[tuple[int, list[int]]], min_items: int) -> pa.RecordBatch:
    n_items, digest = np.zeros(len(ids), np.int64), [_NONE] * len(ids)
    for r, items in pairs:
        n_items[r], digest[r] = len(items), _digest(items)
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(n_items >= min_items)], schema=_SCHEMA)


def _by_row(row: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    pairs = np.unique(np.stack([row, item], 1), axis=0)
    cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
    for part in np.split(pairs, cuts) if len(pairs) else []:
        yield int(part[0, 0]), part[:, 1].tolist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_items: int = 2, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """Per document its words, the words in windows of the benchmark, and the items they are of.

    docs needs doc_id and text, benchmark item_id and text.
    """
    docs, items = docs.select(F.col("doc_id").cast("long"), "text"), benchmark.select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if 16 * size > max_index_bytes:  # a word of index is 8 bytes of hash and some 30 of places for about 5 of text, a minimum 16
        return _by_join(docs, items, min_items)
    shared = docs.sparkSession.sparkContext.broadcast(index([tuple(r) for r in items.collect()]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batch.column("text")):
            w = T.words(c)
            a, b, item = occurrences(w, shared.value)
            hit = np.concatenate([[0], np.cumsum(_covered(a, b, len(w.hash)))]).astype(np.int64)
            row = np.searchsorted(w.first, a, "right") - 1
            yield _settled(batch.column("doc_id").slice(c.low, c.high - c.low), w.counts.astype(np.int64), np.diff(hit[w.first]), list(_by_row(row, item)), min_items)

    return map_arrow(docs, run, _DDL)


def reject(docs: DataFrame, benchmark: DataFrame, *, min_items: int = 1, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """The documents, with all their columns, in which windows of fewer than min_items items occur."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if 16 * size > max_index_bytes:
        k, k2 = _keys(F.col("doc_id").cast("long"))
        hit = _spans(docs.select(k.alias("k"), k2.alias("k2"), "text"), items).where(F.size("items") >= min_items).select(F.col("k").alias("_key"), F.col("k2").alias("_key2"))
        return docs.withColumns({"_key": k, "_key2": k2}).join(hit, ["_key", "_key2"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(index([tuple(r) for r in items.collect()]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batch.column("text")):
            w = T.words(c)
            a, _, item = occurrences(w, shared.value)
            n = np.zeros(c.high - c.low, np.int64)
            for r, found in _by_row(np.searchsorted(w.first, a, "right") - 1, item):
                n[r] = len(found)
            yield batch.slice(c.low, c.high - c.low).filter(pa.array(n < min_items))

    return map_arrow(docs, run, docs.schema)


def _keys(doc_id: Column) -> tuple[Column, Column]:
    return F.xxhash64(doc_id, "text"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))


_RUNS = "id long, k2 long, key long, m int, runs array<struct<start int, window long>>"


def _bits(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter of ``size`` bits, a power of two, that a key sets."""
    h = T.mix(key.view(np.uint64))
    return (h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def _filter(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the keys: bytes, and the number of bits, which is at most FILTER_BITS however many keys there are."""
    n = keys.count()
    size = min(FILTER_BITS, 1 << max(10, (16 * n).bit_length()))

    def set_(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = np.concatenate(_bits(batch.column("key").to_numpy(), size))
        yield pa.RecordBatch.from_pydict({"word": pa.array(at >> 6), "mask": pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))})

    words = map_arrow(keys.select("key"), set_, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.view(np.uint64), size


def _passes(key: np.ndarray, found: tuple[np.ndarray, int]) -> np.ndarray:
    has = lambda at: (found[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    a, b = _bits(key, found[1])
    return has(a) & has(b)


def _fingerprints(batch: pa.RecordBatch, short: list[int] | None, known: tuple[np.ndarray, int] | None = None) -> Iterator[pa.RecordBatch]:
    """The k-grams that winnowing selects, and of the windows that selected each the place and hash. A span of m words, for
    the lengths in ``short``, is its own fingerprint; None: of texts of fewer words than SPAN the whole. known: a filter of keys."""
    for c in T.chunks(batch.column("text")):
        w = T.words(c)
        n, row = len(w.hash), w.row()
        key = T.grams(w.hash, K)
        at = np.flatnonzero(T.whole(w.first, n, SPAN))
        best = at.copy()
        for j in range(1, WINDOW):
            best = np.where(key[at + j] < key[best], at + j, best) if len(at) else best
        found = [(best, key, at, T.grams(w.hash, SPAN), SPAN)]
        for m in range(1, SPAN) if short is None else short:
            p = np.flatnonzero(T.whole(w.first, n, m)[: max(0, n - m + 1)])
            if short is None:
                p = p[w.counts[row[p]] == m]
            own = T.grams(w.hash, m)
            found.append((p, own, p, T.mix(own), m))
        ids = [batch.column(x).slice(c.low, c.high - c.low) for x in ("k", "k2")]
        for best, key, at, window, m in found:
            if known is not None and len(at):
                use = _passes(key[best], known)
                best, at = best[use], at[use]
            if not len(at):
                continue
            order = np.argsort(best, kind="stable")
            best, at = best[order], at[order]
            cuts = np.flatnonzero(np.diff(best, prepend=-1))
            r = row[best[cuts]]
            runs = pa.StructArray.from_arrays([pa.array((at - w.first[row[at]]).astype(np.int32)), pa.array(window[at].view(np.int64))], ["start", "window"])
            yield pa.RecordBatch.from_pydict({"id": ids[0].take(pa.array(r)), "k2": ids[1].take(pa.array(r)), "key": pa.array(key[best[cuts]].view(np.int64)), "m": pa.array(np.full(len(r), m, np.int32)), "runs": pa.ListArray.from_arrays(pa.array(np.append(cuts, len(at)).astype(np.int32)), runs)})


def _spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(k, k2, items, spans) of the documents (k, k2, text) in which windows of items occur.

    A filter of the benchmark's fingerprints, of bounded size, goes to all tasks, and the documents' fingerprints that pass
    it meet the benchmark's, each as often as it comes; then the windows around those
    that are left meet the benchmark's windows, whose items are one row. So a k-gram that is common on both sides
    multiplies nothing, and fingerprints and windows of very many documents stay where they are.
    """
    marked = items.where("item_id is not null and text is not null").select(F.col("item_id").alias("k"), F.lit(0).cast("long").alias("k2"), "text")
    tests = map_arrow(marked, lambda b: _fingerprints(b, None), _RUNS).select("id", "key", "m", F.explode("runs").alias("r"))
    tests = cut(tests.groupBy("key", "m", F.col("r.window").alias("window")).agg(F.collect_set("id").alias("items")))
    keys = tests.select("key", "m").distinct()
    short = sorted(r["m"] for r in tests.select("m").distinct().collect() if r["m"] < SPAN)  # at most SPAN - 1 numbers
    known = docs.sparkSession.sparkContext.broadcast(_filter(keys))
    places = cut(map_arrow(docs, lambda b: _fingerprints(b, short, known.value), _RUNS))
    seen = cut(places.groupBy("key", "m").agg(F.count(F.lit(1)).alias("n")).join(keys, ["key", "m"]))
    met = hot_join(places, seen, ["key", "m"], "n").select("id", "k2", "key", "m", F.explode("runs").alias("r"))
    met = cut(met.select("id", "k2", "key", "m", "r.start", "r.window"))
    names = ["key", "m", "window"]
    alike = cut(met.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).join(tests, names))
    hits = hot_join(met, alike, names, "n").select(F.col("id").alias("k"), "k2", "start", "m", "items")
    # copies of a row find the same
    return hits.groupBy("k", "k2").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.collect_set(F.struct("start", "m")).alias("spans"))


def _by_join(docs: DataFrame, items: DataFrame, min_items: int) -> DataFrame:
    """As decontaminate, with fingerprints joined in a shuffle."""
    k, k2 = _keys(F.col("doc_id"))
    docs = docs.withColumns({"k": k, "k2": k2})
    spans = _spans(docs.select("k", "k2", "text"), items)

    def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batch.column("text")):
            w = T.words(c)
            rows = batch.slice(c.low, c.high - c.low)
            hits, pairs = np.zeros(len(rows), np.int64), []
            found = rows.column("spans")
            for r in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist():
                start, m = (found[r].values.field(x).to_numpy().astype(np.int64) for x in ("start", "m"))
                hits[r] = _covered(start, start + m, int(w.counts[r])).sum()
                pairs.append((r, rows.column("items")[r].as_py()))
            yield _settled(rows.column("doc_id"), w.counts.astype(np.int64), hits, pairs, min_items)

    return map_arrow(docs.join(spans, ["k", "k2"], "left"), settle, _DDL)
