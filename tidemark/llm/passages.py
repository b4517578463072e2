"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at content-selected places: in each span of LENGTH words the anchor is the
place whose 8-word gram has the least hash among the first LENGTH - LEAD + 1 (a minimiser), so
equal spans have their anchor at the same place and LEAD words of the span follow it. Kept
suffixes are range-sorted by the hash of their first LEAD words, and neighbours in that order
compared: a suffix without an equal neighbour starts no repeated span and is dropped. The matches
that are left are extended to the left and right: every span of LENGTH words that has its anchor there is
compared, by hash, with those of its neighbours. Overlapping spans of a document add up.

Wholly equal texts are collapsed first and given the same answer, so a group of copies costs one
text; suffixes of one text with equal leads are one row; a lead that more than HOT_ROWS texts share
is dealt out by its spans, summed before the shuffle. Result: one row per maximal repeated passage: doc_id, start_word, n_words, first_doc_id and
last_doc_id of the documents whose spans inside it are equal, n_places (of the span that occurs
most), and is_first where the document is the first (by doc_id, then place) to have the passage's
opening span. Documents without a repeated span of LENGTH words have no row.

Defined results: null, empty and short texts have no row; rows with a null doc_id are left out;
rows of one doc_id and the same text are copies of each other; rows of one doc_id with different
texts are compared like other documents; very long texts are expanded alone, in memory of some times their size; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .frames import cut, map_arrow, map_partitions, split_join

LENGTH, LEAD, GRAM = 50, 25, 8
#: Texts that share a lead above which it is split over tasks, and hot leads that are sent to all tasks.
HOT_ROWS, MAX_BROADCAST_ROWS = 50_000, 100_000
#: Windows that one sorting step holds, in whole groups of equal suffixes.
HELD = 1 << 20


def anchors(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, place of the anchor) of each span of LENGTH words in one row."""
    n = len(w.hash)
    at = np.flatnonzero(T.whole(w.first, n, LENGTH))
    if not len(at):
        return at, at
    key = T.grams(w.hash, GRAM)
    # the least hash, and of equal ones the first: a sliding minimum by doubling over (hash, place)
    width = LENGTH - LEAD + 1
    best = np.arange(len(key))
    span = 1
    while span * 2 <= width:
        best = _lesser(key, best[: len(best) - span], best[span:])
        span *= 2
    rest = width - span
    if rest:
        best = _lesser(key, best[: len(best) - rest], best[rest:])
    return at, best[at]


def _lesser(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(key[b] < key[a], b, a)


def _text_hash(c: T.Chunk) -> np.ndarray:
    return T.mix(T.span_hash(T._BYTE[c.data], c.bounds[:-1], c.bounds[1:])).view(np.int64)


def _suffixes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Per document: a hash of its text, its number of words, and the leads of its kept suffixes, each once, with whether it comes again."""
    for c in T.chunks(batch.column("text")):
        w = T.words(c)
        _, place = anchors(w)
        place = np.unique(place)
        lead = T.grams(w.hash, LEAD)[place].view(np.int64) if len(place) else np.zeros(0, np.int64)
        row = np.searchsorted(w.first, place, "right") - 1
        order = np.lexsort((lead, row))
        row, lead = row[order], lead[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (lead[1:] != lead[:-1])]) if len(row) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        again = np.diff(np.append(at, len(row))) > 1
        cuts = np.searchsorted(row[at], np.arange(c.high - c.low + 1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(c.low, c.high - c.low), "text_hash": pa.array(_text_hash(c)), "n_words": pa.array(w.counts.astype(np.int32)), "leads": pa.ListArray.from_arrays(cuts, pa.array(lead[at])), "again": pa.ListArray.from_arrays(cuts, pa.array(again))})


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by lead, those with an equal neighbour, those that come again in their own text, and both ends of a range,
    whose neighbours are in other ranges."""
    held = None  # the last row, not yet given out, and whether it is kept already

    def give(lead: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"text_hash": pa.array(text, pa.int64()), "lead": pa.array(lead, pa.int64())})

    for batch in batches:
        if not batch.num_rows:
            continue
        lead, text = batch.column("lead").to_numpy(), batch.column("text_hash").to_numpy()
        keep = batch.column("again").to_numpy(zero_copy_only=False).astype(bool)
        same = lead[1:] == lead[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        if held is None:
            keep[0] = True
        else:
            joined = held[0] == lead[0]
            keep[0] |= joined
            if joined or held[2]:
                yield give(np.array([held[0]]), np.array([held[1]]))
        yield give(lead[:-1][keep[:-1]], text[:-1][keep[:-1]])
        held = (lead[-1], text[-1], bool(keep[-1]))
    if held is not None:
        yield give(np.array([held[0]]), np.array([held[1]]))


def _spans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For every suffix that is left: the places and hashes of the spans that have it as their anchor."""
    for c in T.chunks(batch.column("text")):
        rows = batch.slice(c.low, c.high - c.low)
        w = T.words(c)
        start, place = anchors(w)
        if not len(start):
            continue
        row = np.searchsorted(w.first, start, "right") - 1
        lead = T.grams(w.hash, LEAD)[place].view(np.int64)
        left = rows.column("left")
        wanted, often = left.flatten().field("lead").to_numpy(), left.flatten().field("hot").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(rows)), pa.compute.list_value_length(left).to_numpy())
        text = _text_hash(c)
        good = text == rows.column("text_hash").to_numpy()
        # a pair of row and lead as one number, so that one search finds it
        pair = lambda r, x: T.mix(x.view(np.uint64) ^ T.mix(r.astype(np.uint64)))
        known = pair(owner, wanted)
        order = np.argsort(known)
        known, often = known[order], often[order]
        own = pair(row, lead)
        at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        use = np.flatnonzero((known[at] == own) & good[row]) if len(known) else np.zeros(0, np.int64)
        if not len(use):
            continue
        order = use[np.lexsort((start[use], lead[use], row[use]))]
        row, lead, start, hot = row[order], lead[order], start[order], often[at[order]]
        span = T.grams(w.hash, LENGTH)[start]
        cuts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (lead[1:] != lead[:-1])]))
        offsets = np.append(cuts, len(row)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"lead": pa.array(lead[cuts]), "hot": pa.array(hot[cuts].astype(bool)), "text_hash": pa.array(text[row[cuts]]), "starts": pa.ListArray.from_arrays(offsets, pa.array((start - w.first[row]).astype(np.int32))), "spans": pa.ListArray.from_arrays(offsets, pa.array(span.view(np.int64)))})


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by lead: runs of spans that occur elsewhere too, with the first and last document that has them."""

    def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        spans = table.column("spans").combine_chunks()
        span = spans.flatten().to_numpy().view(np.uint64)
        start = table.column("starts").combine_chunks().flatten().to_numpy()
        owner = np.repeat(np.arange(len(spans)), pa.compute.list_value_length(spans).to_numpy())
        text = table.column("text_hash").to_numpy()
        low, high, copies = (table.column(k).to_numpy()[owner] for k in ("low", "high", "copies"))
        order = np.lexsort((start, text[owner], low, span))
        new = np.diff(span[order], prepend=span[order][:1] ^ np.uint64(1)) != 0
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        n = np.add.reduceat(copies[order], heads)[group]
        first, last = np.minimum.reduceat(low[order], heads)[group], np.maximum.reduceat(high[order], heads)[group]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        n, first, last, lead = n[back], first[back], last[back], new[back]
        at = np.flatnonzero(n > 1)
        if not len(at):
            return
        joint = (np.diff(start[at]) == 1) & (np.diff(owner[at]) == 0)
        cuts = np.flatnonzero(np.concatenate([[True], ~joint]))
        a, b = at[cuts], at[np.append(cuts[1:] - 1, len(at) - 1)]
        yield pa.RecordBatch.from_pydict({"text_hash": pa.array(text[owner[a]]), "a": pa.array(start[a].astype(np.int32)), "b": pa.array((start[b] + LENGTH).astype(np.int32)), "first_doc_id": pa.array(np.minimum.reduceat(first[at], cuts)), "last_doc_id": pa.array(np.maximum.reduceat(last[at], cuts)), "n": pa.array(np.maximum.reduceat(n[at], cuts)), "leads": pa.array(lead[a])})

    parts, held = [], 0
    for batch in batches:
        while batch.num_rows:
            lead = batch.column("lead").to_numpy()
            if held >= HELD:  # up to the end of the group
                other = np.flatnonzero(lead != parts[-1].column("lead")[-1].as_py())
                stop = int(other[0]) if len(other) else len(lead)
                if stop:
                    parts.append(batch.slice(0, stop))
                if len(other):
                    yield from settle(parts)
                    parts, held = [], 0
                batch = batch.slice(stop)
            else:
                take = batch.slice(0, 4096)
                parts.append(take)
                held += len(take.column("spans").flatten())
                batch = batch.slice(4096)
    if parts:
        yield from settle(parts)


_SPAN = "text_hash long, a int, b int, first_doc_id long, last_doc_id long, n long, leads boolean"


def _merge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Overlapping spans of one document added up."""
    found = batch.column("found")
    flat = found.flatten()
    a, b, low, high, n, leads = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "first_doc_id", "last_doc_id", "n", "leads"))
    owner = np.repeat(np.arange(len(found)), pa.compute.list_value_length(found).to_numpy())
    order = np.lexsort((b, a, owner))
    a, b, low, high, n, leads, owner = (x[order] for x in (a.astype(np.int64), b.astype(np.int64), low, high, n, leads, owner))
    # how far the spans before reach: rows are kept apart by more than any place
    apart = owner * (int(b.max(initial=0)) + 2)
    reach = np.maximum.accumulate(apart + b)
    head = np.concatenate([[True], (owner[1:] != owner[:-1]) | (apart[1:] + a[1:] > reach[:-1])])[: len(a)]
    at = np.flatnonzero(head)
    if not len(at):
        return
    last = np.append(at[1:], len(a)) - 1
    columns = {
        "text_hash": batch.column("text_hash").take(pa.array(owner[at])), "a": pa.array(a[at].astype(np.int32)), "b": pa.array((reach[last] - apart[last]).astype(np.int32)),
        "first_doc_id": pa.array(np.minimum.reduceat(low, at)), "last_doc_id": pa.array(np.maximum.reduceat(high, at)), "n": pa.array(np.maximum.reduceat(n, at)), "leads": pa.array(leads[at].astype(bool)),
    }
    yield pa.RecordBatch.from_pydict(columns)


def repeated_passages(docs: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The passages of LENGTH or more words of docs (doc_id, text) that occur more than once."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    rows = cut(map_arrow(docs, _suffixes, "doc_id long, text_hash long, n_words int, leads array<bigint>, again array<boolean>").where(F.col("n_words") >= LENGTH))
    texts = cut(rows.groupBy("text_hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words")))
    # copies of a text are told by min(doc_id), so its suffixes come from that row alone
    own = rows.join(texts.select("text_hash", F.col("low").alias("doc_id")), ["text_hash", "doc_id"]).dropDuplicates(["text_hash"])
    suffixes = own.select("text_hash", F.explode(F.arrays_zip(F.col("leads").alias("lead"), F.col("again").alias("again"))).alias("s")).select("text_hash", "s.lead", "s.again")
    # ranges of (lead, text), so that a lead of very many texts is several ranges
    left = cut(map_partitions(suffixes.repartitionByRange("lead", "text_hash").sortWithinPartitions("lead", "text_hash"), _neighbours, "text_hash long, lead long"))
    hot = cut(left.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("lead", F.lit(True).alias("hot")))
    few = hot.count() <= MAX_BROADCAST_ROWS
    left = left.join(F.broadcast(hot) if few else hot, "lead", "left").groupBy("text_hash").agg(F.collect_list(F.struct("lead", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("left"))
    left = left.join(texts.select("text_hash", F.col("low").alias("doc_id")), "text_hash")
    spans = map_arrow(docs.join(left, "doc_id").select("text_hash", "left", "text"), _spans, "lead long, hot boolean, text_hash long, starts array<int>, spans array<bigint>")
    spans = spans.dropDuplicates(["text_hash", "lead"]).join(texts.select("text_hash", "low", "high", "copies"), "text_hash")
    if not few or hot.limit(1).count():
        spans = cut(spans)
    found = map_partitions(spans.where("not hot").drop("hot").repartition("lead").sortWithinPartitions("lead"), _extend, _SPAN)
    if not few or hot.limit(1).count():
        found = found.unionByName(_extend_hot(spans.where("hot")))
    whole = texts.where("copies > 1").select("text_hash", F.lit(0).alias("a"), F.col("n_words").alias("b"), F.col("low").alias("first_doc_id"), F.col("high").alias("last_doc_id"), F.col("copies").alias("n"), F.lit(True).alias("leads"))
    merged = map_arrow(found.unionByName(whole).groupBy("text_hash").agg(F.collect_list(F.struct("a", "b", "first_doc_id", "last_doc_id", "n", "leads")).alias("found")), _merge, _SPAN)
    out = split_join(rows.select("doc_id", "text_hash"), merged.join(texts.select("text_hash", "low"), "text_hash"), "text_hash")
    return out.select("doc_id", F.col("a").cast("long").alias("start_word"), (F.col("b") - F.col("a")).cast("long").alias("n_words"), "first_doc_id", "last_doc_id", F.col("n").alias("n_places"), (F.col("leads") & (F.col("doc_id") == F.col("low"))).alias("is_first"))


def _extend_hot(spans: DataFrame) -> DataFrame:
    """As _extend, for leads of very many rows: each span is a key of its own, summed before it is shuffled."""
    each = spans.select("text_hash", "low", "high", "copies", F.explode(F.arrays_zip(F.col("starts").alias("start"), F.col("spans").alias("span"))).alias("s")).select("text_hash", "low", "high", "copies", "s.start", "s.span")
    place = F.struct("low", "text_hash", "start")
    groups = each.groupBy("span").agg(F.sum("copies").alias("n"), F.min("low").alias("first_doc_id"), F.max("high").alias("last_doc_id"), F.min(place).alias("lead")).where("n > 1")
    return each.join(groups, "span").select("text_hash", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b"), "first_doc_id", "last_doc_id", "n", (F.col("lead") == place).alias("leads"))
