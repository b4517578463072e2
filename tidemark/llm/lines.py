"""Line dedup: winnowing over line hashes.

A document is its sequence of lines, blank ones left aside. At each line a run begins that ends with the ``RUN``-th line,
or before that as soon as it has ``RUN_WORDS`` words (see ``text``); it is repeated where an equal
run came earlier, in the order of (doc_id, line). So a repeat of three lines or of 50 words is found, be it a single line;
what is shorter stays. Of each run the line with the least hash is the fingerprint
(of equal ones the first), and only these lines are kept, with their positions: a run that two places share has
its fingerprint at the same line of both, so none is missed, and about half of all lines are selected. Positions
whose fingerprint occurs once are dropped by a join; around the others, matches are extended to the left and right
over the hashes of the lines of the runs that selected the position. The lines of every later repeated run are
deleted; overlapping runs add up, so a match of any length goes whole.

Lines are compared without white space around them. Deleted lines go with their line feed;
blank lines stay. Defined results: a null text stays null; texts of fewer than RUN lines and fewer than RUN_WORDS words lose
nothing; a text that is repeated as a whole becomes empty; rows that share a
doc_id are told apart by their text, and of wholly equal rows the first keeps its lines and all
later ones lose them; a null doc_id sorts first. Other columns of the input are kept as they are, but
for one named n_lines_deleted, which is replaced. A very long text is expanded alone, in memory of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .frames import cut, hot_join, map_arrow

RUN, RUN_WORDS = 3, 50
#: Columns that a join needs beside the input's own.
ROW, REPEATED = "_line_dedup_row", "_line_dedup_repeated"


def _windows(w: T.Words, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin, and how many lines each has."""
    n = len(w.hash)
    word, _ = T.spans(T.IS_WORD[T.LOWER[chunk.data]], chunk.bounds)
    words = np.searchsorted(word, w.end) - np.searchsorted(word, w.start)
    size, sum_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(1, RUN + 1):  # a run of k lines, where no shorter one has words enough
        inside = T.whole(w.first, n, k)
        sum_[: n - k + 1] += words[k - 1 :]
        size[inside & (size == 0) & ((sum_ >= RUN_WORDS) | (k == RUN))] = k
    at = np.flatnonzero(size)
    return at, size[at]


def _selected(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For each selected line: its hash, and of the runs that selected it the first line, the number of lines and the hash."""
    for c in T.chunks(batch.column("text")):
        w = T.lines(c)
        at, size = _windows(w, c)
        if not len(at):
            continue
        best = at.copy()
        for j in range(1, RUN):
            other = np.minimum(at + j, len(w.hash) - 1)
            best = np.where((j < size) & (w.hash[other] < w.hash[best]), other, best)
        whole = np.zeros(len(at), np.uint64)
        for k in range(1, RUN + 1):
            of = size == k
            if of.any():
                whole[of] = T.grams(w.hash, k)[at[of]]
        order = np.argsort(best, kind="stable")
        at, size, best, whole = at[order], size[order], best[order], whole[order]
        cuts = np.flatnonzero(np.diff(best, prepend=-1))
        line, offsets = best[cuts], pa.array(np.append(cuts, len(best)).astype(np.int32))
        row = np.searchsorted(w.first, best, "right") - 1
        runs = pa.StructArray.from_arrays([pa.array((at - w.first[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(whole.view(np.int64))], ["line", "size", "run"])
        own = pa.array(row[cuts])
        rows = batch.slice(c.low, c.high - c.low)
        yield pa.RecordBatch.from_pydict({"row": rows.column("row").take(own), "doc_id": rows.column("doc_id").take(own), "fingerprint": pa.array(w.hash[line].view(np.int64)), "runs": pa.ListArray.from_arrays(offsets, runs)})


def _without(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The texts without the lines of runs marked as repeated."""
    gone = batch.column(REPEATED)
    texts = batch.column("text")
    out, counts = [], np.zeros(batch.num_rows, np.int64)
    for c in T.chunks(texts):
        w = None
        for r in range(c.low, c.high):
            if not gone[r].is_valid or not texts[r].is_valid:
                out.append(texts[r].as_py())
                continue
            w = w or T.lines(c)
            low, high = w.first[r - c.low], w.first[r - c.low + 1]
            line, size = (gone[r].values.field(k).to_numpy() for k in ("line", "size"))
            step = np.zeros(high - low + 1, np.int64)
            np.add.at(step, line, 1)
            np.add.at(step, line + size, -1)
            lines = np.flatnonzero(np.cumsum(step[:-1]) > 0) + low
            data = c.data[c.bounds[r - c.low] : c.bounds[r - c.low + 1]]
            keep, base = np.ones(len(data), bool), c.bounds[r - c.low]
            for k in lines:
                keep[w.start[k] - base : w.end[k] - base + 1] = False
            kept = data[keep].tobytes().decode()
            out.append(kept[:-1] if kept.endswith("\n") and not data.tobytes().endswith(b"\n") else kept)
            counts[r] = len(lines)
    names = [n for n in batch.schema.names if n not in ("text", REPEATED)]
    yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(out, pa.string()), pa.array(counts)], [*names, "text", "n_lines_deleted"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(row, line, size): the runs that an equal run precedes. docs: row, doc_id, text."""
    places = cut(map_arrow(docs, _selected, "row long, doc_id long, fingerprint long, runs array<struct<line int, size int, run long>>"))
    often = cut(places.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = hot_join(places, often, ["fingerprint"], "n")
    met = cut(met.select("row", "doc_id", "fingerprint", F.explode("runs").alias("r")).select("row", "doc_id", "fingerprint", "r.line", "r.size", "r.run"))
    place = F.struct("doc_id", "row", "line")
    first = cut(met.groupBy("fingerprint", "run").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return hot_join(met, first, ["fingerprint", "run"], "n").where(place != F.col("first")).select("row", "line", "size")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without later repeated runs of lines, and n_lines_deleted of each.

    docs needs doc_id and text; its other columns come back as they are.
    """
    own = [c for c in docs.columns if c.lower() != "n_lines_deleted"]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    # a row is told by its id and text; where rows are wholly equal, by a number that is taken once and kept
    keyed = docs.withColumn(ROW, F.xxhash64("doc_id", "text"))
    twice = keyed.groupBy(ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.limit(1).count():
        keyed = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    runs = repeated_runs(keyed.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long"), "text"))
    gone = runs.groupBy(F.col("row").alias(ROW)).agg(F.collect_list(F.struct("line", "size")).alias(REPEATED))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")
    found = map_arrow(keyed.join(gone, ROW, "left").drop(ROW), _without, f"{kinds}text string, n_lines_deleted long")
    return found.select(*[F.col(f"`{c}`") for c in own], "n_lines_deleted")
