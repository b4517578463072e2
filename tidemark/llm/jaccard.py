"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text is its set of distinct shingles of ``SHINGLE`` words (a text of fewer words is one
shingle). Texts with equal sets are one node. Each of ``TREES`` trees labels a node with DEPTH
bytes, one of each of DEPTH minimum hashes; the sorted labels are the tree's prefix trie. All trees descend
together from the longest prefix, which is shortened until TREES prefixes of that length find a pair at the
threshold with at least the target recall (``match_depth``); as a join has to find the least alike pair that counts, that
depth is one for all nodes. Nodes that share so long a prefix are a run.

Inside a run the prefix is shortened only as far as it has to be: nodes are linked where their TREES * DEPTH minima
agree as often as those of a pair at the threshold do, less five standard errors, first those with the longest common
prefix, and a node that is linked with another already isn't compared with it at shorter ones. So mere chance matches
connect nothing. Runs of more than RUN nodes are linked whole, which only adds candidates.

What is connected by such links is verified exactly: every pair inside a connected group is compared
on its whole shingle sets, in blocks of about BLOCK nodes or BLOCK_BYTES against as many, each a task's unit.
A block pair returns counts of links and a spanning forest of them, never the pairs, so a group
of n near copies costs n / BLOCK reads of each member and no output that grows with n * n.
Recall is thus at least that of the forest (0.999 at the threshold, more above it).

Defined results: null, empty and wordless texts are classes of their own, with no links; rows
with a null doc_id get no class and no links; rows of one doc_id and different texts are
told apart by text; a very long text is read whole, alone in its task's memory; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .frames import cut, map_arrow, map_partitions, split_join
from .graph import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.999
#: Nodes of a run that are compared pair by pair on their minima; nodes and bytes of a block that is verified.
RUN, BLOCK, BLOCK_BYTES = 512, 128, 8 << 20
#: Minima compared at once.
HELD = 1 << 22
_SEED = T.mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_MULTIPLY = (_SEED[: TREES * DEPTH] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_XOR = (_SEED[TREES * DEPTH :] >> np.uint64(32)).astype(np.uint32)


def match_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix whose matches in any of ``trees`` trees reach the recall for a pair at the threshold."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def shingle_sets(chunk: T.Chunk, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row; empty without words."""
    w = T.words(chunk)
    grams = T.grams(w.hash, k)
    for low, high in zip(w.first[:-1], w.first[1:], strict=True):
        n = high - low
        if n >= k:
            yield np.unique(grams[low : high - k + 1])
        elif n:
            yield T.mix(T.grams(w.hash[low:high], int(n)) ^ np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def set_hash(shingles: np.ndarray) -> int:
    """One number for a set: equal sets have equal numbers."""
    return int(T.mix(np.array([T.mix(shingles).sum(dtype=np.uint64) ^ np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def labels(shingles: np.ndarray) -> np.ndarray:
    """TREES labels of DEPTH bytes: a byte of each minimum hash."""
    low = (shingles >> np.uint64(13)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 17) // len(least))
    for i in range(0, len(low), step):
        np.minimum(least, (((low[i : i + step, None] ^ _XOR) * _MULTIPLY) ^ (low[i : i + step, None] >> np.uint32(15))).min(0), out=least)
    return T.mix(least.astype(np.uint64)).astype(np.uint8).reshape(TREES, DEPTH)


def _nodes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for c in T.chunks(batch.column("text")):
        node, size, made = [], [], []
        for s in shingle_sets(c):
            node.append(set_hash(s) if len(s) else None)
            size.append(len(s))
            made.append(labels(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(c.low, c.high - c.low), "node": pa.array(node, pa.int64()), "size": pa.array(size, pa.int32()), "labels": pa.array(made, pa.binary())})


def least_agreement(threshold: float) -> int:
    """How many of the TREES * DEPTH minima a pair at the threshold shares at least, but for five standard errors."""
    n = TREES * DEPTH
    return math.floor(n * threshold - 5 * math.sqrt(n * threshold * (1 - threshold)))


def _in_order(depth: int):
    """Over sorted (tree, label, node): the runs of equal prefixes. A run that is too long, or that another partition may
    hold a part of, comes as edges to its head; where it may go on, its key tells its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the nodes of the open run
        last, first = None, True

        def rows(edges: list, runs: list, ends: list) -> pa.RecordBatch:
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
            n, m, k = len(a), len(runs), len(ends)
            return pa.RecordBatch.from_pydict({
                "a": pa.array([*a.tolist(), *[None] * m, *[x for x, _ in ends]], pa.int64()), "b": pa.array([*b.tolist(), *[None] * m, *[x for x, _ in ends]], pa.int64()),
                "key": pa.array([None] * (n + m) + [x for _, x in ends], pa.int64()), "run": pa.array([None] * n + [x.tolist() for x in runs] + [None] * k, pa.list_(pa.int64())),
            })

        def close(out: tuple[list, list, list], nodes: np.ndarray, key: int, end: bool) -> None:
            nonlocal first
            edges, runs, ends = out
            if first or end:
                ends.append((int(nodes[0]), key))
            if len(nodes) > 1:
                if first or end or len(nodes) > RUN:
                    edges.append((np.full(len(nodes) - 1, nodes[0]), nodes[1:]))
                else:
                    runs.append(np.sort(nodes))
            first = False

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(n, DEPTH)
            prefix = np.zeros((n, 8), np.uint8)
            prefix[:, 8 - depth :] = label[:, :depth]
            tree = batch.column("tree").to_numpy().astype(np.uint64)
            key = T.mix(prefix.view(">u8").ravel().astype(np.uint64) ^ T.mix(tree)).view(np.int64)
            node = batch.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key) != 0) + 1).tolist(), n]
            out: tuple[list, list, list] = [], [], []
            if held and key[0] != last:
                close(out, np.concatenate(held), last, False)
                held = []
            held.append(node[: cuts[1]])
            last = int(key[0])
            if len(cuts) > 2:
                close(out, np.concatenate(held), last, False)
                sizes = np.diff(cuts[1:-1])
                for k in np.flatnonzero(sizes > 1).tolist():
                    close(out, node[cuts[k + 1] : cuts[k + 2]], int(key[cuts[k + 1]]), False)
                held, last = [node[cuts[-2] :]], int(key[-1])
            if any(out):
                yield rows(*out)
        if held:
            out = [], [], []
            close(out, np.concatenate(held), last, True)
            yield rows(*out)

    return run


def _linked(least: int):
    """Over rows (run, node, labels) sorted by run: a spanning forest of the nodes of each run that agree often enough."""

    def forest(node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(node)
        root = np.arange(n)
        step = max(1, HELD // (n * TREES * DEPTH))
        for low in range(0, n, step):
            some = np.arange(low, min(low + step, n))
            i, j = np.nonzero((root[some, None] != root[None]) & (some[:, None] < np.arange(n)[None]))
            if not len(i):
                continue
            i = some[i]
            for at in range(0, len(i), HELD // (TREES * DEPTH)):
                p, q = i[at : at + HELD // (TREES * DEPTH)], j[at : at + HELD // (TREES * DEPTH)]
                use = root[p] != root[q]
                p, q = p[use], q[use]
                good = (label[p] == label[q]).sum(1) >= least
                root = joined(root, p[good], q[good])
        moved = np.flatnonzero(root != np.arange(n))
        return node[root[moved]], node[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, labels = None, [], []
        a, b = [], []

        def settle() -> None:
            if len(nodes) == 2:
                if sum(x == y for x, y in zip(*labels, strict=True)) >= least:
                    a.append(np.array(nodes[:1], np.int64))
                    b.append(np.array(nodes[1:], np.int64))
            elif len(nodes) > 2:
                # those with the longest common prefixes first to each other: their labels are neighbours
                order = np.argsort(np.array(labels, "S0").astype(f"S{TREES * DEPTH}"), kind="stable")
                x, y = forest(np.array(nodes, np.int64)[order], np.frombuffer(b"".join(labels), np.uint8).reshape(len(nodes), -1)[order])
                a.append(x)
                b.append(y)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a) if a else np.zeros(0, np.int64)), "b": pa.array(np.concatenate(b) if b else np.zeros(0, np.int64))})

        for batch in batches:
            for r, node, label in zip(batch.column("run").to_pylist(), batch.column("node").to_pylist(), batch.column("labels").to_pylist(), strict=True):
                if r != now:
                    settle()
                    now, nodes, labels = r, [], []
                nodes.append(node)
                labels.append(label)
            yield out()
            a.clear()
            b.clear()
        settle()
        yield out()

    return run


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each index reaches by the pairs (i, j), from what it reaches already."""
    while True:
        least = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(least, root[i], low)
        np.minimum.at(least, root[j], low)
        least = least[least[root]]
        if (least == root).all():
            return root
        root = least


def candidates(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect the nodes which share a long enough prefix in a tree and are likely alike."""
    tries = nodes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.expr("labels").substr(t * DEPTH + 1, F.lit(DEPTH)))).alias("tree", "label"))
    ordered = tries.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = cut(map_partitions(ordered, _in_order(match_depth(threshold)), "a long, b long, key long, run array<bigint>"))
    ends = found.where("key is not null")  # two rows of each partition at most
    heads = ends.groupBy("key").agg(F.min("a").alias("head"))
    plain = found.where("key is null and run is null").select("a", "b").union(ends.join(heads, "key").select(F.col("head").alias("a"), "b"))
    # trees often give the same run
    runs = found.where("run is not null").select("run").distinct().select(F.xxhash64("run", F.lit(5)).alias("run"), F.explode("run").alias("node"))
    known = runs.join(nodes.select("node", "labels"), "node").repartition("run").sortWithinPartitions("run", "labels")
    return plain.union(map_partitions(known, _linked(least_agreement(threshold)), "a long, b long"))


def _verify(threshold: float):
    """Each group is a pair of blocks (or one block): counts of links, and edges that span them."""

    def block(parts: list[tuple]) -> tuple[np.ndarray, ...]:
        node, copies, side, raw = (list(x) for x in zip(*parts, strict=True))
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        return np.array(node, np.int64), np.array(copies, np.int64), np.array(side), sets

    def links(parts: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        node, copies, side, sets = block(parts)
        one = side[0] == 2  # a block with itself
        side[side == 2] = 0
        if not one and len(np.unique(side)) < 2:  # the other block has no nodes
            return
        n, size = len(node), np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(n), size)
        _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        use = often[column] > 1
        owner, column = owner[use], np.unique(column[use], return_inverse=True)[1]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = left if one else right
        shared = np.zeros((len(left), len(right)), np.float32)
        place = np.zeros(n, np.int64)
        place[left] = np.arange(len(left))
        if not one:
            place[right] = np.arange(len(right))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 4096
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [c, c + width])
            o, k = owner[lo:hi], column[lo:hi] - c
            x = np.zeros((len(left), width), np.float32)
            at = side[o] == 0
            x[place[o[at]], k[at]] = 1
            y = x
            if not one:
                y = np.zeros((len(right), width), np.float32)
                y[place[o[~at]], k[~at]] = 1
            shared += x @ y.T
        union = size[left][:, None] + size[right][None, :] - shared
        alike = shared.astype(np.float64) >= threshold * union.astype(np.float64) - 1e-9
        if one:
            np.fill_diagonal(alike, False)
        yield node[left], alike @ copies[right], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not one:
            yield node[right], copies[left] @ alike, np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.nonzero(alike)
        root = joined(np.arange(n), left[i], right[j])  # a spanning forest, by the least index reached
        moved = np.flatnonzero(root != np.arange(n))
        yield np.zeros(0, np.int64), np.zeros(0, np.int64), node[moved], node[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for node, count, a, b in links(parts):
                none, no = pa.nulls(len(a), pa.int64()), pa.nulls(len(node), pa.int64())
                yield pa.RecordBatch.from_pydict({"node": pa.concat_arrays([pa.array(node), none]), "n": pa.concat_arrays([pa.array(count.astype(np.int64)), none]), "a": pa.concat_arrays([no, pa.array(a)]), "b": pa.concat_arrays([no, pa.array(b)])})

        for batch in batches:
            for x in zip(batch.column("cell").to_pylist(), batch.column("node").to_pylist(), batch.column("copies").to_pylist(), batch.column("side").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if x[0] != cell and parts:
                    yield from out()
                    parts = []
                cell = x[0]
                parts.append(x[1:])
        if parts:
            yield from out()

    return run


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the rows that hold the text of their node."""
    for c in T.chunks(batch.column("text")):
        rows = batch.slice(c.low, c.high - c.low)
        sets = list(shingle_sets(c))
        same = np.array([len(s) > 0 and set_hash(s) == n for s, n in zip(sets, rows.column("node").to_pylist(), strict=True)])
        at = np.flatnonzero(same)
        yield pa.RecordBatch.from_pydict({"node": rows.column("node").take(pa.array(at)), "shingles": pa.array([sets[i].tobytes() for i in at], pa.binary())})


def jaccard_join(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Per document (doc_id, class_id, n_links): the least doc_id of those it is linked with, over any
    number of links of similarity ``threshold`` or more, and how many other documents it is linked with itself.

    docs needs doc_id and text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = cut(map_arrow(docs, _nodes, "doc_id long, node long, size int, labels binary"))
    member = rows.where("doc_id is not null and node is not null")
    nodes = member.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels"), F.first("size").alias("size"))
    nodes = cut(nodes)
    roots = components(candidates(nodes.select("node", "labels"), threshold)).join(nodes.select("node", "least", "copies", "size"), "node")
    roots = cut(roots)
    group = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    group = group.select("root", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = split_join(roots.drop("size"), group, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    texts = docs.join(placed.select(F.col("least").alias("doc_id"), "node"), "doc_id")
    sets = map_arrow(texts, _sets, "node long, shingles binary").dropDuplicates(["node"])
    full = placed.join(sets, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = full.withColumn("other", other).select(
        F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "node", "copies", "shingles")
    found = cut(map_partitions(cells.repartition("cell").sortWithinPartitions("cell"), _verify(threshold), "node long, n long, a long, b long"))
    links = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    classes = components(found.where("a is not null").select("a", "b"))
    named = nodes.select("node", "least", "copies").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    by_node = split_join(named, least, "root").join(links, "node", "left").select("node", "class_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return split_join(rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), by_node, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
