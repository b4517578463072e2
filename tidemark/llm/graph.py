"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014).

While there are no more than LOCAL_EDGES edges in all, which is counted first, one task joins them; beyond that
they never meet in one place. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, map_partitions, remove, split_join, written

#: Edges (16 bytes each) that one task takes.
LOCAL_EDGES = 500_000


def components(edges: DataFrame, *, local_edges: int | None = None, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node it is connected with.

    Each round rewires edges to smaller neighbours and writes them to the checkpoint folder, so a
    lost executor costs one round; the round before is deleted then, so two rounds' edges are kept. Neighbourhoods
    are only ever reduced to their minimum, never gathered; a hub's edges are split over tasks by the join.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    if edges.count() <= (LOCAL_EDGES if local_edges is None else local_edges):
        return map_partitions(edges.coalesce(1), _joined, "node long, root long")
    before, place = None, None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = split_join(both, least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # edges now go from a smaller a to a larger b; each b keeps its least a, and links that to its other ones
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = split_join(large, least, "b")
        links = small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges, made = written(links.union(least.select(F.col("m").alias("a"), "b")).distinct())
        if place:
            remove(edges.sparkSession, place)
        place = made
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: still changing after {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges at once: every node takes the least root of its neighbours until none changes."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate([x for p in zip(*parts, strict=True) for x in p]), return_inverse=True)
    i, j = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            break
        root = least
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes), "root": pa.array(nodes[root])})
