"""Exact top-k search: a kNN join over Voronoi groups.

Components become floor(SCALE * x), and scores are integer inner products. A bounded sample of the
vectors are pivots; each vector, query or not, belongs to its nearest pivot's group. A summary of each group
holds its size, its radius and its largest norm. Small groups whose pivots are alike share a bin, a large group is one.

First every query is solved in its own bin, which gives it a score that K vectors reach. For the queries q
and the vectors x of a group with pivot p and radius r,

    q.x  =  q.p + q.(x - p)  <=  q.p + |q| r        and        q.x  <=  |q| |x|

so a query goes on to those bins alone that hold a group which can reach its score, and nowhere else. Bins are split into blocks of a bounded number
of rows, and so are the queries that a bin gets, so a pivot with a third of all vectors is many tasks; every pair of blocks is solved
by one matrix product, and the best K of each query's blocks are merged.

Defined results: null vectors and those with null or non-finite components take no part, as
query or as candidate; vectors of different lengths are not compared; rows with a null id take
no part; equal scores go to the smaller id; rows that repeat an id are candidates each, but the
query's own id is never one; a repeated query id is one query for each distinct vector, whose results are merged;
scores beyond a long are not supported; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, find_package, map_arrow, map_partitions

K, SCALE, EVERY = 5, 256, 50
#: Rows to a block of vectors and of queries; pivots at most; all are bounds on a task, not on the search.
BLOCK, QUERY_BLOCK, MAX_PIVOTS = 2048, 2048, 4096


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


class Pivots:
    """Pivots of each length of vectors, numbered throughout. A length without any gets the zero vector, as group -1 - length."""

    def __init__(self, vectors: list[list[int]]) -> None:
        self.of: dict[int, tuple[int, np.ndarray]] = {}
        first = 0
        for width in sorted({len(v) for v in vectors} - {0}):
            own = np.unique(np.array([v for v in vectors if len(v) == width], np.float64).reshape(-1, width), axis=0)
            if len(own) > 2:  # in the order of their widest direction, so that neighbours are alike
                spread = own - own.mean(0)
                own = own[np.argsort(spread @ np.linalg.eigh(spread.T @ spread)[1][:, -1], kind="stable")]
            self.of[width] = (first, own)
            first += len(own)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each vector and its distance to the pivot."""
        first, own = self.of.get(x.shape[1], (-1 - x.shape[1], np.zeros((1, x.shape[1]))))
        g = np.empty(len(x), np.int64)
        for low in range(0, len(x), 1024):
            part = x[low : low + 1024]
            g[low : low + 1024] = ((own**2).sum(1)[None] - 2 * part @ own.T).argmin(1)
        return first + g, np.sqrt(((x - own[g]) ** 2).sum(1))

    def vector(self, g: int) -> np.ndarray:
        if g < 0:
            return np.zeros(-1 - g)
        first, own = next((f, o) for f, o in self.of.values() if f <= g < f + len(o))
        return own[g - first]

    def width(self, g: int) -> int:
        return len(self.vector(g))


def _by_width(column: pa.Array):
    """(rows, their vectors) for each length."""
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        yield at, _matrix(column if len(at) == len(size) else column.take(pa.array(at)))


def _grouped(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """rows(vec_id, v) with their group, distance to its pivot, and norm."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batch: pa.RecordBatch):
        g, d, norm = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for at, x in _by_width(batch.column("v")):
            x = x.astype(np.float64)
            g[at], d[at] = shared.value.nearest(x)
            norm[at] = np.sqrt((x**2).sum(1))
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "v": batch.column("v"), "g": pa.array(g.astype(np.int32)), "d": pa.array(d), "norm": pa.array(norm)})

    return map_arrow(rows.select("vec_id", "v"), run, "vec_id long, v array<bigint>, g int, d double, norm double")


def bins(groups: list, pivots: Pivots, block: int) -> dict[int, int]:
    """The bin of each group: neighbouring small groups of one length share one."""
    out: dict[int, int] = {}
    now, room, last = -1, 0, None
    for x in sorted(groups, key=lambda x: x["g"]):
        width = pivots.width(x["g"])
        if width != last or room + x["n"] > block:
            now, room, last = now + 1, 0, width
        room += x["n"]
        out[x["g"]] = now
    return out


def _targets(pivots: Pivots, groups: list, of: dict[int, int]):
    """Over queries (query_id, v, bin, least): the bins that a query still has to see."""
    by_width: dict[int, tuple] = {}
    for x in sorted(groups, key=lambda x: x["g"]):
        by_width.setdefault(pivots.width(x["g"]), []).append(x)
    table = {w: (np.array([pivots.vector(x["g"]) for x in g]).reshape(len(g), w), np.array([x["radius"] for x in g]), np.array([x["norm"] for x in g]), np.array([of[x["g"]] for x in g])) for w, g in by_width.items()}

    def run(batch: pa.RecordBatch):
        own = batch.column("bin").to_numpy()
        least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
        least = np.where(np.isnan(least), -math.inf, least)
        found: list = [[] for _ in range(batch.num_rows)]
        for rows, q in _by_width(batch.column("v")):
            p, radius, norm, place = table[q.shape[1]]
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            for low in range(0, len(rows), 1024):
                at, x = rows[low : low + 1024], q[low : low + 1024].astype(np.float64)
                size = np.sqrt((x**2).sum(1))[:, None]
                top = np.minimum(x @ p.T + size * radius, size * norm)
                top = np.maximum.reduceat(top, starts, axis=1)  # of each bin
                slack = 1e-6 * (1 + np.abs(top))
                i, j = np.nonzero((top + slack >= least[at][:, None]) & (place[starts][None] != own[at][:, None]))
                for r, b in zip(at[i].tolist(), place[starts][j].tolist(), strict=True):
                    found[r].append(b)
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("query_id"), "v": batch.column("v"), "bins": pa.array(found, pa.list_(pa.int32()))})

    return run


def _solve(k: int):
    """The k best vectors (right) of each query (left) of a pair of blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        q, x = _matrix(left.column("v")), _matrix(right.column("v"))
        qi, xi = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        order = np.argsort(xi, kind="stable")
        x, xi = x[order], xi[order]
        exact = x.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53
        x = x.astype(np.float64).T if exact else x.astype(object).T
        out = []
        for low in range(0, len(q), 256):
            ids = qi[low : low + 256]
            if exact:
                score = (q[low : low + 256].astype(np.float64) @ x).astype(np.int64)
            else:
                score = np.array(q[low : low + 256].astype(object) @ x, object).clip(-(2**63), 2**63 - 1).astype(np.int64)
            # a query's own id is no candidate; what is left over k is cut after ties are in order of ids
            others = ids[:, None] != xi[None]
            if len(xi) > 2 * k:
                reach = np.where(others, score, -(2**63))
                kth = np.partition(reach, len(xi) - k, axis=1)[:, len(xi) - k]
                others &= score >= kth[:, None]
            i, j = np.nonzero(others)
            best = np.lexsort((j, -score[i, j].astype(np.float64) if exact else _descending(score[i, j]), i))
            i, j = i[best], j[best]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            use = place < k
            out.append((ids[i[use]], xi[j[use]], score[i[use], j[use]]))
        a, b, c = (np.concatenate(y).astype(np.int64) for y in zip(*out, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    return run


def _descending(score: np.ndarray) -> np.ndarray:
    """Keys that sort longs from high to low."""
    return ~score


def top_k(vectors: DataFrame, queries: DataFrame | None = None, *, k: int = K, scale: int = SCALE, every: int = EVERY, block: int = BLOCK, query_block: int = QUERY_BLOCK, report: dict | None = None) -> DataFrame:
    """The k highest scores of each query: (query_id, rank, vec_id, score).

    vectors: vec_id, embedding. queries: the same columns; by default the rows whose vec_id is divisible by ``every``.
    report: gets how many pairs of query and block of vectors there are (``all``) and how many are solved (``solved``).
    """
    spark = vectors.sparkSession
    find_package(spark)

    def whole(df: DataFrame) -> DataFrame:
        return df.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))

    data = whole(vectors)
    n_pivots = min(MAX_PIVOTS, max(1, math.isqrt(vectors.count())))  # a table's own count, from its files' ends
    pivots = Pivots([r["v"] for r in data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()])
    grouped = cut(_grouped(data, pivots))
    groups = _summary(grouped)  # a row for each pivot
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = grouped.where(F.col("vec_id") % every == 0) if queries is None else _grouped(whole(queries), pivots)
    asked = cut(asked.dropDuplicates(["vec_id", "v"]))
    of = bins(groups, pivots, block)
    rows_of: dict[int, int] = {}
    for x in groups:
        rows_of[of[x["g"]]] = rows_of.get(of[x["g"]], 0) + x["n"]
    blocks = {b: math.ceil(n / block) for b, n in rows_of.items()}
    known = F.broadcast(spark.createDataFrame(sorted(of.items()), "g int, bin int"))  # at most MAX_PIVOTS rows, and one for each length without any

    def solved(q: DataFrame) -> DataFrame:
        """q (vec_id, v, bin) against the vectors of its bin."""
        asked = {r["bin"]: r["n"] for r in q.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
        if report is not None:
            report["solved"] = report.get("solved", 0) + sum(blocks[b] * n for b, n in asked.items())
        plan = [(b, blocks[b], math.ceil(n / query_block)) for b, n in asked.items()] or [(-1, 1, 1)]
        plan = F.broadcast(spark.createDataFrame(plan, "bin int, blocks int, query_blocks int"))
        some = lambda count: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(count)).cast("int")
        every_ = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        left = q.join(plan, "bin").withColumn("a", some("query_blocks")).withColumn("b", every_("blocks")).select(*[F.col(c).alias(c) for c in ("bin", "a", "b", "vec_id", "v")])  # names of its own
        right = grouped.join(known, "g").join(plan, "bin").withColumn("b", some("blocks")).withColumn("a", every_("query_blocks")).select("bin", "a", "b", "vec_id", "v")
        return left.groupBy("bin", "a", "b").cogroup(right.groupBy("bin", "a", "b")).applyInArrow(_solve(k), "query_id long, vec_id long, score long")

    own = asked.join(known, "g").select("vec_id", "v", "bin")
    near = cut(solved(own))
    least = near.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).cast("double").alias("least"))
    told = own.withColumnRenamed("vec_id", "query_id").join(least, "query_id", "left")
    left = cut(map_arrow(told.select("query_id", "v", "bin", "least"), _targets(pivots, groups, of), "vec_id long, v array<bigint>, bins array<int>").where(F.size("bins") > 0))
    found = near.union(solved(left.select("vec_id", "v", F.explode("bins").alias("bin"))))
    if report is not None:
        report["all"] = sum(blocks.values()) * asked.count()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _summary(grouped: DataFrame) -> list:
    """Size, radius and largest norm of each group, summed in partitions first."""

    def partial(batches):
        found: dict[int, list] = {}
        for batch in batches:
            g, d, size = (batch.column(c).to_numpy() for c in ("g", "d", "norm"))
            for x in np.unique(g).tolist():
                own = g == x
                n, radius, norm = found.get(x, (0, 0.0, 0.0))
                found[x] = (n + int(own.sum()), max(radius, float(d[own].max())), max(norm, float(size[own].max())))
        rows = list(found.values())
        yield pa.RecordBatch.from_pydict({"g": pa.array(list(found), pa.int32()), "n": pa.array([r[0] for r in rows], pa.int64()), "radius": pa.array([r[1] for r in rows], pa.float64()), "norm": pa.array([r[2] for r in rows], pa.float64())})

    some = map_partitions(grouped.select("g", "d", "norm"), partial, "g int, n long, radius double, norm double")
    return some.groupBy("g").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).collect()
