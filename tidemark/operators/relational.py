"""Joins, segments and their aggregates, order, ranges of rows, and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times

#: Join words of the dialect and what they mean; NATURAL takes the columns both sides have.
JOINS = {"INNER": "inner", "LEFT": "left", "LEFT OUTER": "left", "RIGHT": "right", "RIGHT OUTER": "right", "OUTER": "full", "FULL": "full", "FULL OUTER": "full", "NATURAL": "natural"}


def join(left: DataFrame, right: DataFrame, on: Sequence[str] | str | None = None, kind: str = "INNER") -> DataFrame:
    """An equi-join on columns of one name. A natural join derives them."""
    how = JOINS[kind.upper()]
    if how == "natural":
        on, how = [c for c in left.columns if c in right.columns], "inner"
        if not on:
            raise ValueError("a natural join needs a common column")
    if on is None:
        raise ValueError("a join needs columns")
    return left.join(right, [on] if isinstance(on, str) else list(on), how)


AGGREGATES = {
    "count": lambda c: F.count(c), "countDistinct": lambda c: F.count_distinct(c), "sum": lambda c: F.sum(c), "sumDistinct": lambda c: F.sum_distinct(c),
    "min": lambda c: F.min(c), "max": lambda c: F.max(c), "avg": lambda c: F.avg(c),
}


def collapse(df: DataFrame, keys: Mapping[str, Column] | None, aggregates: Mapping[str, Column], carry: Sequence[str] = ()) -> DataFrame:
    """One row per segment (one in all without keys): keys, carried columns, aggregates.

    A carried column that is no key is taken from one row of the segment: the least value, so that the
    result does not depend on the order of rows.
    """
    keys = keys or {}
    carried = [F.min(F.col(c)).alias(c) for c in carry if c not in keys]
    named = [v.alias(k) for k, v in aggregates.items()]
    return df.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(*carried, *named) if keys else df.agg(*carried, *named)


def collapse_buckets(df: DataFrame, ms: str, minutes: int, aggregates: Mapping[str, Column]) -> DataFrame:
    """collapse() by time bucket: rows are grouped by a number, and only the groups get their text, ``segmentvalue``."""
    groups = collapse(df, {"__start": times.bucket_start(ms, minutes)}, aggregates)
    return groups.select(times.as_text("__start").alias("segmentvalue"), *aggregates)


def distinct_in(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row for each value of column in each segment."""
    return df.select(*keys, column).distinct()


def order(df: DataFrame, *orderings: tuple[str | Column, str]) -> DataFrame:
    """orderings: (column, 'asc' or 'desc')."""
    cols = [(F.col(c) if isinstance(c, str) else c) for c, _ in orderings]
    return df.orderBy(*[c.desc() if d.lower() == "desc" else c.asc() for c, (_, d) in zip(cols, orderings, strict=True)])


def rows_between(df: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows first up to, but without, last."""
    df = df.offset(first) if first else df
    return df if last is None else df.limit(max(0, last - first))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
