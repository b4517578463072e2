"""The event catalogue: which event names a table has, and lookups by pattern."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys


def build(events: DataFrame, project: str, count: int = 6) -> DataFrame:
    """project_id and l0..l5 of the names in a table of events with columns l0.. (levels that are ``*`` become null)."""
    have = [f"l{n}" for n in range(count) if f"l{n}" in events.columns]
    # every event has a first level, which stays a plain column, so that conditions on it reach the scan
    named = [F.col(c) if c == "l0" else F.when(F.col(c) != keys.NO_LEVEL, F.col(c)).alias(c) for c in have] + [F.lit(None).cast("string").alias(f"l{n}") for n in range(len(have), count)]
    return events.select(F.lit(project).alias("project_id"), *named).distinct()


def write(events: DataFrame, project: str, path: str) -> None:
    """Keeps a project's catalogue as a table, which is far smaller than its events."""
    build(events, project).write.mode("append").partitionBy("project_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What write kept. Names that were written more than once are there more than once; lookups are distinct."""
    return spark.read.schema("l0 string, l1 string, l2 string, l3 string, l4 string, l5 string, project_id string").parquet(path)


def levels_of(pattern: str) -> list[str]:
    """Levels of a pattern without the ``*`` at its end."""
    parts = [p for p in pattern.split(".") if p != ""]
    while parts and parts[-1] == keys.NO_LEVEL:
        parts.pop()
    return parts


def matching(catalogue: DataFrame, project: str, pattern: str, limit: int | None = None) -> DataFrame:
    """Event names of a project that fit: ``*`` is any level, ``%`` any characters, and levels after the pattern's are free.

    limit: the first so many in the order of names.
    """
    rows = catalogue.where(F.col("project_id") == project)
    for n, part in enumerate(levels_of(pattern)):
        c = F.col(f"l{n}")
        if part == keys.NO_LEVEL:
            rows = rows.where(c.isNotNull())
        elif "%" in part:
            rows = rows.where(F.startswith(c, F.lit(part.partition("%")[0])) & F.rlike(c, F.lit("^" + ".*".join(map(re.escape, part.split("%"))) + "$")))
        else:
            rows = rows.where(c == part)
    own = [c for c in catalogue.columns if re.fullmatch(r"l\d+", c)]
    found = rows.select(keys.event_name(*own).alias("event")).where("event <> ''").distinct()
    return found if limit is None else found.orderBy("event").limit(limit)


def ordered(catalogue: DataFrame, project: str, patterns: Sequence[str]) -> DataFrame:
    """The union of what the patterns match, in row-key order. No match is no row."""
    found = None
    for p in patterns:
        one = matching(catalogue, project, p)
        found = one if found is None else found.union(one)
    if found is None:
        return catalogue.select(F.lit("").alias("event")).limit(0)
    return found.distinct().orderBy(keys.sort_key("event"))
