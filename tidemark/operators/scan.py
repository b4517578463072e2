"""Scans of event tables: day ranges, levels, users, values; hot and cold sides.

Every condition becomes a predicate on stored columns before anything is computed, so Parquet
skips row groups (and partitions, where files are laid out by day) by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, times
from .predicates import ValueFilter, all_of, by_key

MODES = ("both", "hot", "cold")


@dataclass
class EventTable:
    """Where a logical event table keeps its columns.

    rows: the stored rows. ts: timestamp without zone, in UTC. event: the first level, or a dotted name if
    ``levels`` is None. levels: expressions of l1 and on. day, bucket: stored columns with the day as yyyyMMdd and the
    bucket of the id's hash, if there are any.
    """

    rows: DataFrame
    ts: str = "ts"
    uid: str = "uid"
    value: str = "value"
    event: str = "event"
    levels: Sequence[Column] | None = None
    day: str | None = None
    id: str | None = None
    bucket: str | None = None
    _view: DataFrame | None = field(default=None, repr=False)

    def view(self, rows: DataFrame | None = None) -> DataFrame:
        """uid, value, l0..l4, ts (epoch ms) and date of the rows."""
        rows = self.rows if rows is None else rows
        ms = F.unix_millis(F.col(self.ts).cast("timestamp"))
        if self.levels is None:
            named = keys.levels(self.event)
        else:
            given = [F.col(self.event), *self.levels]
            named = [(given[n] if n < len(given) else F.lit(keys.NO_LEVEL)).alias(f"l{n}") for n in range(keys.LEVELS)]
        day = F.col(self.day) if self.day else times.day_key(ms)
        own = [F.col(self.id).alias("event_id")] if self.id else []
        return rows.select(*own, F.col(self.uid).alias("uid"), F.col(self.value).alias("value"), *named, ms.alias("ts"), day.alias("date"))

    def within(self, first: str | None, last: str | None) -> list[Column]:
        """Days first to last, both included and either left open, as conditions on what is stored."""
        if self.day:
            return [*([F.col(self.day) >= times.plain_day(first)] if first else []), *([F.col(self.day) <= times.plain_day(last)] if last else [])]
        ts = F.col(self.ts)
        return [*([ts >= F.lit(times.day_start(first)).cast("timestamp_ntz")] if first else []), *([ts < F.lit(times.day_start(last, 1)).cast("timestamp_ntz")] if last else [])]


def scan(table: EventTable, *, first: str | None = None, last: str | None = None, days: Sequence[str] | None = None, levels: dict[str, str | Sequence[str]] | None = None, uids: tuple[int, int] | None = None, buckets: tuple[int, int] | None = None, value: ValueFilter | None = None, ttl_ms: int | None = None, now_ms: int | None = None) -> DataFrame:
    """Rows of the event view that meet all conditions.

    first, last: a range of days. days: single days. levels: {"l0": "visit"} or {"l0": ["visit", "view"]}.
    uids: [start, end). buckets: (first, number) of the hash buckets of ids. ttl_ms: rows older than this at now_ms are left out.
    """
    stored = table.within(first, last)
    if days is not None:
        every = [all_of(table.within(d, d)) for d in sorted(set(days))]
        stored.append(F.col(table.day).isin([times.plain_day(d) for d in days]) if table.day else _any(every))
    if uids is not None:
        stored.append((F.col(table.uid) >= uids[0]) & (F.col(table.uid) < uids[1]))
    if buckets is not None:
        own = F.col(table.bucket) if table.bucket else None
        stored.append(keys.in_buckets(table.uid, *buckets) if own is None else (own >= buckets[0]) & (own < sum(buckets)))
    if value is not None and value.op != "ALL":
        stored.append(value.on(table.value))
    if ttl_ms is not None:
        oldest = F.timestamp_millis(F.lit(now_ms - ttl_ms)) if now_ms is not None else F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_ms / 1000))
        stored.append(F.col(table.ts).cast("timestamp") >= oldest)
    wanted = dict(levels or {})
    if table.levels is not None and "l0" in wanted:
        stored.append(_among(F.col(table.event), wanted.pop("l0")))
    elif table.levels is None and "l0" in wanted:  # names begin with the level and a dot
        given = wanted["l0"]
        stored.append(_any([F.startswith(F.col(table.event), F.lit(x + ".")) | (F.col(table.event) == x) for x in ([given] if isinstance(given, str) else given)]))
    rows = table.view(table.rows.where(all_of(stored)) if stored else table.rows)
    return rows.where(all_of([_among(F.col(k), v) for k, v in wanted.items()])) if wanted else rows


def scan_keys(table: EventTable, start: bytes, end: bytes, event: Column | None = None, **conditions) -> DataFrame:
    """Rows whose row key is in [start, end), with the key as ``rowkey``. event: the name in the key; by default that of the levels.

    The days of the bounds reach the scan, so only theirs are read; the rest of the key is compared row by row.
    """
    first, last = keys.days_of(start, end)
    rows = scan(table, first=first, last=last, **conditions)
    name = keys.event_name(*[f"l{n}" for n in range(keys.LEVELS)]) if event is None else event
    return by_key(rows.withColumn("rowkey", keys.row_key("date", name, "uid")), start, end)


def _among(column: Column, given: str | Sequence[str]) -> Column:
    return column == given if isinstance(given, str) else column.isin(sorted(set(given)))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def merged(hot: DataFrame | None, cold: DataFrame | None, mode: str = "both", key: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """Rows of the hot side (not yet written out), the cold side, or both.

    While hot rows are being written out they are on both sides for a moment; with a key, a row that is on
    both counts once. order: a column to sort by, if order is asked for.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    sides = [x for name, x in (("hot", hot), ("cold", cold)) if mode in ("both", name) and x is not None]
    if not sides:
        side = cold if hot is None else hot
        if side is None:
            raise ValueError("neither side is given")
        return side.limit(0)
    out = sides[0]
    for x in sides[1:]:
        out = out.unionByName(x)
    if key and len(sides) > 1:
        out = out.dropDuplicates(list(key))
    return out.orderBy(order) if order else out
