"""Event tables as key-value cells: a binary row key, an eight-byte value and an instant. Reads them as the event view, and writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, times
from ..operators.predicates import by_key


def value_of(cell: Column | str) -> Column:
    """The signed long of eight bytes, highest first."""
    return F.conv(F.hex(F.col(cell) if isinstance(cell, str) else cell), 16, -10).cast("long")


def bytes_of(value: Column | str) -> Column:
    return F.unhex(F.lpad(F.hex((F.col(value) if isinstance(value, str) else value).cast("long")), 16, "0"))


def to_view(cells: DataFrame) -> DataFrame:
    """cells (rowkey, cell, ts) as uid (inner, int), value, l0..l4, ts, date, the event's name, and all its levels."""
    event = keys.key_event("rowkey")
    return cells.select(
        keys.inner_uid(keys.key_uid("rowkey")).alias("uid"), value_of("cell").alias("value"), *keys.levels(event), F.col("ts").cast("long").alias("ts"),
        keys.key_day("rowkey").alias("date"), event.alias("event"), keys.all_levels(event).alias("levels"), keys.key_uid("rowkey").alias("full_uid"),
    )


def to_cells(events: DataFrame) -> DataFrame:
    """events (date, event, uid of five bytes, value, ts) as cells."""
    return events.select(keys.row_key("date", "event", "uid").alias("rowkey"), bytes_of("value").alias("cell"), F.col("ts").cast("long").alias("ts"))


def between_days(cells: DataFrame, first: str, last: str, l0: str | None = None) -> DataFrame:
    """Cells of days first to last, and of events below one first level: one key range, and the level compared inside the key."""
    first, last = times.plain_day(first), times.plain_day(last)
    found = by_key(cells, first.encode(), keys.prefix_end(last).encode())
    if l0 is None:
        return found
    start = f"{l0}.".encode()  # the dot ends the level, so longer names don't match
    return found.where(F.substring("rowkey", 9, len(start)) == F.lit(bytearray(start)))
