"""Predicates on values, events, days and users that reach the scan as they are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, times

_OPS = {"EQ": "__eq__", "NE": "__ne__", "GT": "__gt__", "GE": "__ge__", "LT": "__lt__", "LE": "__le__"}


@dataclass(frozen=True)
class ValueFilter:
    """op: ALL, EQ, NE, GT, GE, LT, LE, or BETWEEN (both bounds included, upper in ``extra``)."""

    op: str = "ALL"
    value: float | int = 0
    extra: float | int | None = None

    def __post_init__(self) -> None:
        if self.op not in (*_OPS, "ALL", "BETWEEN"):
            raise ValueError(f"unknown operator {self.op}")
        if self.op == "BETWEEN" and self.extra is None:
            raise ValueError("BETWEEN needs two values")

    @classmethod
    def parse(cls, text: str) -> ValueFilter:
        """``VF-OP-value-extra``; a value may have a sign."""
        head, op, *rest = text.split("-", 2)
        if head != "VF":
            raise ValueError(f"not a value filter: {text}")
        numbers, sign = [], ""
        for part in rest[0].split("-") if rest else []:
            if part == "":
                sign = "-"
            else:
                numbers.append(float(sign + part) if "." in part else int(sign + part))
                sign = ""
        return cls(op, *numbers[:2])

    def __str__(self) -> str:
        return "-".join(map(str, ["VF", self.op, self.value, self.extra if self.extra is not None else 0]))

    def on(self, column: Column | str) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        if self.op == "ALL":
            return F.lit(True)
        if self.op == "BETWEEN":
            return c.between(self.value, self.extra)
        return getattr(c, _OPS[self.op])(F.lit(self.value))

    def check(self, value: float | int | None) -> bool:
        """The same for one number, on the driver; null never holds."""
        if value is None:
            return False
        if self.op == "ALL":
            return True
        if self.op == "BETWEEN":
            return self.value <= value <= self.extra
        return bool(getattr(value, _OPS[self.op])(self.value)) if type(value) is type(self.value) else bool(getattr(float(value), _OPS[self.op])(float(self.value)))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def key_filter(events: Sequence[str] | None = None, days: Sequence[str] | None = None, uids: tuple[int, int] | None = None) -> Column:
    """Rows with columns date, event and uid: day and event among those given, uid in [start, end). None: any."""
    out = []
    if days is not None:
        out.append(F.col("date").isin(sorted({times.plain_day(d) for d in days})))
    if events is not None:
        out.append(F.col("event").isin(sorted(set(events))))
    if uids is not None:
        out.append((F.col("uid") >= uids[0]) & (F.col("uid") < uids[1]))
    return all_of(out)


def bucket_filter(start_bucket: int, count: int) -> tuple[int, int]:
    return keys.uid_range(start_bucket, count)


def by_key(df: DataFrame, start: bytes, end: bytes, column: str = "rowkey") -> DataFrame:
    """Rows of a table with binary keys from start up to, but without, end. Keys compare as unsigned bytes."""
    return df.where((F.col(column) >= F.lit(bytearray(start))) & (F.col(column) < F.lit(bytearray(end))))
