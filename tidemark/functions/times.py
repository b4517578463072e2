"""Time buckets and calendar days of the business zone, as Column expressions.

Instants are epoch milliseconds. The zone is a fixed offset without daylight saving, so buckets are
integer arithmetic that stays inside generated code and needs no session time zone.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Hours that the business day is ahead of UTC.
ZONE_HOURS = 8
_MINUTE_MS = 60_000


def bucket_start(ms: Column | str, minutes: int) -> Column:
    """First millisecond of the bucket: a number, cheaper to group by than its text."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return ms - F.pmod(ms, F.lit(minutes * _MINUTE_MS))


def as_text(start: Column | str) -> Column:
    """Wall clock of the zone at a bucket's first millisecond, as ``yyyy-MM-dd HH:mm``."""
    start = F.col(start) if isinstance(start, str) else start
    seconds = F.call_function("div", start, F.lit(1000))  # a quotient by way of doubles would round
    wall = F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(ZONE_HOURS), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.date_format(wall, "yyyy-MM-dd HH:mm")


def bucket(ms: Column | str, minutes: int) -> Column:
    """Start of the ``minutes``-long bucket of the zone's wall clock, as ``yyyy-MM-dd HH:mm``."""
    return as_text(bucket_start(ms, minutes))


def min5(ms: Column | str) -> Column:
    return bucket(ms, 5)


def hour_key(ms: Column | str) -> Column:
    """The hour's bucket; named apart from Spark's own hour(), which gives a number."""
    return bucket(ms, 60)


def day_key(ms: Column | str) -> Column:
    """``yyyyMMdd`` of the zone's calendar day."""
    return F.replace(F.substring(bucket(ms, 60), 1, 10), F.lit("-"), F.lit(""))


def plus_days(day: Column | str, n: int) -> Column:
    return F.date_format(F.date_add(F.to_date(day, "yyyyMMdd"), n), "yyyyMMdd")


def days_between(first: Column | str, last: Column | str) -> Column:
    """All days from first to last, both included; none where first is later."""
    a, b = F.to_date(first, "yyyyMMdd"), F.to_date(last, "yyyyMMdd")
    return F.when(a <= b, F.transform(F.sequence(a, b), lambda d: F.date_format(d, "yyyyMMdd"))).otherwise(F.array().cast("array<string>"))


def plain_day(day: str) -> str:
    """``2013-01-02`` or ``20130102`` as ``20130102``; anything else is an error."""
    return datetime.strptime(day.replace("-", ""), "%Y%m%d").strftime("%Y%m%d")


def day_start(day: str, plus: int = 0) -> datetime:
    """UTC instant at which a day of the zone, ``plus`` days on, begins."""
    return datetime.strptime(plain_day(day), "%Y%m%d") + timedelta(days=plus, hours=-ZONE_HOURS)


def register(spark: SparkSession) -> None:
    """min5 and hour_key as SQL functions. They are macros that Catalyst inlines, not Python."""
    for name, ms in (("min5", 5 * _MINUTE_MS), ("hour_key", 60 * _MINUTE_MS)):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(ms BIGINT) RETURNS STRING RETURN "
            f"date_format(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, {ZONE_HOURS}, 0, (ms - pmod(ms, {ms})) div 1000), 'yyyy-MM-dd HH:mm')"
        )
