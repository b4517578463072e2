"""Active users as a stream: the batch query by five-minute bucket, kept up to date, with late events up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import times


def active_users(events: DataFrame, minutes: int = 5, late: str = "1 hour") -> DataFrame:
    """segmentvalue, cnt and an approximate number of users of each bucket of a stream with ts (timestamp) and user_id.

    Buckets end with the zone's own, as its offset is a whole number of hours. Exact distinct counts would keep every
    user of an open bucket as state; a sketch keeps some kilobytes.
    """
    zoned = F.date_format(F.col("window.start") + F.make_dt_interval(F.lit(0), F.lit(times.ZONE_HOURS)), "yyyy-MM-dd HH:mm")
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"))
    return rows.agg(F.count(F.lit(1)).alias("cnt"), F.approx_count_distinct("user_id").alias("uids")).select(zoned.alias("segmentvalue"), "cnt", "uids")


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each user within the bound: a user's later events are dropped while it is remembered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id"])


def into_memory(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).start()


def into_parquet(stream: DataFrame, path: str, checkpoint: str, by: str | None = None) -> StreamingQuery:
    """Appends to files; the checkpoint folder makes each batch count once."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.partitionBy(by) if by else writer).start(path)
