"""Event tables on disk: by day, and inside a day sorted so that statistics of files tell events and users apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators.properties import PropertyStore
from ..operators.scan import EventTable


def write_events(view: DataFrame, path: str, mode: str = "append", parts: int | None = None) -> None:
    """A view with date, l0, uid and ts, and the bucket of the id's hash. Files are ranges of (date, l0, uid), as many as the session's
    shuffles have partitions or ``parts``, so a hot event or day is several files, and files' statistics tell days, events and users apart."""
    order = ["date", "l0", "uid", "ts"]
    rows = view.withColumn("bucket", keys.hash_bucket("uid").cast("int"))
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode(mode).partitionBy("date").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """What write_events wrote, with date as text."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.withColumn("date", F.col("date").cast("string"))


def stored_table(spark: SparkSession, path: str) -> EventTable:
    """The events that write_events wrote, for scans that read by day and bucket."""
    return EventTable(read_events(spark, path).withColumn("instant", F.timestamp_millis("ts")), ts="instant", event="l0", levels=[F.col(f"l{n}") for n in range(1, keys.LEVELS)], day="date", bucket="bucket")


def from_table(rows: DataFrame) -> EventTable:
    """A table with event_id, ts, user_id, event_type, value and props, {"k": n}. Events with an even id have a second level, k."""
    k = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).otherwise(F.lit("*"))
    return EventTable(rows, ts="ts", uid="user_id", value="value", event="event_type", levels=[F.coalesce(k, F.lit("*"))], id="event_id")


def stores(spark: SparkSession, sf_dir: str) -> tuple[EventTable, PropertyStore]:
    """Events and users' properties over a folder with events and customer tables.

    register_time: the first event's instant as a number yyyyMMddHHmmss. segment and nation: of the customer.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    registered = raw.groupBy(F.col("user_id").alias("uid")).agg(F.min("ts").alias("first")).select("uid", F.date_format("first", "yyyyMMddHHmmss").cast("long").alias("val"))
    tables = {
        "register_time": registered,
        "segment": customer.select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("val")),
        "nation": customer.select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").cast("long").alias("val")),
    }
    return from_table(raw), PropertyStore(tables)
