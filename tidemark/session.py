"""The Spark session that the engine's results assume: UTC, adaptive execution on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings of meaning; sizes (memory, partitions) are the deployment's.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}


def session(name: str = "tidemark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS, and with settings such as ``spark_sql_shuffle_partitions="400"`` (dots as underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
