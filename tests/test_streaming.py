"""The stream's answer is the batch's."""

from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.streaming import live


def test_active_users(spark, tmp_path):
    rows = [(u, f"2024-01-01 {h:02d}:{m:02d}:00") for h in (0, 1, 5) for m in range(0, 60, 7) for u in range(h + m % 4 + 1)]
    df = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.into_memory(live.active_users(stream), "active", "complete")
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("active").collect()}
    want = {tuple(r) for r in df.groupBy(times.min5(F.unix_millis("ts"))).agg(F.count(F.lit(1)), F.count_distinct("user_id")).collect()}
    assert got == want


def test_first_seen_into_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.into_parquet(live.first_seen(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.user_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
