"""Scans, filters and keys, by counts that can be worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys, times
from tidemark.operators import catalogue
from tidemark.operators.predicates import ValueFilter, by_key, key_filter
from tidemark.operators.scan import EventTable, merged, scan, scan_keys
from tidemark.sources import events as tables

#: Four names on each of two days for each of forty users, who lie in buckets 0, 16 .. 240, 0 .. : user u in bucket 16 * (u % 16).
NAMES = ["play.", "play.chess.", "play.chess.blitz.", "stop."]
DAYS = ["20210630", "20210701"]
USERS = range(40)


def uid_of(u):
    return (16 * (u % 16) << 32) | u


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(d, e, uid_of(u), u) for d in DAYS for u in USERS for e in NAMES]
    return spark.createDataFrame(rows, "date string, event string, uid long, value long").cache()


@pytest.mark.parametrize("events,days,buckets,n", [
    (NAMES, DAYS, None, 320), (NAMES[1:], DAYS, None, 240), (NAMES[:1], DAYS[:1], None, 40), (NAMES, ["2021-07-01"], None, 160), ([], DAYS, None, 0), (None, DAYS, None, 320), (NAMES, None, None, 320),
    (NAMES, DAYS, (0, 1), 24),  # users 0, 16 and 32
    (NAMES, DAYS, (240, 16), 16),  # users 15 and 31
    (NAMES, DAYS, (1, 15), 0), (NAMES, DAYS, (112, 32), 40),  # buckets 112 (users 7, 23, 39) and 128 (8, 24)
    (["stop."], ["20210630"], (0, 128), 24),  # user numbers 0 to 7 modulo 16: 8 + 8 + 8
])
def test_key_filter(keyed, events, days, buckets, n):
    uids = keys.uid_range(*buckets) if buckets else None
    assert keyed.where(key_filter(events, days, uids)).count() == n


def test_key_codec(spark, keyed):
    key = keys.row_key("date", "event", "uid")
    back = keyed.select("*", key.alias("k")).select("*", keys.key_day("k").alias("d"), keys.key_event("k").alias("e"), keys.key_uid("k").alias("u"))
    assert back.where("d <> date or e <> event or u <> uid").count() == 0
    raw = keyed.limit(1).select(keys.row_key(F.lit("20210630"), F.lit("stop."), F.lit((3 << 32) + 258))).first()[0]
    assert bytes(raw) == b"20210630stop.\xff\x03\x00\x00\x01\x02"
    moved = keyed.limit(1).select(keys.with_uid(F.lit(bytearray(raw)), F.lit(7))).first()[0]
    assert bytes(moved) == b"20210630stop.\xff\x00\x00\x00\x00\x07"


def test_key_range(keyed):
    stored = keyed.withColumn("rowkey", keys.row_key("date", "event", "uid"))
    start, end = keys.key_bounds("2021-06-30", "2021-07-01", NAMES, 0, 256)
    assert by_key(stored, start, end).count() == 320  # no user has the last id of all
    start, end = keys.key_bounds("20210701", "20210701", ["play."], 16, 1)
    assert by_key(stored, start, end).count() == 3  # users 1, 17 and 33
    assert keys.uid_range(18, 20) == (18 << 32, 38 << 32)
    assert keys.uid_range(128, 128)[1] == keys.MAX_UID == keys.uid_range(0, 256)[1]
    assert keys.days_of(b"20210630play.", b"20210701") == ("20210630", "20210701") and keys.days_of(b"", b"\xff") == (None, None)


def test_event_order(spark):
    df = spark.createDataFrame([(e,) for e in NAMES], "event string")
    got = [r.event for r in df.orderBy(keys.sort_key("event")).collect()]
    assert got == ["play.chess.blitz.", "play.chess.", "play.", "stop."]  # a name after those below it


@pytest.mark.parametrize("text,n", [("VF-EQ-3-0", 2), ("VF-GE-3-0", 6), ("VF-GT-3-0", 4), ("VF-LE-3-0", 12), ("VF-LT-3-0", 10), ("VF-NE-3-0", 14), ("VF-BETWEEN-1-4", 8), ("VF-ALL-0-0", 16), ("VF-GT--2-0", 14), ("VF-BETWEEN--2--1", 4)])
def test_value_filter(spark, text, n):
    numbers = [*range(-2, 6)] * 2
    df = spark.createDataFrame([(v,) for v in numbers], "value long")
    f = ValueFilter.parse(text)
    assert df.where(f.on("value")).count() == n
    assert sum(f.check(v) for v in numbers) == n
    assert not f.check(None) and ValueFilter.parse(str(f)) == ValueFilter(f.op, f.value, f.extra if f.extra is not None else 0)


def test_value_filter_errors():
    with pytest.raises(ValueError):
        ValueFilter("LIKE", 1)
    with pytest.raises(ValueError):
        ValueFilter("BETWEEN", 1)
    with pytest.raises(ValueError):
        ValueFilter.parse("XX-EQ-1-0")


def test_hot_and_cold(spark):
    rows = spark.range(12).withColumnRenamed("id", "event_id")
    hot, cold = rows.where("event_id >= 5"), rows.where("event_id < 5")
    assert [merged(hot, cold, m).count() for m in ("hot", "cold", "both")] == [7, 5, 12]
    assert [merged(rows, rows.limit(0), m).count() for m in ("hot", "cold", "both")] == [12, 0, 12]
    # while rows are written out they are on both sides
    assert merged(rows, cold, key=["event_id"]).count() == 12
    assert [r.event_id for r in merged(hot, cold, order="event_id").collect()] == list(range(12))
    assert merged(None, cold, "hot").count() == 0 and merged(None, cold).count() == 5
    with pytest.raises(ValueError):
        merged(hot, cold, "warm")


def test_levels_and_prefix(spark):
    df = spark.createDataFrame([("play.",), ("player.",), ("play.a.b.c.d.e.",), ("x",), (None,)], "event string")
    got = {r.event: r for r in df.select("event", *keys.levels("event"), keys.all_levels("event").alias("every")).collect()}
    assert [got["play."][f"l{n}"] for n in range(5)] == ["play", "*", "*", "*", "*"]
    assert got["play.a.b.c.d.e."].l4 == "d" and got["play.a.b.c.d.e."].every[5] == "e"
    table = EventTable(df.selectExpr("event", "timestamp_ntz'2021-06-30 00:00:00' as ts", "1L as uid", "1L as value"))
    assert scan(table, levels={"l0": "play"}).count() == 2
    assert keys.prefix_end("play.") == "play/" and keys.prefix_end("a\U0010ffff") == "b" and keys.prefix_end("퟿") == ""
    with pytest.raises(ValueError):
        keys.prefix_end("\U0010ffff")


def test_days(spark):
    ts = ["2021-06-29 15:59:59", "2021-06-29 16:00:00", "2021-06-30 16:00:00", "2021-07-01 15:59:59", "2021-07-01 16:00:00"]
    df = spark.createDataFrame([(x,) for x in ts], "t string").selectExpr("'play.' as event", "cast(t as timestamp_ntz) as ts", "1L as uid", "1L as value")
    table = EventTable(df)
    assert scan(table, first="20210630", last="20210701").count() == 3
    assert scan(table, days=["2021-06-30"]).count() == 1
    assert scan(table, first="20210702").count() == 1 and scan(table, last="20210629").count() == 1
    assert [r.date for r in scan(table).orderBy("ts").collect()] == ["20210629", "20210630", "20210701", "20210701", "20210702"]
    now = 1625155200000  # 2021-07-01 16:00:00
    assert scan(table, ttl_ms=86_400_000, now_ms=now).count() == 3


def test_buckets_of_time(spark):
    df = spark.createDataFrame([(0,), (299_999,), (300_000,), (-1,), (1625068800000,)], "ms long")
    got = {r.ms: (r.a, r.b, r.c) for r in df.select("ms", times.min5("ms").alias("a"), times.hour_key("ms").alias("b"), times.day_key("ms").alias("c")).collect()}
    assert got[0] == got[299_999] == ("1970-01-01 08:00", "1970-01-01 08:00", "19700101")
    assert got[300_000][0] == "1970-01-01 08:05" and got[-1] == ("1970-01-01 07:55", "1970-01-01 07:00", "19700101")
    assert got[1625068800000] == ("2021-07-01 00:00", "2021-07-01 00:00", "20210701")
    times.register(spark)
    assert spark.sql("select min5(-1L) a, hour_key(0L) b").first()[:] == ("1970-01-01 07:55", "1970-01-01 08:00")
    r = df.limit(1).select(times.plus_days(F.lit("20200228"), 2).alias("a"), times.days_between(F.lit("20210629"), F.lit("20210701")).alias("b"), times.days_between(F.lit("20210702"), F.lit("20210701")).alias("c")).first()
    assert r.a == "20200301" and r.b == ["20210629", "20210630", "20210701"] and r.c == []


def test_inner_uid(spark):
    df = spark.createDataFrame([((9 << 32) + 12,), (0xFFFFFFFE,), (0x80000001,)], "uid long")
    assert [tuple(r) for r in df.select(keys.inner_uid("uid"), keys.bucket_of("uid")).collect()] == [(12, 9), (-2, 0), (-2147483647, 0)]


def test_hash_buckets(spark):
    df = spark.range(500).withColumnRenamed("id", "uid").withColumn("b", keys.hash_bucket("uid"))
    for first, n in ((0, 128), (128, 128), (7, 1), (255, 1), (0, 256), (10, 0)):
        assert df.where(keys.in_buckets("uid", first, n)).count() == df.where((F.col("b") >= first) & (F.col("b") < first + n)).count()
    assert df.where("b between 0 and 255").count() == 500 and df.select(keys.bucket_of(keys.bucketed("uid")).alias("x"), "b").where("x <> b").count() == 0


def test_catalogue(spark, tmp_path):
    names = [("play",), ("play", "go"), ("play", "chess"), ("play", "chess", "blitz"), ("play", "chess", "slow"), ("watch", "chess"), ("player",)]
    rows = [("p", *n, *[None] * (6 - len(n))) for n in names]
    df = spark.createDataFrame(rows, "project_id string, l0 string, l1 string, l2 string, l3 string, l4 string, l5 string")
    got = lambda p: {r.event for r in catalogue.matching(df, "p", p).collect()}
    assert got("play.*") == {"play.", "play.go.", "play.chess.", "play.chess.blitz.", "play.chess.slow."}
    assert got("*.chess") == {"play.chess.", "play.chess.blitz.", "play.chess.slow.", "watch.chess."}
    assert got("pla%.*") == got("play.*") | {"player."} and got("none.*") == set() == {r.event for r in catalogue.matching(df, "q", "*").collect()}
    assert [r.event for r in catalogue.matching(df, "p", "play.*", limit=2).collect()] == ["play.", "play.chess."]
    assert [r.event for r in catalogue.ordered(df, "p", ["play.chess.*", "watch.*", "none"]).collect()] == ["play.chess.blitz.", "play.chess.slow.", "play.chess.", "watch.chess."]
    assert catalogue.ordered(df, "p", []).count() == 0
    events = spark.createDataFrame([("play", "go"), ("play", "*"), ("play", "go")], "l0 string, l1 string")
    catalogue.write(events, "p", str(tmp_path / "names"))
    catalogue.write(events.limit(1), "p", str(tmp_path / "names"))
    assert {r.event for r in catalogue.matching(catalogue.read(spark, str(tmp_path / "names")), "p", "play").collect()} == {"play.", "play.go."}


@pytest.fixture(scope="module")
def on_disk(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("events") / "e")
    rows = [(f"play.g{u % 2}.", f"2021-07-0{d} 00:00:00", u, 10 * d + u) for d in (1, 2, 3) for u in range(50)]
    view = EventTable(spark.createDataFrame(rows, "event string, t string, uid long, value long").selectExpr("event", "cast(t as timestamp_ntz) ts", "uid", "value")).view()
    tables.write_events(view, at, parts=6)
    return at


def test_events_on_disk(spark, on_disk):
    back = tables.read_events(spark, on_disk)
    assert back.count() == 150 and back.where("date = '20210702'").count() == 50 and dict(back.dtypes)["date"] == "string"
    files = back.where("date = '20210702'").groupBy(F.input_file_name().alias("f")).agg(F.min("uid").alias("a"), F.max("uid").alias("b")).orderBy("a").collect()
    assert len(files) > 1 and all(x.b <= y.a for x, y in zip(files, files[1:]))  # each file has users of its own


def test_stored_days_and_buckets_reach_the_scan(spark, on_disk):
    table = tables.stored_table(spark, on_disk)
    found = scan(table, first="20210702", last="20210702", buckets=(0, 128), levels={"l0": "play", "l1": "g1"})
    want = tables.read_events(spark, on_disk).where("date = '20210702' and l1 = 'g1'").where(keys.in_buckets("uid", 0, 128))
    assert sorted(map(tuple, found.select("uid", "value", "ts").collect())) == sorted(map(tuple, want.select("uid", "value", "ts").collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed, parts = plan.split("PushedFilters: ")[1], plan.split("PartitionFilters: ")[1]
    assert "GreaterThanOrEqual(bucket,0)" in pushed and ">= 20210702" in parts and "md5" not in plan


def test_scan_by_keys(spark):
    rows = [("play.", "2021-06-30 00:00:00", 5, 1), ("stop.", "2021-06-30 00:00:00", 5, 2), ("play.", "2021-07-01 00:00:00", 6, 3), ("stop.", "2021-07-01 00:00:00", 7, 4)]
    table = EventTable(spark.createDataFrame(rows, "event string, t string, uid long, value long").selectExpr("event", "cast(t as timestamp_ntz) ts", "uid", "value"))
    end = keys.key_bounds("20210701", "20210701", ["stop."])[1]
    assert sorted(r.value for r in scan_keys(table, b"20210630q", end).collect()) == [2, 3, 4]
    assert sorted(r.value for r in scan_keys(table, b"2021", b"20210630s").collect()) == [1]
    assert [bytes(r.rowkey) for r in scan_keys(table, b"20210701", b"20210701q").collect()] == [b"20210701play.\xff\x00\x00\x00\x00\x06"]
