"""Cells and views of them."""

from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators.scan import merged
from tidemark.sources import cells as C


def table(spark):
    rows = [(d, e, (b << 32) + u, v, 1000 * v) for d in ("20210601", "20210602", "20210603") for e, b, u, v in (("play.", 0, 1, 5), ("play.a.b.c.d.e.f.", 7, 2, -3), ("player.", 255, 0xFFFFFFFF, 1 << 40), ("buy.x.", 3, 0x80000000, 0))]
    return spark.createDataFrame(rows, "date string, event string, uid long, value long, ts long")


def test_round_trip(spark):
    events = table(spark)
    view = C.to_view(C.to_cells(events))
    back = view.select("date", "event", F.col("full_uid").alias("uid"), "value", "ts")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, events.collect()))
    got = {r.event: r for r in view.where("date = '20210601'").collect()}
    assert (got["play."].uid, got["player."].uid, got["buy.x."].uid) == (1, -1, -2147483648)
    assert got["play.a.b.c.d.e.f."].l4 == "d" and got["play.a.b.c.d.e.f."].levels[5:] == ["e", "f"] and got["play."].l1 == "*"
    assert dict(view.dtypes)["uid"] == "int"


def test_key_ranges(spark):
    cells = C.to_cells(table(spark))
    count = lambda *a: C.between_days(cells, *a).count()
    assert count("20210601", "2021-06-02") == 8 and count("20210601", "20210603", "play") == 6 and count("20210602", "20210602", "player") == 1
    assert count("20210604", "20210609") == 0 and count("20210603", "20210601", "play") == 0


def test_sides_in_key_order(spark):
    cells = C.to_cells(table(spark))
    hot, cold = cells.where(keys.key_day("rowkey") == "20210603"), cells.where(keys.key_day("rowkey") < "20210603")
    got = [bytes(r.rowkey) for r in merged(hot, cold, order="rowkey").collect()]
    assert got == sorted(got) and len(got) == 12
