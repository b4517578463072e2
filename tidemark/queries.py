"""Queries of the engine over the test tables, each through the operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import keys
from .operators import catalogue, relational
from .operators.predicates import ValueFilter, key_filter
from .operators.scan import EventTable, merged, scan, scan_keys
from .operators.properties import pivoted
from .plans.dialect import Engine
from .plans.logical import Runner
from .sources import cells
from .sources import events as tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_DEU = """deu AS (SELECT event_id, user_id AS uid, value, event_type AS l0, CASE WHEN event_id % 2 = 0 THEN coalesce(json_extract_string(props, '$.k'), '*') ELSE '*' END AS l1,
  '*' AS l2, '*' AS l3, '*' AS l4, epoch_us(ts) // 1000 AS ts, strftime(ts + INTERVAL 8 HOURS, '%Y%m%d') AS date FROM events)"""
_REG = "p_reg AS (SELECT user_id AS uid, CAST(strftime(min(ts), '%Y%m%d%H%M%S') AS BIGINT) AS val FROM events GROUP BY 1)"
_SEG = "p_seg AS (SELECT c_custkey AS uid, c_mktsegment AS val FROM customer)"
_NAT = "p_nat AS (SELECT c_custkey AS uid, CAST(c_nationkey AS BIGINT) AS val FROM customer)"


def _bucket(minutes: int) -> str:
    ms = minutes * 60_000
    return f"strftime(TIMESTAMP '1970-01-01 08:00:00' + to_seconds((ts // {ms}) * {ms // 1000}), '%Y-%m-%d %H:%M')"


def query(sql: str, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> EventTable:
    return tables.from_table(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark).add("test-app", *tables.stores(spark, sf_dir))


@query("SELECT uid, value, l0, l1, ts FROM deu WHERE l0 = 'view' AND date = '20240105'", _DEU)
def q01_event_scan(spark, sf_dir):
    return scan(_events(spark, sf_dir), days=["20240105"], levels={"l0": "view"}).select("uid", "value", "l0", "l1", "ts")


@query("SELECT count(*) AS cnt FROM deu WHERE date >= '20240105' AND date <= '20240107'", _DEU)
def q02_day_range(spark, sf_dir):
    return scan(_events(spark, sf_dir), first="2024-01-05", last="20240107").agg(F.count(F.lit(0)).alias("cnt"))


@query("SELECT uid, l1 FROM deu WHERE l0 = 'click' AND l1 = '7'", _DEU)
def q03_levels(spark, sf_dir):
    return scan(_events(spark, sf_dir), levels={"l0": "click", "l1": "7"}).select("uid", "l1")


@query("SELECT uid, value FROM deu WHERE value > 10.0 AND value <= 20.0 AND uid >= 5 AND uid < 100", _DEU)
def q04_comparisons(spark, sf_dir):
    rows = scan(_events(spark, sf_dir), uids=(5, 100), value=ValueFilter("GT", 10.0))
    return rows.where(ValueFilter("LE", 20.0).on("value")).select("uid", "value")


@query("SELECT count(*) AS cnt FROM deu WHERE l0 = 'view' OR l0 = 'click'", _DEU)
def q05_either(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select count(0) as cnt from test-app_deu where test-app_deu.l0='view' or test-app_deu.l0='click'")


@query("SELECT count(*) AS cnt FROM deu WHERE uid <> 4", _DEU)
def q06_not_equal(spark, sf_dir):
    return scan(_events(spark, sf_dir)).where(ValueFilter.parse("VF-NE-4-0").on("uid")).agg(F.count(F.lit(0)).alias("cnt"))


@query("SELECT count(*) AS cnt FROM deu WHERE uid BETWEEN 2 AND 7", _DEU)
def q07_between(spark, sf_dir):
    return scan(_events(spark, sf_dir)).where(ValueFilter("BETWEEN", 2, 7).on("uid")).agg(F.count(F.lit(0)).alias("cnt"))


@query("SELECT count(DISTINCT uid) AS dau FROM deu WHERE l0 = 'view' AND date = '20240105'", _DEU)
def q08_daily_actives(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select count(distinct test-app_deu.uid) as dau from test-app_deu where test-app_deu.l0='view' and test-app_deu.date='20240105'")


_SPAN = "l0 = 'view' AND date >= '20240105' AND date <= '20240107'"


@query(f"SELECT {_bucket(5)} AS segmentvalue, count(*) AS cnt, count(DISTINCT uid) AS uids FROM deu WHERE {_SPAN} GROUP BY 1", _DEU)
def q09_five_minutes(spark, sf_dir):
    rows = scan(_events(spark, sf_dir), first="20240105", last="20240107", levels={"l0": "view"})
    return relational.collapse_buckets(rows, "ts", 5, {"cnt": F.count(F.lit(0)), "uids": F.count_distinct("uid")})


@query(f"SELECT {_bucket(60)} AS segmentvalue, count(*) AS cnt, count(DISTINCT uid) AS uids FROM deu WHERE {_SPAN} GROUP BY 1", _DEU)
def q10_hours(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select count(0) as cnt, count(distinct test-app_deu.uid) as uids from test-app_deu where test-app_deu.l0='view' and test-app_deu.date>='20240105' and test-app_deu.date<='20240107' group by hour(test-app_deu.ts)")


@query("SELECT l0, CAST(sum(uid) AS BIGINT) AS s FROM deu GROUP BY 1", _DEU)
def q11_sum(spark, sf_dir):
    return relational.collapse(scan(_events(spark, sf_dir)), {"l0": F.col("l0")}, {"s": F.sum("uid")})


@query("SELECT l0, CAST(sum(DISTINCT uid) AS BIGINT) AS s FROM deu GROUP BY 1", _DEU)
def q12_sum_distinct(spark, sf_dir):
    return relational.collapse(relational.distinct_in(scan(_events(spark, sf_dir)), ["l0"], "uid"), {"l0": F.col("l0")}, {"s": F.sum("uid")})


@query("SELECT e.l0 AS l0, count(DISTINCT e.uid) AS users, count(*) AS cnt FROM deu e JOIN p_reg r ON e.uid = r.uid WHERE r.val < 20240108000000 AND e.date >= '20240115' AND e.date <= '20240121' AND e.value > 10 GROUP BY 1", _DEU, _REG)
def q13_returning(spark, sf_dir):
    return _engine(spark, sf_dir).frame(
        "select test-app_deu.l0 as l0, count(distinct test-app_deu.uid) as users, count(1) as cnt from test-app_deu inner join fix_test-app on test-app_deu.uid = fix_test-app.uid "
        "where fix_test-app.register_time < 20240108000000 and test-app_deu.date >= '20240115' and test-app_deu.date <= '20240121' and test-app_deu.value > 10 group by test-app_deu.l0"
    )


@query("SELECT a.uid AS uid, a.val AS register_time, b.val AS segment FROM p_reg a JOIN p_seg b ON a.uid = b.uid WHERE a.val >= 20240101000000 AND a.val < 20240103000000 AND b.val >= 'H'", _REG, _SEG)
def q14_properties(spark, sf_dir):
    _, store = tables.stores(spark, sf_dir)
    registered = F.col("register_time")
    return store.wide(["register_time", "segment"], {"register_time": (registered >= 20240101000000) & (registered < 20240103000000), "segment": F.col("segment") >= "H"})


@query("SELECT s.uid AS uid, count(e.uid) AS cnt FROM p_seg s LEFT JOIN deu e ON s.uid = e.uid GROUP BY 1", _DEU, _SEG)
def q15_left_join(spark, sf_dir):
    events, store = tables.stores(spark, sf_dir)
    counts = scan(events).groupBy("uid").agg(F.count(F.lit(1)).alias("cnt"))  # before the join, so that it moves a row per user
    return relational.join(store.one("segment"), counts, "uid", "LEFT").select("uid", F.coalesce("cnt", F.lit(0)).alias("cnt"))


@query("SELECT count(*) AS cnt, count(a.uid) AS l, count(b.uid) AS r FROM (SELECT uid FROM p_nat WHERE val >= 10) a FULL JOIN (SELECT DISTINCT uid FROM deu) b ON a.uid = b.uid", _DEU, _NAT)
def q16_full_join(spark, sf_dir):
    events, store = tables.stores(spark, sf_dir)
    a = store.one("nation", F.col("nation") >= 10).select("uid", F.lit(1).alias("a"))
    b = scan(events).select("uid").distinct().withColumn("b", F.lit(1))
    return relational.join(a, b, "uid", "OUTER").agg(F.count(F.lit(1)).alias("cnt"), F.count("a").alias("l"), F.count("b").alias("r"))


@query("SELECT l0, count(*) AS type_count FROM deu GROUP BY 1 ORDER BY l0 DESC LIMIT 3", _DEU)
def q17_top(spark, sf_dir):
    counts = relational.collapse(scan(_events(spark, sf_dir)), {"l0": F.col("l0")}, {"type_count": F.count(F.lit(1))})
    return relational.rows_between(relational.order(counts, ("l0", "desc")), 0, 3)


def _plan(spark: SparkSession, sf_dir: str, *steps: dict) -> DataFrame:
    first = {"op": "scan", "ref": "p", "storageengine": "parquet", "selection": {"path": f"{sf_dir}/part.parquet"}}
    return Runner(spark).run({"query": [{"op": "sequence", "do": [first, *steps]}]})


@query("SELECT p_size, CAST(sum(p_size * p_partkey) AS BIGINT) AS s FROM part WHERE p_retailprice < 1500 GROUP BY 1")
def q18_arithmetic_plan(spark, sf_dir):
    return _plan(
        spark, sf_dir,
        {"op": "transform", "transforms": [{"ref": "p_size", "expr": "p.p_size"}]},
        {"op": "filter", "expr": "p.p_retailprice < 1500"},
        {"op": "segment", "ref": "size", "exprs": ["p.p_size"]},
        {"op": "collapsingaggregate", "within": "size", "carryovers": ["p_size"], "aggregations": [{"ref": "s", "expr": "sum(p.p_size * p.p_partkey)"}]},
    )


@query("SELECT p_size AS segmentvalue, count(DISTINCT p_brand) AS types FROM part GROUP BY 1")
def q19_distinct_plan(spark, sf_dir):
    return _plan(
        spark, sf_dir,
        {"op": "transform", "transforms": [{"ref": "segmentvalue", "expr": "p.p_size"}]},
        {"op": "segment", "ref": "size", "exprs": ["p.p_size"]},
        {"op": "collapsingaggregate", "within": "size", "carryovers": ["segmentvalue"], "aggregations": [{"ref": "types", "expr": "countDistinct(p.p_brand)"}]},
        {"op": "order", "orderings": [{"order": "asc", "expr": "segmentvalue"}]},
    )


@query("SELECT date, l0, uid FROM deu WHERE date IN ('20240105', '20240107') AND l0 IN ('view', 'click') AND uid >= 10 AND uid < 50", _DEU)
def q20_key_filter(spark, sf_dir):
    return scan(_events(spark, sf_dir), days=["20240105", "20240107"], levels={"l0": ["view", "click"]}, uids=(10, 50)).select("date", "l0", "uid")


@query("SELECT count(*) AS cnt FROM (SELECT CAST('0x' || substr(md5(CAST(uid AS VARCHAR)), 1, 2) AS BIGINT) AS b FROM deu) WHERE b >= 0 AND b < 128", _DEU)
def q21_buckets(spark, sf_dir):
    return scan(_events(spark, sf_dir), buckets=(0, 128)).agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT DISTINCT l0 || '.' || CASE WHEN l1 = '*' THEN '' ELSE l1 || '.' END AS event FROM deu WHERE regexp_full_match(l0, 'v.*')", _DEU)
def q22_catalogue(spark, sf_dir):
    return catalogue.matching(catalogue.build(scan(_events(spark, sf_dir)), "test-app"), "test-app", "v%.*")


@query("SELECT event_id, uid FROM deu", _DEU)
def q23_hot_and_cold(spark, sf_dir):
    rows = scan(_events(spark, sf_dir)).select("event_id", "uid")
    return merged(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))


@query("SELECT DISTINCT uid FROM deu WHERE l0 = 'signup'", _DEU)
def q24_distinct_users(spark, sf_dir):
    return scan(_events(spark, sf_dir), levels={"l0": "signup"}).select("uid").distinct()


@query("SELECT uid, CAST(xor((uid + 1099511627776) & 4294967295, 2147483648) - 2147483648 AS INTEGER) AS inner_uid FROM p_seg", _SEG)
def q25_inner_uid(spark, sf_dir):
    _, store = tables.stores(spark, sf_dir)
    return store.one("segment").select("uid", keys.inner_uid(F.col("uid") + F.lit(1 << 40)).alias("inner_uid"))


@query("SELECT l0, l1, CAST(sum(uid) AS BIGINT) AS s, count(*) AS n FROM deu WHERE date = '20240105' GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY l0, l1 LIMIT 50", _DEU)
def q26_keys_having_order_limit(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select l0, l1, sum(uid) as s, count(1) as n from test-app_deu where date = '20240105' group by l0, l1 having count(1) > 1 order by l0, l1 limit 50")


@query("SELECT uid FROM deu WHERE l0 = 'view' INTERSECT SELECT uid FROM deu WHERE l0 = 'signup'", _DEU)
def q27_intersect(spark, sf_dir):
    events = _events(spark, sf_dir)
    return scan(events, levels={"l0": "view"}).select("uid").intersect(scan(events, levels={"l0": "signup"}).select("uid"))


@query("SELECT count(*) AS cnt FROM (SELECT strftime(ts + INTERVAL 8 HOURS, '%Y%m%d') || event_type || '.' AS k, user_id AS uid FROM events) WHERE k >= '20240105click.' AND k < '20240105view.'")
def q28_row_key_range(spark, sf_dir):
    found = scan_keys(_events(spark, sf_dir), b"20240105click.", b"20240105view.", F.concat("l0", F.lit(".")))
    return found.agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT e.uid AS uid, e.l0 AS l0, s.val AS segment FROM deu e LEFT JOIN p_seg s ON e.uid = s.uid WHERE e.date = '20240110' AND e.value > 50", _DEU, _SEG)
def q29_events_with_property(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select test-app_deu.uid as uid, test-app_deu.l0 as l0, fix_test-app.segment as segment from test-app_deu left join fix_test-app on test-app_deu.uid = fix_test-app.uid where test-app_deu.date = '20240110' and test-app_deu.value > 50")


@query(f"SELECT {_bucket(5)} AS segmentvalue, count(*) AS cnt FROM deu GROUP BY 1", _DEU)
def q30_all_buckets(spark, sf_dir):
    return relational.collapse_buckets(scan(_events(spark, sf_dir)), "ts", 5, {"cnt": F.count(F.lit(0))})


@query("SELECT uid, l0, l1, value FROM deu WHERE l0 IN ('view', 'signup') AND l1 LIKE '1%' AND value IS NOT NULL AND uid <> 4 AND value BETWEEN 5 AND 60", _DEU)
def q31_in_like_null(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select uid, l0, l1, value from test-app_deu where l0 in ('view', 'signup') and l1 like '1%' and value is not null and uid <> 4 and value between 5 and 60")


@query("SELECT l0, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS big, count(*) AS n FROM deu WHERE uid IN (SELECT uid FROM p_seg WHERE val = 'BUILDING') GROUP BY 1", _DEU, _SEG)
def q32_case_and_subquery(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select l0, sum(case when value > 50 then 1 else 0 end) as big, count(1) as n from test-app_deu where uid in (select uid from fix_test-app where segment = 'BUILDING') group by l0")


@query("SELECT uid FROM deu WHERE l0 = 'signup' UNION SELECT uid FROM p_nat WHERE val = 3", _DEU, _NAT)
def q33_union(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select uid from test-app_deu where l0 = 'signup' union select uid from fix_test-app where nation = 3")


@query("SELECT uid FROM p_seg EXCEPT SELECT uid FROM deu WHERE l0 = 'view'", _DEU, _SEG)
def q34_except(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select fix_test-app.uid from fix_test-app where fix_test-app.segment is not null except select test-app_deu.uid from test-app_deu where test-app_deu.l0 = 'view'")


@query("SELECT uid, a.val AS segment, b.val AS nation FROM p_seg a JOIN p_nat b USING (uid) WHERE b.val < 5", _SEG, _NAT)
def q35_natural_join(spark, sf_dir):
    _, store = tables.stores(spark, sf_dir)
    return relational.join(store.one("segment"), store.one("nation", F.col("nation") < 5), kind="NATURAL")


_NAMED = "named AS (SELECT *, l0 || '.' || CASE WHEN l1 = '*' THEN '' ELSE l1 || '.' END AS event, CAST('0x' || substr(md5(CAST(uid AS VARCHAR)), 1, 2) AS BIGINT) AS bucket FROM deu)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with the event's dotted name and the id of five bytes, as the row key has them."""
    rows = scan(_events(spark, sf_dir))
    return rows.select("date", "ts", "value", F.col("uid").alias("own"), keys.bucketed("uid").alias("uid"), keys.event_name("l0", "l1").alias("event"))


@query("SELECT date, event, uid FROM named WHERE date IN ('20240103', '20240109') AND event IN ('view.', 'click.7.', 'signup.2.') AND bucket >= 16 AND bucket < 144", _DEU, _NAMED)
def q36_row_key_filter(spark, sf_dir):
    wanted = key_filter(["view.", "click.7.", "signup.2."], ["20240103", "2024-01-09"], keys.uid_range(16, 128))
    return _named(spark, sf_dir).where(wanted).select("date", "event", F.col("own").alias("uid"))


@query("SELECT event_id, event FROM (SELECT *, date || event || chr(255) AS k FROM named) WHERE k >= '20240104click.3.' || chr(255) AND k < '20240106view.' || chr(255)", _DEU, _NAMED)
def q37_key_bounds(spark, sf_dir):
    start, _ = keys.key_bounds("20240104", "20240104", ["click.3."])
    end = keys.key_bounds("2024-01-06", "20240106", ["view.", "click.3."])[1]
    found = scan_keys(_events(spark, sf_dir), start, end[:-5])  # up to the first id of the last event
    return found.select("event_id", keys.key_event("rowkey").alias("event"))


@query("SELECT event, row_number() OVER (ORDER BY event || chr(255)) AS place FROM (SELECT DISTINCT event FROM named)", _DEU, _NAMED)
def q38_event_order(spark, sf_dir):
    names = catalogue.build(scan(_events(spark, sf_dir)), "test-app")
    found = catalogue.ordered(names, "test-app", ["*"])
    # a catalogue is small; rows are numbered over all of it
    return found.select("event", F.row_number().over(Window.orderBy(keys.sort_key("event"))).cast("long").alias("place"))


@query("SELECT event, l0, l1, '*' AS l2, '*' AS l3, '*' AS l4, CASE WHEN l1 = '*' THEN 1 ELSE 2 END AS n FROM (SELECT DISTINCT event, l0, l1 FROM named)", _DEU, _NAMED)
def q39_levels(spark, sf_dir):
    names = _named(spark, sf_dir).select("event").distinct()
    return names.select("event", *keys.levels("event"), F.size(keys.all_levels("event")).alias("n"))


@query("SELECT CAST(uid AS INTEGER) AS uid, CAST(floor(value) AS BIGINT) AS value, l0, l1, l2, ts, date, event, bucket FROM named WHERE date >= '20240102' AND date <= '20240104'", _DEU, _NAMED)
def q40_cells(spark, sf_dir):
    rows = cells.to_cells(_named(spark, sf_dir).withColumn("value", F.floor("value")))
    view = cells.to_view(cells.between_days(rows, "20240102", "2024-01-04"))
    return view.select("uid", "value", "l0", "l1", "l2", "ts", "date", "event", keys.bucket_of("full_uid").cast("long").alias("bucket"))


@query("SELECT event_id, uid, date, row_number() OVER (ORDER BY event_id) AS place FROM deu", _DEU)
def q41_sides_that_overlap(spark, sf_dir):
    rows = scan(_events(spark, sf_dir)).select("event_id", "uid", "date")
    both = merged(rows.where("event_id % 3 < 2"), rows.where("event_id % 3 > 0"), key=["event_id"])
    return both.withColumn("place", F.row_number().over(Window.orderBy("event_id")).cast("long"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def q42_expiry(spark, sf_dir):
    day = 86_400_000
    return scan(_events(spark, sf_dir), ttl_ms=5 * day, now_ms=1706140800000).select("event_id")  # 2024-01-25 00:00 UTC


@query("SELECT l0, cnt FROM (SELECT l0, count(*) AS cnt FROM deu GROUP BY 1) ORDER BY l0 LIMIT 2 OFFSET 1", _DEU)
def q43_offset(spark, sf_dir):
    counts = relational.collapse(scan(_events(spark, sf_dir)), {"l0": F.col("l0")}, {"cnt": F.count(F.lit(1))})
    return relational.rows_between(relational.order(counts, ("l0", "asc")), 1, 3)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 8 UNION ALL SELECT DISTINCT n_name, 'any' FROM nation")
def q44_join_union_plan(spark, sf_dir):
    scans = [{"op": "scan", "@id": k, "ref": k, "storageengine": "parquet", "selection": {"path": f"{sf_dir}/{k}.parquet"}} for k in ("nation", "region")]
    steps = [
        {"op": "join", "@id": "pairs", "left": "nation", "right": "region", "type": "inner", "conditions": [{"relationship": "==", "left": "nation.n_regionkey", "right": "region.r_regionkey"}]},
        {"op": "filter", "@id": "some", "input": "pairs", "expr": "nation.n_nationkey >= 8"},
        {"op": "project", "@id": "one", "input": "some", "projections": [{"ref": "output.n_name", "expr": "nation.n_name"}, {"ref": "output.r_name", "expr": "region.r_name"}]},
        {"op": "distinct", "@id": "names", "input": "nation", "ref": "nation.n_name"},
        {"op": "project", "@id": "two", "input": "names", "projections": [{"ref": "n_name", "expr": "nation.n_name"}, {"ref": "r_name", "expr": "'any'"}]},
        {"op": "union", "inputs": ["one", "two"]},
    ]
    return Runner(spark).run({"query": [*scans, *steps]})


@query("SELECT p_size, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def q45_distinct_in_segment_plan(spark, sf_dir):
    return _plan(
        spark, sf_dir,
        {"op": "transform", "transforms": [{"ref": "p_size", "expr": "p.p_size"}]},
        {"op": "segment", "ref": "size", "exprs": ["p.p_size"]},
        {"op": "distinct", "within": "size", "ref": "p.p_brand"},
        {"op": "collapsingaggregate", "within": "size", "carryovers": ["p_size"], "aggregations": [{"ref": "brands", "expr": "count(p.p_brand)"}]},
    )


@query("SELECT count(*) AS cnt, count(DISTINCT event) AS names FROM named WHERE starts_with(event, 'click.1')", _DEU, _NAMED)
def q46_prefix(spark, sf_dir):
    found = _named(spark, sf_dir).where((F.col("event") >= "click.1") & (F.col("event") < keys.prefix_end("click.1")))
    return found.agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("event").alias("names"))


@query(f"SELECT {_bucket(5)} AS segmentvalue, count(*) AS cnt FROM deu WHERE date = '20240111' AND l0 <> 'view' GROUP BY 1", _DEU)
def q47_five_minutes_of_a_statement(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select count(0) as cnt from test-app_deu where date = '20240111' and l0 <> 'view' group by min5(ts)")


@query("SELECT uid, max(CASE WHEN property = 'segment' THEN val END) AS segment, max(CASE WHEN property = 'nation' THEN val END) AS nation FROM (SELECT uid, 'segment' AS property, val FROM p_seg UNION ALL SELECT uid, 'nation', CAST(val AS VARCHAR) FROM p_nat WHERE val > 9) GROUP BY 1", _SEG, _NAT)
def q48_properties_of_one_table(spark, sf_dir):
    _, store = tables.stores(spark, sf_dir)
    one = lambda name, rows: rows.select("uid", F.lit(name).alias("property"), F.col(name).cast("string").alias("val"))
    return pivoted(one("segment", store.one("segment")).union(one("nation", store.one("nation", F.col("nation") > 9))), ["segment", "nation"])


@query("SELECT l0, count(*) AS cnt FROM deu WHERE date = '20240106' AND (l0 = 'click' OR value > 90) GROUP BY 1", _DEU)
def q49_either_and_both(spark, sf_dir):
    return _engine(spark, sf_dir).frame("select l0, count(1) as cnt from test-app_deu where date = '20240106' and (l0 = 'click' or value > 90) group by l0")
