"""Plans and statements."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import relational
from tidemark.operators.properties import PropertyStore, pivoted
from tidemark.operators.scan import EventTable
from tidemark.plans.dialect import Engine, tokens
from tidemark.plans.logical import Runner, loads
from tidemark.results import QueryResult
from tidemark.sources import readers

#: Weather stations' readings: objects one after another, over any number of lines.
READINGS = """
{"station": "north", "sensor": "wind", "grade": 2, "level": 10,
 "cost": 0.5}{"station": "north", "sensor": "rain", "grade": 2, "level": 30, "cost": 0.5}
{"station": "harbour", "sensor": "wind", "grade": 3, "level": 7, "cost": 1.25} {"station": "ridge", "sensor": "wind", "grade": 2, "level": 4, "cost": 2.0}
{"station": "ridge", "sensor": "wind", "grade": 5, "level": 100, "cost": 0.1}
{"station": "ridge",
 "sensor": "snow", "grade": 3,
 "level": 3, "cost": 1.0}
"""


@pytest.fixture(scope="module")
def readings(tmp_path_factory):
    p = tmp_path_factory.mktemp("json") / "readings.json"
    p.write_text(READINGS)
    return str(p)


def scan_of(path, ref="r", engine="fs", **more):
    return {"op": "scan", "ref": ref, "storageengine": engine, "selection": {"path": path, "type": "JSON"}, **more}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_concatenated_json(spark, readings, tmp_path):
    df = readers.concatenated_json(spark, readings)
    assert df.count() == 6 and dict(df.dtypes)["level"] == "bigint" and dict(df.dtypes)["cost"] == "double"
    assert readers.concatenated_json(spark, readings, "station string, level long").agg(F.sum("level")).first()[0] == 154
    (tmp_path / "empty.json").write_text(" \n")
    assert readers.concatenated_json(spark, str(tmp_path / "empty.json"), "station string").count() == 0


def test_segment_with_carried_columns_into_a_queue(spark, readings):
    """By grade: how many kinds of sensors, highest grade first."""
    runner = Runner(spark)
    runner.run({"storage": [{"type": "queue", "name": "out"}], "query": [{"op": "sequence", "do": [
        scan_of(readings), {"op": "transform", "transforms": [{"ref": "tier", "expr": "r.grade * 10"}]}, {"op": "segment", "ref": "g", "exprs": ["r.grade"]},
        {"op": "collapsingaggregate", "within": "g", "carryovers": ["r.grade", "tier"], "aggregations": [{"ref": "r.kinds", "expr": "countDistinct(r.sensor)"}]},
        {"op": "order", "orderings": [{"order": "desc", "expr": "tier"}]}, {"op": "store", "storageengine": "out", "target": {"number": 0}},
    ]}]})
    found = [json.loads(x) for x in iter(runner.stored[0].get, readers.END)]
    assert found == [{"r": {"grade": g, "kinds": k}, "tier": 10 * g} for g, k in ((5, 1), (3, 2), (2, 2))]


def test_filter_sum_and_limit_written_without_quotes(spark, readings):
    """Stations by what their readings below 50 cost: north 0.5*10 + 0.5*30, harbour 1.25*7, ridge 2*4 + 1*3."""
    text = f"""{{
      // keys without quotes
      query: [{{op: "sequence", do: [
        {{op: "scan", ref: "r", storageengine: "fs", selection: {{path: "{readings}", type: "JSON"}}}},
        {{op: "filter", expr: "r.level < 50 && r.grade != 9"}},
        {{op: "segment", ref: "by", exprs: ["r.station"]}},
        {{op: "collapsingaggregate", within: "by", carryovers: ["r.station"], aggregations: [{{ref: "paid", expr: "sum(r.cost * r.level)"}}, {{ref: "n", expr: "count(1)"}}]}},
        {{op: "order", orderings: [{{order: "desc", expr: "paid"}}]}},
        {{op: "limit", first: 0, last: 2}},
      ]}}],
    }}""".replace("&&", "and")
    got = [(r.r.station, r.paid, r.n) for r in Runner(spark).run(text).collect()]
    assert got == [("north", pytest.approx(20.0), 2), ("ridge", pytest.approx(11.0), 2)]


def test_global_aggregate_distinct_and_union(spark, readings):
    out = Runner(spark).run({"query": [scan_of(readings, **{"@id": 1}), {"op": "distinct", "@id": 2, "input": 1, "ref": "r.sensor"}, {"op": "union", "@id": 3, "inputs": [1, 2]}, {"op": "collapsingaggregate", "input": 3, "aggregations": [{"ref": "n", "expr": "count(1)"}]}]})
    assert out.first().n == 6 + 3
    empty = Runner(spark).run({"query": [scan_of(readings), {"op": "filter", "expr": "r.level > 1000"}, {"op": "collapsingaggregate", "aggregations": [{"ref": "n", "expr": "count(1)"}, {"ref": "s", "expr": "sum(r.cost)"}]}]})
    assert tuple(empty.first()) == (0, None)
    with pytest.raises(ValueError):
        Runner(spark).run({"query": [{"op": "sort-of"}]})


def test_projection_and_rows(spark, readings):
    out = Runner(spark).run({"query": [scan_of(readings), {"op": "project", "projections": [{"ref": "output.at", "expr": "r.station"}, {"ref": "half", "expr": "r.level / 2"}]}, {"op": "order", "orderings": [{"expr": "half"}]}, {"op": "limit", "first": 1, "last": 3}]})
    assert [tuple(r) for r in out.collect()] == [("ridge", 2.0), ("harbour", 3.5)]


def test_engines_of_a_plan(spark, readings):
    folder, _, name = readings.rpartition("/")
    text = f'{{storage: [{{type: "classpath", name: "here"}}, {{type: "fs", name: "disk", root: "file:///"}}], query: [{{op: "scan", "@id": 1, ref: "d", storageengine: "here", selection: {{path: "/{name}", type: "JSON"}}}}, {{op: "scan", "@id": 2, ref: "d", storageengine: "disk", selection: {{path: "{readings}", type: "JSON"}}}}, {{op: "union", inputs: [1, 2]}}]}}'
    assert Runner(spark, classpath=folder).run(text).count() == 12


@pytest.mark.parametrize("kind,want", [
    ("inner", [("ash", "hill"), ("elm", "hill"), ("fir", "bay")]), ("left", [("ash", "hill"), ("elm", "hill"), ("fir", "bay"), ("oak", None), ("yew", None)]),
    ("outer", [("ash", "hill"), ("elm", "hill"), ("fir", "bay"), ("oak", None), ("yew", None), (None, "moor")]),
])
def test_joins_of_records(spark, tmp_path, kind, want):
    """Trees and the plots they stand on: one has no plot, one a plot that isn't listed, one plot is empty."""
    (tmp_path / "tree.json").write_text("".join(json.dumps({"tree": t, "plot": p} if p else {"tree": t}) for t, p in (("ash", 4), ("elm", 4), ("fir", 9), ("oak", 77), ("yew", None))))
    (tmp_path / "plot.json").write_text("\n".join(json.dumps({"plot": p, "where": w}) for p, w in ((4, "hill"), (9, "bay"), (12, "moor"))))
    scans = [scan_of(str(tmp_path / f"{r}.json"), r, **{"@id": r}) for r in ("tree", "plot")]
    join = {"op": "join", "@id": "all", "left": "tree", "right": "plot", "type": kind, "conditions": [{"relationship": "==", "left": "plot.plot", "right": "tree.plot"}]}
    show = {"op": "project", "input": "all", "projections": [{"ref": "tree", "expr": "tree.tree"}, {"ref": "where", "expr": "plot.where"}]}
    assert sorted(map(tuple, Runner(spark).run({"query": [*scans, join, show]}).collect()), key=str) == sorted(want, key=str)


def test_relaxed_json():
    assert loads('{a: 1, "b:c": "x: y, }", // note\n d: [1, 2,], }') == {"a": 1, "b:c": "x: y, }", "d": [1, 2]}


@pytest.fixture(scope="module")
def engine(spark):
    """A shop's events over two days, and what is known of five users. Days begin at 16:00 UTC."""
    seen = [("look.shoes.", "2022-06-01 15:59:00", 11, 4), ("look.shoes.", "2022-06-01 16:00:00", 11, 4), ("look.hats.", "2022-06-01 16:04:59", 12, 9), ("look.hats.", "2022-06-01 16:05:00", 12, 2),
            ("pay.", "2022-06-02 03:10:00", 11, 60), ("pay.", "2022-06-02 18:00:00", 13, 25), ("lookup.", "2022-06-02 18:30:00", 14, 1)]
    events = spark.createDataFrame(seen, "event string, t string, uid long, value long").selectExpr("event", "cast(t as timestamp_ntz) ts", "uid", "value")
    tier = spark.createDataFrame([(11, "gold"), (12, "tin"), (15, "gold")], "uid long, val string")
    joined = spark.createDataFrame([(11, 20220101), (12, 20220515), (13, 20220602), (15, 20220603)], "uid long, val long")
    return Engine(spark).add("the-shop", EventTable(events), PropertyStore({"tier": tier, "joined": joined}))


def values(result):
    return sorted((tuple(r) for r in result.rows()), key=str)


def test_join_of_events_and_properties(engine):
    r = engine.query("SELECT COUNT( DISTINCT the-shop_deu.uid ), sum(the-shop_deu.value) from (the-shop_deu inner join fix_the-shop on the-shop_deu.uid = fix_the-shop.uid) where fix_the-shop.joined < 20220601 and the-shop_deu.l0 = 'look' and the-shop_deu.date = '20220602'")
    assert r.columns == ["count(distinct the-shop_deu.uid)", "sum(the-shop_deu.value)"] and values(r) == [(2, 15)]


def test_buckets_of_five_minutes(engine):
    r = engine.query("select count(1), max(the-shop_deu.value) from the-shop_deu where the-shop_deu.date = '20220602' and the-shop_deu.l0 = 'look' group by min5(the-shop_deu.ts)")
    assert r.columns == ["count(1)", "max(the-shop_deu.value)", "segmentvalue"]
    assert values(r) == [(1, 2, "2022-06-02 00:05"), (2, 9, "2022-06-02 00:00")]
    wire = r.as_wire()
    assert wire["size"] == 2 and wire["meta"] == r.columns and sorted([wire["0"], wire["1"]])[0] == ["1", "2", "2022-06-02 00:05"]
    with pytest.raises(ValueError, match="more than 1 rows"):
        r.as_wire(max_rows=1)


def test_statements(engine):
    q = lambda s: values(engine.query(s))
    assert q("select fix_the-shop.uid from fix_the-shop where fix_the-shop.tier = 'gold' and fix_the-shop.joined >= 20220101") == [(11,), (15,)]
    assert q("select the-shop_deu.uid, the-shop_deu.l1 from the-shop_deu where the-shop_deu.date = '20220601'") == [(11, "shoes")]
    assert q("select count(distinct uid) from the-shop_deu where date >= '20220601' and date <= '20220603'") == [(4,)]
    assert q("select l0, count(1) n from the-shop_deu where date = '20220602' group by l0") == [("look", 3), ("pay", 1)]
    assert q("select the-shop_deu.l0 as what, count(1) as n from the-shop_deu where date = '20220603' group by the-shop_deu.l0") == [("lookup", 1), ("pay", 1)]


def test_intended_meaning(engine):
    q = lambda s: values(engine.query(s))
    assert q("select count(0) from the-shop_deu where date >= '20220601' and date <= '20220603'") == [(7,)]  # every day of the range
    assert q("select uid from the-shop_deu where l0 = 'pay' or value = 1") == [(11,), (13,), (14,)]
    assert q("select uid from the-shop_deu where l0 = 'look' and l1 = 'hats'") == [(12,), (12,)] and q("select uid from the-shop_deu where l0 = 'pay' and l1 = 'hats'") == []
    assert q("select count(0) from the-shop_deu where value - 1 > -3 and l0 <> 'a-b'") == [(7,)]  # hyphens in literals and subtraction
    assert q("select distinct l0 from the-shop_deu order by l0 desc limit 2") == [("lookup",), ("pay",)]
    assert q("select l0, hour(ts) h, count(1) n from the-shop_deu group by l0, hour(ts) having count(1) > 1") == [("look", "2022-06-02 00:00", 3)]
    assert q("select sum(distinct value) from the-shop_deu where l0 = 'look'") == [(15,)]
    assert q("select uid from fix_the-shop") == [(11,), (12,), (13,), (15,)]
    assert q("select uid from the-shop_deu where l0 = 'pay' union select uid from fix_the-shop where tier = 'tin'") == [(11,), (12,), (13,)]
    assert q("select count(0) from the-shop_deu where value in (2, 9) and uid between 10 and 12 and l0 like 'lo%'") == [(2,)]


def test_days_in_outer_joins(engine):
    """A bound on days that reaches the scan changes no answer, whichever side keeps its rows."""
    q = lambda s: values(engine.query(s))
    both = "the-shop_deu.uid, fix_the-shop.tier"
    assert q(f"select {both} from the-shop_deu left join fix_the-shop on the-shop_deu.uid = fix_the-shop.uid where the-shop_deu.date = '20220603'") == [(13, None), (14, None)]
    assert q(f"select {both} from fix_the-shop left join the-shop_deu on the-shop_deu.uid = fix_the-shop.uid where the-shop_deu.date = '20220601'") == [(11, "gold")]
    assert q(f"select {both} from the-shop_deu full join fix_the-shop on the-shop_deu.uid = fix_the-shop.uid where the-shop_deu.date = '20220603'") == [(13, None), (14, None)]
    assert q("select count(fix_the-shop.uid) from fix_the-shop left join the-shop_deu on fix_the-shop.uid = the-shop_deu.uid where the-shop_deu.uid is null") == [(1,)]


def test_errors(engine):
    with pytest.raises(ValueError):
        engine.query("drop table x")
    with pytest.raises(Exception, match="nothing"):
        engine.query("select nothing from the-shop_deu").columns  # noqa: B018


def test_names_are_tokens():
    found = tokens("select 'the-shop_deu', the-shop_deu.uid-1 from the-shop_deu", ["the-shop_deu"])
    assert [t.table for t in found if t.table] == ["the-shop_deu", "the-shop_deu"] and found[2].kind == "string"


def test_properties(spark):
    t = {"a": spark.createDataFrame([(1, 5), (2, 6)], "uid long, val long"), "b": spark.createDataFrame([(2, "x"), (3, "y")], "uid long, val string")}
    s = PropertyStore(t)
    assert rows_of(s.wide(["a", "b"])) == [(2, 6, "x")] and s.wide(["a", "b"], how="full").count() == 3 and rows_of(s.users()) == [(1,), (2,), (3,)]
    with pytest.raises(KeyError):
        s.one("c")
    long = spark.createDataFrame([(1, "a", "5"), (2, "a", "6"), (2, "b", "x")], "uid long, property string, val string")
    assert sorted(map(str, map(tuple, pivoted(long, ["a", "b"]).collect()))) == sorted(map(str, [(1, "5", None), (2, "6", "x")]))


def test_relational(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k long, v long"), spark.createDataFrame([(2, 5), (9, 6)], "k long, w long")
    assert rows_of(relational.join(a, b, kind="natural")) == [(2, 3, 5)]
    assert relational.join(a, b, "k", "outer").count() == 3
    assert [r.k for r in relational.rows_between(spark.range(10).withColumnRenamed("id", "k").orderBy("k"), 3, 5).collect()] == [3, 4]
    carried = relational.collapse(spark.createDataFrame([(1, "b"), (1, "a")], "k long, c string"), {"k": F.col("k")}, {"n": F.count(F.lit(1))}, ["c"])
    assert rows_of(carried) == [(1, "a", 2)]
    with pytest.raises(ValueError):
        relational.join(a, spark.range(1), kind="natural")


def test_engines(spark, tmp_path, capsys):
    readers.register("made", lambda s, x: s.range(x["n"]))
    assert readers.read(spark, "made", {"n": 3}).count() == 3
    df = spark.createDataFrame([(1, "a"), (2, None)], "i long, t string")
    readers.write(df, "parquet", {"path": str(tmp_path / "p"), "by": ["i"]})
    assert readers.read(spark, "parquet", {"path": str(tmp_path / "p")}).count() == 2
    readers.write(df, "fs", {"path": str(tmp_path / "j")})
    assert readers.read(spark, "fs", {"path": str(tmp_path / "j"), "type": "JSONL"}).count() == 2
    q = readers.write(df, "queue")
    assert [json.loads(r) for r in iter(q.get, readers.END)] == [{"i": 1, "t": "a"}, {"i": 2, "t": None}]
    readers.write(df, "console", {"rows": 1})
    shown = capsys.readouterr().out
    assert "|i" in shown and "only showing top 1 row" in shown
    for f in (readers.read, readers.write):
        with pytest.raises(KeyError):
            f(*((spark, "none", {}) if f is readers.read else (df, "none")))


def test_relational_store(spark):
    """A property kept in a database, read in ranges of users, conditions and columns left to the database."""
    url, driver = "jdbc:derby:memory:props;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no database in this Spark")
    rows = [(u, f"v{u % 3}") for u in range(100)]
    spark.createDataFrame(rows, "uid long, val string").write.format("jdbc").options(url=url, dbtable="tier", driver=driver, createTableColumnTypes="val VARCHAR(20)").mode("overwrite").save()
    found = readers.read(spark, "jdbc", {"url": url, "dbtable": "tier", "driver": driver, "partitionColumn": "uid", "lowerBound": 0, "upperBound": 100, "numPartitions": 4})
    found = found.select(*[F.col(c).alias(c.lower()) for c in found.columns])
    assert found.rdd.getNumPartitions() == 4 and rows_of(found) == rows
    store = PropertyStore({"tier": found, "age": spark.createDataFrame([(5, 30), (7, 40)], "uid long, val long")})
    wide = store.wide(["tier", "age"], {"tier": F.col("tier") == "v2"})
    assert rows_of(wide) == [(5, "v2", 30)]
    plan = found.where("val = 'v1'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(" in plan.split("PushedFilters: ")[1].split("\n")[0]
