"""The server and the command line."""

import json
import os
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.__main__ import main
from tidemark.plans.dialect import Engine
from tidemark.server import QueryServer
from tidemark.sources.events import stores

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def server(spark):
    s = QueryServer(Engine(spark).add("my-app", *stores(spark, SF)), port=0).start()
    yield s
    s.stop()


def post(server, path, text):
    return json.load(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.port}{path}", text.encode())))


def test_statements_at_once(server):
    sql = "select count(0), count(distinct my-app_deu.uid) from my-app_deu where my-app_deu.l0='{}' group by hour(my-app_deu.ts)"
    kinds = ["view", "click", "signup", "purchase"]
    with ThreadPoolExecutor(8) as pool:
        out = list(pool.map(lambda k: post(server, "/query", sql.format(k)), kinds * 2))
    assert out[:4] == out[4:] or [o["size"] for o in out[:4]] == [o["size"] for o in out[4:]]
    assert out[0]["meta"] == ["count(0)", "count(distinct my-app_deu.uid)", "segmentvalue"] and out[0]["size"] == len(out[0]) - 2 > 0


def test_plan_and_errors(server):
    plan = f'{{query: [{{op: "scan", ref: "e", storageengine: "parquet", selection: {{path: "{SF}/events.parquet"}}}}, {{op: "collapsingaggregate", aggregations: [{{ref: "n", expr: "count(1)"}}]}}]}}'
    assert post(server, "/plan", plan)["size"] == 1
    for path, text in (("/query", "delete from x"), ("/query", "select nothing from my-app_deu"), ("/other", "")):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(server, path, text)
        assert e.value.code == 400 and json.load(e.value)["error"]


def test_command_line(spark, capsys, tmp_path):
    assert main(["--data", SF, "query", "select count(0) from app_deu"]) == 0
    assert "count(0)" in capsys.readouterr().out
    assert main(["--data", SF, "--hot", SF, "count", "20240101", "20240131"]) == 0
    both = capsys.readouterr().out
    assert main(["--data", SF, "count", "2024-01-01", "2024-01-31", "--mode", "cold"]) == 0
    assert both.split()[0] == capsys.readouterr().out.split()[0]
    (tmp_path / "p.plan").write_text(f'{{query: [{{op: "scan", ref: "r", storageengine: "parquet", selection: {{path: "{SF}/region.parquet"}}}}, {{op: "limit", first: 0, last: 2}}]}}')
    assert main(["--data", SF, "plan", str(tmp_path / "p.plan")]) == 0
