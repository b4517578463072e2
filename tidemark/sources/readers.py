"""Sources and sinks by name: a registry that plans look engines up in, and the engines themselves."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from queue import SimpleQueue

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..results import QueryResult

Reader = Callable[[SparkSession, dict], DataFrame]
Writer = Callable[[DataFrame, dict], object]
_READERS: dict[str, Reader] = {}
_WRITERS: dict[str, Writer] = {}
#: End of a queue's rows.
END = None


def register(name: str, reader: Reader | None = None, writer: Writer | None = None) -> None:
    """Adds a storage engine, or replaces one: reader(spark, selection), writer(df, target)."""
    if reader:
        _READERS[name] = reader
    if writer:
        _WRITERS[name] = writer


def read(spark: SparkSession, engine: str, selection: Mapping) -> DataFrame:
    if engine not in _READERS:
        raise KeyError(f"no storage engine {engine} to read from; there are {', '.join(sorted(_READERS))}")
    return _READERS[engine](spark, dict(selection))


def write(df: DataFrame, engine: str, target: Mapping | None = None) -> object:
    if engine not in _WRITERS:
        raise KeyError(f"no storage engine {engine} to write to; there are {', '.join(sorted(_WRITERS))}")
    return _WRITERS[engine](df, dict(target or {}))


def objects(text: str) -> Iterator[dict]:
    """JSON objects one after another, with white space or nothing between them."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at == len(text):
            return
        value, at = decoder.raw_decode(text, at)
        yield from value if isinstance(value, list) else [value]


def concatenated_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files of concatenated JSON objects, printed over any number of lines. A file is the unit of work.

    Objects are split in Python, as Spark's own reader takes lines or one value per file; columns and types
    are then Spark's. Without a schema it is inferred from all objects.
    """
    lines = spark.read.text(path, wholetext=True).mapInPandas(_split, "value string")
    if schema is not None:
        return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return spark.read.json(lines.rdd.map(lambda r: r["value"]))  # the only form in which the reader infers from rows


def _split(parts: Iterator) -> Iterator:
    for p in parts:
        yield pd.DataFrame({"value": [json.dumps(o) for v in p["value"] for o in objects(v)]}, dtype=object)


def _json(spark: SparkSession, selection: dict) -> DataFrame:
    kind = selection.get("type", "JSON").upper()
    root = selection.get("root", "")
    path = f"{root.rstrip('/')}/{selection['path'].lstrip('/')}" if root else selection["path"]
    if kind == "JSON":
        return concatenated_json(spark, path, selection.get("schema"))
    if kind == "JSONL":
        return spark.read.json(path, schema=selection.get("schema"))
    return spark.read.format(kind.lower()).load(path)


def _jdbc(spark: SparkSession, selection: dict) -> DataFrame:
    """A property of a relational store: options as of Spark's JDBC source; predicates are pushed by it."""
    return spark.read.format("jdbc").options(**selection).load()


def _queue(df: DataFrame, target: dict) -> SimpleQueue:
    """Rows as JSON texts, then END."""
    out = target.get("queue") or SimpleQueue()
    for record in QueryResult(df).records():
        out.put(record)
    out.put(END)
    return out


def _console(df: DataFrame, target: dict) -> None:
    df.show(target.get("rows", 20), truncate=False)


def _write_json(df: DataFrame, target: dict) -> str:
    df.write.mode(target.get("mode", "errorifexists")).json(target["path"])
    return target["path"]


def _parquet(spark: SparkSession, selection: dict) -> DataFrame:
    return spark.read.parquet(selection["path"])


def _write_parquet(df: DataFrame, target: dict) -> str:
    writer = df.write.mode(target.get("mode", "errorifexists"))
    (writer.partitionBy(*target["by"]) if target.get("by") else writer).parquet(target["path"])
    return target["path"]


for _name in ("cp", "classpath", "fs", "fs1"):
    register(_name, _json, _write_json)
register("parquet", _parquet, _write_parquet)
register("jdbc", _jdbc)
register("queue", writer=_queue)
register("console", writer=_console)
