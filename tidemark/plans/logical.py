"""JSON logical plans as DataFrames: one function per operator, folded over the plan.

A plan is {"query": [{"op": "sequence", "do": [...]}]}, or a list of operators with "@id" that name
their inputs. Keys may lack quotes. A record is seen as fields with dotted paths, ``donuts.ppu``; results come
back nested the same way. Expressions are Spark SQL over those paths, with countDistinct besides.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import relational
from ..sources import readers

_STRING = r'"(?:[^"\\]|\\.)*"'


def loads(text: str) -> dict:
    """JSON whose keys may lack quotes, with comments and commas before a closing bracket."""
    text = re.sub(rf"({_STRING})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.S)
    text = re.sub(rf"({_STRING})|([A-Za-z_@][\w@-]*)(?=\s*:)", lambda m: m[1] or f'"{m[2]}"', text)
    return json.loads(re.sub(rf"({_STRING})|,(?=\s*[}}\]])", lambda m: m[1] or "", text))


@dataclass
class Flow:
    """Rows with one column per dotted path, and the segments that are open on them."""

    frame: DataFrame
    segments: dict[str, list[str]]
    distinct: dict[str, str]

    def with_frame(self, frame: DataFrame) -> Flow:
        return Flow(frame, self.segments, self.distinct)


def flattened(df: DataFrame, ref: str) -> DataFrame:
    """Fields of records under ``ref``, one column for each."""
    return df.select(*[F.col(f"`{c}`").alias(f"{ref}.{c}") for c in df.columns])


def nested(df: DataFrame) -> DataFrame:
    """Columns with dotted names as structs; a plain name stays a column."""
    tree: dict = {}
    for c in df.columns:
        *outer, last = c.split(".")
        at = tree
        for name in outer:
            at = at.setdefault(name, {})
        at[last] = F.col(f"`{c}`")
    build = lambda node, name: node.alias(name) if isinstance(node, Column) else F.struct(*[build(v, k) for k, v in node.items()]).alias(name)
    return df.select(*[build(v, k) for k, v in tree.items()])


def expression(text: str, columns: list[str]) -> Column:
    """A Spark SQL expression in which dotted paths are columns of the flow."""
    known = sorted(columns, key=len, reverse=True)

    def name(m: re.Match) -> str:
        if m[1]:
            return m[1]
        word = m[2]
        return f"`{word}`" if word in known else word

    text = re.sub(rf"({_STRING}|'(?:[^'\\]|\\.)*'|`[^`]*`)|((?<![\w.])[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*)", name, text)
    text = re.sub(r"\bcountDistinct\s*\(", "count(distinct ", text)
    text = re.sub(r"\bsumDistinct\s*\(", "sum(distinct ", text)
    text = re.sub(r"\bhour\s*\(", "hour_key(", text)
    return F.expr(text.replace("==", "="))


def _columns(exprs: list[str], flow: Flow) -> dict[str, Column]:
    return {f"__key{i}": expression(e, flow.frame.columns) for i, e in enumerate(exprs)}


class Runner:
    """Folds a plan's operators over DataFrames.

    read: replaces the lookup of storage engines, (engine, selection) -> DataFrame.
    classpath: the folder that paths of a ``classpath`` engine are in.
    """

    def __init__(self, spark: SparkSession, read: Callable[[str, Mapping], DataFrame] | None = None, classpath: str = "") -> None:
        self.spark = spark
        self.read = read or (lambda engine, selection: readers.read(spark, engine, selection))
        self.classpath = classpath
        self.engines: dict[str, Mapping] = {}
        self.stored: list[object] = []
        times.register(spark)

    def run(self, plan: str | Mapping) -> DataFrame:
        """The plan's result. What its stores gave is in ``stored``."""
        plan = loads(plan) if isinstance(plan, str) else plan
        self.engines = {e["name"]: e for e in plan.get("storage", [])}
        named: dict[object, Flow] = {}
        last: Flow | None = None
        for op in plan["query"]:
            steps = op["do"] if op["op"] == "sequence" else [op]
            flow = named.get(op.get("input"), last if op["op"] != "sequence" else None)
            for step in steps:
                flow = getattr(self, f"do_{step['op'].replace('-', '_').lower()}", self._unknown)(step, flow, named)
                if "@id" in step:
                    named[step["@id"]] = flow
            if "@id" in op:
                named[op["@id"]] = flow
            last = flow
        if last is None:
            raise ValueError("the plan has no operators")
        return nested(last.frame)

    def run_file(self, path: str) -> DataFrame:
        return self.run(Path(path).read_text())

    def _unknown(self, op: Mapping, flow: Flow | None, named: dict) -> Flow:
        raise ValueError(f"unknown operator {op['op']}")

    def do_scan(self, op: Mapping, flow: Flow | None, named: dict) -> Flow:
        engine, selection = op["storageengine"], dict(op.get("selection") or {})
        given = self.engines.get(engine, {"type": engine})
        root = given.get("root") or (self.classpath if given["type"] in ("cp", "classpath") else "")
        if root and "path" in selection:
            selection["root"] = root
        return Flow(flattened(self.read(given["type"], selection), op["ref"]), {}, {})

    def do_transform(self, op: Mapping, flow: Flow, named: dict) -> Flow:
        df = flow.frame
        for t in op["transforms"]:
            df = df.withColumn(t["ref"], expression(t["expr"], df.columns))
        return flow.with_frame(df)

    def do_project(self, op: Mapping, flow: Flow, named: dict) -> Flow:
        found = [expression(p["expr"], flow.frame.columns).alias(p["ref"].removeprefix("output.")) for p in op["projections"]]
        return Flow(flow.frame.select(*found), {}, {})

    def do_filter(self, op: Mapping, flow: Flow, named: dict) -> Flow:
        return flow.with_frame(flow.frame.where(expression(op["expr"], flow.frame.columns)))

    def do_segment(self, op: Mapping, flow: Flow, named: dict) -> Flow:
        keys = {f"__{op['ref']}{i}": expression(e, flow.frame.columns) for i, e in enumerate(op["exprs"])}
        return Flow(flow.frame.withColumns(keys), flow.segments | {op["ref"]: list(keys)}, flow.distinct)

    def do_distinct(self, op: Mapping, flow: Flow, named: dict) -> Flow:
        keys = flow.segments.get(op.get("within"), [])
        df = flow.frame
        wanted = [op["ref"], *keys]
        return Flow(df.dropDuplicates(wanted), flow.segments, flow.distinct)

    def do_collapsingaggregate(self, op: Mapping, flow: Flow, named: dict) -> Flow:
        df = flow.frame
        keys = {k: F.col(f"`{k}`") for k in flow.segments[op["within"]]} if op.get("within") else {}
        aggregates = {a["ref"]: expression(a["expr"], df.columns) for a in op["aggregations"]}
        carry = list(op.get("carryovers") or [])
        safe = {c: f"__carry{i}" for i, c in enumerate(carry)}
        df = df.withColumns({v: F.col(f"`{k}`") for k, v in safe.items()})
        out = relational.collapse(df, keys, aggregates, list(safe.values()))
        return Flow(out.select(*[F.col(v).alias(k) for k, v in safe.items()], *[F.col(f"`{a}`") for a in aggregates]), {}, {})

    def do_order(self, op: Mapping, flow: Flow, named: dict) -> Flow:
        return flow.with_frame(relational.order(flow.frame, *[(expression(o["expr"], flow.frame.columns), o.get("order", "asc")) for o in op["orderings"]]))

    def do_limit(self, op: Mapping, flow: Flow, named: dict) -> Flow:
        return flow.with_frame(relational.rows_between(flow.frame, op.get("first", 0), op.get("last")))

    def do_join(self, op: Mapping, flow: Flow | None, named: dict) -> Flow:
        left, right = named[op["left"]].frame, named[op["right"]].frame
        how = relational.JOINS[op.get("type", "inner").upper()]
        found = None
        for c in op["conditions"]:
            a, b = (c["left"], c["right"]) if c["left"] in left.columns else (c["right"], c["left"])
            one = left[f"`{a}`"] == right[f"`{b}`"]
            found = one if found is None else found & one
        return Flow(left.join(right, found, how), {}, {})

    def do_union(self, op: Mapping, flow: Flow | None, named: dict) -> Flow:
        return Flow(relational.union_all(*[named[i].frame for i in op["inputs"]]), {}, {})

    def do_store(self, op: Mapping, flow: Flow, named: dict) -> Flow:
        self.stored.append(readers.write(nested(flow.frame), self.engines.get(op["storageengine"], {}).get("type", op["storageengine"]), op.get("target")))
        return flow
