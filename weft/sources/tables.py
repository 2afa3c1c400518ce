"""Tabular views, Parquet storage, and graphs from relational tables, programs and traces."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import InvalidFormatError
from weft.functions import props as P
from weft.graph import PropertyGraph

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def _shown(text: Column) -> Column:
    """JSON text as Python prints the value: bare strings, None, True and False."""
    return F.when(text.isNull(), "").when(text == "null", "None").when(text == "true", "True").when(text == "false", "False").otherwise(F.coalesce(P.string(text), text))


def to_tabular(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables with a string column for every property key; missing values are "".

    The distinct keys (one row each) reach the driver, the rows do not.
    """
    keys = lambda df: sorted(r[0] for r in df.select(F.explode(F.map_keys("props")).alias("k")).distinct().collect())
    cols = lambda df: [_shown(F.col("props")[k]).alias(k) for k in keys(df)]
    return g.nodes.select("id", *cols(g.nodes)), g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), *cols(g.edges))


def register_views(g: PropertyGraph, prefix: str = "") -> None:
    """The tabular views under ``{prefix}nodes`` and ``{prefix}edges`` for SQL."""
    nodes, edges = to_tabular(g)
    nodes.createOrReplaceTempView(f"{prefix}nodes")
    edges.createOrReplaceTempView(f"{prefix}edges")


def _checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"invalid graph name {name!r}")
    return name


def save(g: PropertyGraph, root: str, name: str, description: str = "") -> str:
    """Write nodes, edges and a manifest below ``root/graphs/name``; the folder."""
    folder = f"{root.rstrip('/')}/graphs/{_checked(name)}"
    g.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    manifest = json.dumps({"name": g.name, "directed": g.directed, "multi": g.multi, "description": description})
    g.nodes.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return folder


def load(spark: SparkSession, root: str, name: str) -> PropertyGraph:
    folder = f"{root.rstrip('/')}/graphs/{_checked(name)}"
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    return PropertyGraph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"), manifest["directed"], manifest["multi"], manifest["name"])


def program_to_graph(spark: SparkSession, program: dict[str, Any]) -> PropertyGraph:
    """A containment tree: ``{"class_name", "children": {name: program or {"class_name"}}}``."""
    nodes: list = [("__program__", {"type": "program", "class_name": program["class_name"]})]
    edges: list = []
    stack = [("__program__", "", program)]
    while stack:
        parent, prefix, own = stack.pop()
        for name, child in own.get("children", {}).items():
            node = f"{prefix}{name}"
            nodes.append((node, {"type": "program" if "children" in child else "call", "class_name": child["class_name"]}))
            edges.append((parent, node, {"type": "contains"}))
            if "children" in child:
                stack.append((node, f"{node}.", child))
    return PropertyGraph.of(spark, nodes, edges, name=program["class_name"])


SPAN_FIELDS = ("call_name", "model", "latency_ms", "cost_usd", "input_tokens", "output_tokens", "total_tokens")


def trace_to_graph(spark: SparkSession, trace: dict[str, Any] | str) -> PropertyGraph:
    """A span tree: parents contain children, and each child's data flows to the next."""
    trace = json.loads(trace) if isinstance(trace, str) else trace
    if not isinstance(trace, dict) or "call_name" not in trace:
        raise InvalidFormatError("a trace is an object with a call_name")
    nodes: dict[str, dict] = {}
    edges: list = []
    stack = [(trace, "", None, None)]
    last: dict[str | None, str] = {}
    while stack:
        span, prefix, parent, _ = stack.pop()
        node = f"{prefix}{span.get('call_name') or ''}" or span.get("trace_id", "trace")
        if node in nodes:
            node = f"{node}_{str(span.get('trace_id', ''))[:8]}"
        nodes[node] = {"type": "call", **{k: span.get(k) for k in SPAN_FIELDS}}
        if parent is not None:
            edges.append((parent, node, {"type": "contains"}))
            if parent in last:
                edges.append((last[parent], node, {"type": "data_flow"}))
            last[parent] = node
        stack += [(c, f"{node}.", node, None) for c in reversed(span.get("children") or [])]
    return PropertyGraph.of(spark, list(nodes.items()), edges, name=trace.get("call_name") or "trace")


def spans_to_graph(spans: DataFrame) -> PropertyGraph:
    """The same from a span table ``(span_id, parent_id, seq, ...)`` of any size: containment is its
    parent column, data flow the next span of the parent in order of ``seq``."""
    from pyspark.sql import Window

    cols = [c for c in spans.columns if c not in ("span_id", "parent_id", "seq")]
    text = lambda c: P.quote(F.col(c)) if dict(spans.dtypes)[c] == "string" else F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6), F.lit("null"))
    props = F.map_concat(F.create_map(F.lit("type"), F.lit('"call"')), F.create_map(*[x for c in cols for x in (F.lit(c), text(c))])) if cols else P.literal_map({"type": "call"})
    nodes = spans.select(F.col("span_id").cast("string").alias("id"), F.col("seq").cast("long").alias("ord"), props.alias("props"))
    child = spans.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").cast("string").alias("p"), F.col("span_id").cast("string").alias("c"), F.col("seq").cast("long").alias("k"))
    flow = child.withColumn("n", F.lead("c").over(Window.partitionBy("p").orderBy("k"))).filter(F.col("n").isNotNull())
    edges = child.select(F.col("p").alias("src"), F.col("c").alias("dst"), (2 * F.col("k")).alias("eord"), P.literal_map({"type": "contains"}).alias("props"))
    edges = edges.unionByName(flow.select(F.col("c").alias("src"), F.col("n").alias("dst"), (2 * F.col("k") + 1).alias("eord"), P.literal_map({"type": "data_flow"}).alias("props")))
    return PropertyGraph(nodes, edges)
