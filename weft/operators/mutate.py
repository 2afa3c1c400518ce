"""Changes to a graph; each returns a new graph. Batch forms take DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import props as P
from weft.graph import EDGE_SCHEMA, NODE_SCHEMA, PropertyGraph


def _next(df: DataFrame, col: str) -> int:
    last = df.agg(F.max(col)).first()[0]
    return 0 if last is None else last + 1


def add_nodes(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """Add ``rows(id, ord, props)``; an id that is there already is a ValueError."""
    new = g.with_(nodes=g.nodes.unionByName(rows.select("id", (F.col("ord") + _next(g.nodes, "ord")).alias("ord"), "props")))
    twice = new.nodes.groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate node: {twice[0]['id']!r}")
    return new


def add_node(g: PropertyGraph, node_id: str, **properties: Any) -> PropertyGraph:
    return add_nodes(g, g.nodes.sparkSession.createDataFrame([(node_id, 0, P.encode_map(properties))], NODE_SCHEMA))


def add_edges(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """Add ``rows(src, dst, eord, props)``; endpoints must exist, and a simple graph stays simple."""
    lost = rows.select(F.explode(F.array("src", "dst")).alias("id")).join(g.nodes, "id", "left_anti").limit(1).collect()
    if lost:
        g.require(lost[0]["id"])
    return g.with_(edges=g.edges.unionByName(rows.select("src", "dst", (F.col("eord") + _next(g.edges, "eord")).alias("eord"), "props"))).checked()


def add_edge(g: PropertyGraph, source: str, target: str, **properties: Any) -> PropertyGraph:
    return add_edges(g, g.nodes.sparkSession.createDataFrame([(source, target, 0, P.encode_map(properties))], EDGE_SCHEMA))


def remove_node(g: PropertyGraph, node_id: str) -> PropertyGraph:
    """Without the node and its edges."""
    g.require(node_id)
    return g.with_(nodes=g.nodes.filter(F.col("id") != node_id), edges=g.edges.filter((F.col("src") != node_id) & (F.col("dst") != node_id)))


def remove_edge(g: PropertyGraph, source: str, target: str) -> PropertyGraph:
    """Without one edge of the pair: the first."""
    if not g.has_edge(source, target):
        raise KeyError(f"edge not found: {source!r}, {target!r}")
    own = (F.col("src") == source) & (F.col("dst") == target)
    if not g.directed:
        own = own | ((F.col("src") == target) & (F.col("dst") == source))
    first = g.edges.filter(own).agg(F.min("eord")).first()[0]
    return g.with_(edges=g.edges.filter(~(own & (F.col("eord") == first))))


def update_nodes(g: PropertyGraph, updates: DataFrame) -> PropertyGraph:
    """Merge ``updates(id, props)`` into the nodes' properties, key by key."""
    new = updates.select("id", F.col("props").alias("new"))
    merged = F.when(F.col("new").isNull(), F.col("props")).otherwise(F.map_zip_with("props", "new", lambda k, old, own: F.coalesce(own, old)))
    return g.with_(nodes=g.nodes.join(new, "id", "left").select("id", "ord", merged.alias("props")))


def update_node(g: PropertyGraph, node_id: str, **properties: Any) -> PropertyGraph:
    g.require(node_id)
    merged = F.map_zip_with("props", P.literal_map(properties), lambda k, old, own: F.coalesce(own, old))
    return g.with_(nodes=g.nodes.withColumn("props", F.when(F.col("id") == node_id, merged).otherwise(F.col("props"))))


def set_node_property(g: PropertyGraph, node_id: str, key: str, value: Any) -> PropertyGraph:
    return update_node(g, node_id, **{key: value})


def first_of_pair(g: PropertyGraph) -> DataFrame:
    """One edge of each pair: the first."""
    first = Window.partitionBy("a", "b").orderBy("eord")
    return g.pairs().withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "a", "b")
