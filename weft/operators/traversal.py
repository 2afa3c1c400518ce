"""Breadth-first walks as frontier joins, depth-first walks as a kernel over the reachable part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators import small
from weft.operators.kernels import dfs_kernel, per_component
from weft.plans.fixpoint import written
from weft.runtime import materialize


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``a, depth`` of all nodes within ``max_depth`` steps of ``seeds(a)`` along ``edges(a, b)``.

    A round joins the frontier alone to the edges; the nodes seen so far grow by a union of written
    tables, and a round's new nodes are the frontier's targets that are not among them.
    """
    edges, seen = written(edges.select("a", "b").filter("a <> b").distinct(), "reach-edges", n=F.count(F.lit(1)))
    if small.fits(seen["n"]) and dict(edges.dtypes)["a"] == "bigint":
        return small.one_task([edges, seeds.select("a")], small.reach(max_depth), "a long, depth long")
    frontier, seen = written(seeds.select("a").distinct().withColumn("depth", F.lit(0).cast("long")), "frontier", n=F.count(F.lit(1)))
    visited, depth = frontier, 0
    while seen["n"] and (max_depth is None or depth < max_depth):
        depth += 1
        step = frontier.select("a").join(edges, "a").select(F.col("b").alias("a")).distinct().join(visited.select("a"), "a", "left_anti")
        frontier, seen = written(step.withColumn("depth", F.lit(depth).cast("long")), "frontier", n=F.count(F.lit(1)))
        visited = visited.unionByName(frontier)
        if depth % 16 == 0:
            visited = materialize(visited, "visited")  # few tables under one union
    return visited


def _from(g: PropertyGraph, source: str) -> DataFrame:
    g.require(source)
    return g.nodes.filter(F.col("id") == source).select(F.col("ord").alias("a"))


def bfs_with_depth(g: PropertyGraph, source: str) -> DataFrame:
    """``id, depth, ord`` of all reachable nodes."""
    rows = reach(g.indexed(), _from(g, source))
    return rows.join(g.nodes.select("id", "ord", F.col("ord").alias("a")), "a").select("id", "depth", "ord")


def bfs(g: PropertyGraph, source: str) -> DataFrame:
    """Ids by depth, then by node order."""
    return bfs_with_depth(g, source).orderBy("depth", "ord").select("id")


def bfs_at_depth(g: PropertyGraph, source: str, depth: int) -> DataFrame:
    rows = reach(g.indexed(), _from(g, source), max_depth=depth).filter(F.col("depth") == depth)
    return g.named(rows.select("a"))


def has_path(g: PropertyGraph, source: str, target: str) -> bool:
    """Whether a walk leads from source to target; the frontier stops when it meets the target."""
    g.require(source, target)
    if source == target:
        return True
    goal = g.nodes.filter(F.col("id") == target).first()["ord"]
    edges = materialize(g.indexed().select("a", "b").distinct(), "path-edges")
    frontier = materialize(_from(g, source), "frontier")
    visited = frontier
    while True:
        step = frontier.join(edges, "a").select(F.col("b").alias("a")).distinct().join(visited, "a", "left_anti")
        frontier, seen = written(step, "frontier", n=F.count(F.lit(1)), hit=F.max(F.col("a") == goal))
        if seen["hit"]:
            return True
        if not seen["n"]:
            return False
        visited = materialize(visited.unionByName(frontier), "visited")


def relatives(g: PropertyGraph, node_id: str, forward: bool) -> DataFrame:
    """``id`` of what a walk of one or more steps reaches; the node itself where it lies on a cycle."""
    g.require(node_id)
    edges = materialize(g.indexed().select(*(("a", "b") if forward or not g.directed else (F.col("b").alias("a"), F.col("a").alias("b")))), "edges")
    first = _from(g, node_id).join(edges, "a").select(F.col("b").alias("a")).distinct()
    return g.named(reach(edges, first).select("a"))


def ancestors(g: PropertyGraph, node_id: str) -> DataFrame:
    return relatives(g, node_id, False)


def descendants(g: PropertyGraph, node_id: str) -> DataFrame:
    return relatives(g, node_id, True)


def dfs_events(g: PropertyGraph, source: str, max_edges: int | None = None) -> DataFrame:
    """``seq, id, event``: enter and exit of each node, children in node order."""
    start = _from(g, source).first()["a"]
    edges = materialize(g.indexed().select("a", "b").distinct(), "dfs-edges")
    near = reach(edges, _from(g, source)).select("a")
    own = edges.join(near, "a", "left_semi")
    rows = own.unionByName(g.nodes.filter(F.col("ord") == start).select(F.col("ord").alias("a"), F.col("ord").alias("b"))).withColumn("component", F.lit(0).cast("long"))
    found = per_component(rows, dfs_kernel(start), "seq long, a long, event string", max_edges)
    return g.named(found).select("seq", "id", "event").orderBy("seq")


def dfs(g: PropertyGraph, source: str) -> DataFrame:
    """``seq, id`` in preorder."""
    return dfs_events(g, source).filter("event = 'enter'").select("seq", "id")
