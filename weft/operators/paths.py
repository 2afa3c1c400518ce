"""Shortest paths by relaxation, simple paths by extension, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators import small
from weft.operators.components import strongly_connected_components
from weft.operators.kernels import cycle_kernel, per_component
from weft.operators.traversal import reach
from weft.plans.fixpoint import written
from weft.runtime import materialize
from weft.settings import DEFAULTS


def relax(edges: DataFrame, source: int, max_rounds: int | None = None) -> tuple[DataFrame, bool]:
    """``a, cost, via`` of what ``source`` reaches over ``edges(a, b, w)``, and whether it settled.

    Only nodes whose cost fell in the last round send on; ties go to the smaller predecessor.
    """
    spark = edges.sparkSession
    edges, seen = written(edges.groupBy("a", "b").agg(F.min("w").alias("w")), "weights", n=F.count(F.lit(1)), low=F.min("w"))
    if small.fits(seen["n"]) and (max_rounds is not None or (seen["low"] or 0.0) >= 0.0):
        found = materialize(small.one_task([edges], small.relax(source, max_rounds or seen["n"] + 2), "a long, cost double, via long, open boolean"), "costs")
        return found.select("a", "cost", F.when(F.col("via") >= 0, F.col("via")).alias("via")), not found.filter("open").limit(1).count()
    state = materialize(spark.createDataFrame([(source, 0.0, None, True)], "a long, cost double, via long, fresh boolean"), "costs")
    turn = 0
    while max_rounds is None or turn < max_rounds:
        turn += 1
        got = state.filter("fresh").select("a", "cost").join(edges, "a").groupBy("b").agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("a").alias("via"))).alias("new"))
        both = state.drop("fresh").join(got.withColumnRenamed("b", "a"), "a", "full_outer")
        better = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new.cost") < F.col("cost")))
        state, seen = written(both.select("a", F.when(better, F.col("new.cost")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("new.via")).otherwise(F.col("via")).alias("via"), better.alias("fresh")), "costs", n=F.sum(F.col("fresh").cast("long")))
        if not seen["n"]:
            return state.drop("fresh"), True
    return state.drop("fresh"), False


def _ord(g: PropertyGraph, node_id: str) -> int:
    g.require(node_id)
    return g.nodes.filter(F.col("id") == node_id).first()["ord"]


def shortest_paths(g: PropertyGraph, source: str, target: str | None = None, weight: str | None = None) -> DataFrame:
    """``id, cost``; weights must not be negative."""
    found, _ = relax(g.indexed(weight), _ord(g, source))
    rows = g.named(found.select("a", "cost")).select("id", "cost")
    return rows if target is None else rows.filter(F.col("id") == target)


def shortest_path_length(g: PropertyGraph, source: str, target: str, weight: str | None = None) -> float | None:
    g.require(target)
    row = shortest_paths(g, source, target, weight).first()
    return row["cost"] if row else None


def astar_path(g: PropertyGraph, source: str, target: str, weight: str | None = None) -> tuple[float, list[str]] | None:
    """Cost and nodes of a shortest path; None where there is none."""
    start, at = _ord(g, source), _ord(g, target)
    found, _ = relax(g.indexed(weight), start)
    row = found.filter(F.col("a") == at).first()
    if row is None:
        return None
    cost, path = row["cost"], [at]
    while path[-1] != start:  # as many look-ups as the path has nodes
        path.append(found.filter(F.col("a") == path[-1]).first()["via"])
    names = {r["ord"]: r["id"] for r in g.nodes.filter(F.col("ord").isin(path)).select("id", "ord").collect()}
    return cost, [names[a] for a in reversed(path)]


def bellman_ford_paths(g: PropertyGraph, source: str, weight: str | None = None) -> DataFrame:
    """``id, cost`` with negative weights allowed, along stored orientations; a negative cycle that
    the source reaches is a ValueError, and so is a missing source."""
    g.require(source, error=ValueError)
    found, settled = relax(g.indexed(weight, symmetric=False), _ord(g, source), max_rounds=max(1, g.n_nodes()))
    if not settled:
        raise ValueError("negative cycle")
    return g.named(found.select("a", "cost")).select("id", "cost")


def all_simple_paths(g: PropertyGraph, source: str, target: str, max_depth: int = DEFAULTS.max_path_nodes, max_paths: int = DEFAULTS.max_simple_paths) -> DataFrame:
    """``path array<string>`` of at most ``max_depth`` nodes (a direct edge always counts), in order of
    their ids; parallel edges do not repeat a path. Only nodes that reach the target are walked."""
    start, goal = _ord(g, source), _ord(g, target)
    spark = g.nodes.sparkSession
    edges = materialize(g.indexed().select("a", "b"), "path-edges")
    useful = reach(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), spark.createDataFrame([(goal,)], "a long")).select(F.col("a").alias("b"))
    edges = materialize(edges.join(useful, "b", "left_semi").select("a", "b"), "path-edges")
    live = spark.createDataFrame([(start, [start])], "a long, path array<long>")
    out = None
    for _ in range(max(1, max_depth - 1)):
        step = live.join(edges, "a").filter(~F.array_contains("path", F.col("b")) | ((F.col("b") == goal) & (F.lit(start == goal)) & (F.size("path") > 0)))
        grown, seen = written(step.select(F.col("b").alias("a"), F.concat("path", F.array("b")).alias("path")), "simple", n=F.count(F.lit(1)))
        hit = grown.filter(F.col("a") == goal).select("path")
        out = hit if out is None else out.unionByName(hit)
        live = grown.filter(F.col("a") != goal)
        if not seen["n"]:
            break
    spread = materialize(out.distinct(), "paths").select(F.col("path").alias("k"), F.posexplode("path").alias("at", "a"))
    rows = g.named(spread).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("path"))
    return rows.select("path").orderBy("path").limit(max_paths)


def find_cycles(g: PropertyGraph) -> DataFrame:
    """``component, ids array<string>`` of each strongly connected part that holds a cycle."""
    if not g.directed:
        return g.nodes.limit(0).select(F.col("ord").alias("component"), F.array("id").alias("ids"))
    label = materialize(strongly_connected_components(g), "scc")
    loops = g.edges.filter("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    rows = label.join(loops, "id", "left").groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max(F.coalesce("loop", F.lit(False))).alias("loop"))
    return rows.filter((F.size("ids") > 1) | F.col("loop")).select("component", "ids")


def find_cycle_paths(g: PropertyGraph, max_edges: int | None = None) -> DataFrame:
    """``component, path array<string>``: one cycle of each part that holds one, from its first node."""
    if not g.directed:
        return g.nodes.limit(0).select(F.col("ord").alias("component"), F.array("id").alias("path"))
    label = materialize(strongly_connected_components(g).select(F.col("ord").alias("a"), "component"), "scc")
    rows = g.indexed().select("a", "b").distinct().join(label, "a").join(label.withColumnsRenamed({"a": "b", "component": "other"}), "b").filter("component = other").select("component", "a", "b")
    found = per_component(rows, cycle_kernel, "component long, at long, a long", max_edges)
    return g.named(found).groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("path"))
