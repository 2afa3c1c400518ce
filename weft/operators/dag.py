"""Directed acyclic graphs: peeling, order, longest and critical paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import WeightError
from weft.functions import props as P
from weft.graph import PropertyGraph
from weft.operators import small
from weft.plans.fixpoint import written
from weft.runtime import materialize


def peel(g: PropertyGraph) -> tuple[DataFrame, int]:
    """``a, level`` of the nodes that Kahn's peeling removes, and how many it cannot."""
    left, seen = written(g.nodes.select(F.col("ord").alias("a")), "left", n=F.count(F.lit(1)))
    edges, own = written(g.indexed().select("a", "b"), "dag-edges", n=F.count(F.lit(1)))
    if small.fits(own["n"] + seen["n"]):
        found, seen = written(small.one_task([edges, left], small.peel, "a long, level long"), "levels", n=F.sum((F.col("level") < 0).cast("long")))
        return found.filter("level >= 0"), seen["n"] or 0
    out, level, rest = None, 0, seen["n"]
    while rest:
        heads = edges.select(F.col("b").alias("a")).distinct()
        gone = materialize(left.join(heads, "a", "left_anti").withColumn("level", F.lit(level).cast("long")), "peeled")
        left, seen = written(left.join(heads, "a", "left_semi"), "left", n=F.count(F.lit(1)))
        if seen["n"] == rest:
            return (out if out is not None else gone), rest
        edges = materialize(edges.join(gone, "a", "left_anti"), "dag-edges")
        out = gone if out is None else out.unionByName(gone)
        rest, level = seen["n"], level + 1
    empty = g.nodes.limit(0).select(F.col("ord").alias("a"), F.lit(0).cast("long").alias("level"))
    return (out if out is not None else empty), 0


def is_dag(g: PropertyGraph) -> bool:
    return g.directed and peel(g)[1] == 0


def is_tree(g: PropertyGraph) -> bool:
    """Connected with one edge less than nodes; directed: no cycle and at most one way in as well."""
    from weft.operators.components import is_connected

    n = g.n_nodes()
    if n == 0:
        return True
    if g.n_edges() != n - 1 or not is_connected(g):
        return False
    if not g.directed:
        return True
    return (g.degrees().agg(F.max("in_degree")).first()[0] or 0) <= 1 and is_dag(g)


def topological_sort(g: PropertyGraph) -> DataFrame:
    """``id, level`` by level, then node order; a cycle or an undirected graph is a ValueError."""
    if not g.directed:
        raise ValueError("topological order needs a directed graph")
    levels, rest = peel(g)
    if rest:
        lost = g.nodes.select("id", F.col("ord").alias("a")).join(levels, "a", "left_anti").orderBy("a").first()
        raise ValueError(f"the graph has a cycle; {lost['id']!r} is on or behind it")
    return g.named(levels).join(g.nodes.select("id", "ord"), "id").orderBy("level", "ord").select("id", "level")


def heaviest_path(g: PropertyGraph, gain: Column | None) -> tuple[float, list[str]]:
    """The largest sum of node gains along a path (``gain`` over ``props``; None: edges count one).

    Relaxation in rounds of one edge; the predecessor is kept for the way back.
    """
    levels, rest = peel(g)
    if rest or not g.directed:
        raise ValueError("longest paths need a directed graph without cycles")
    own = F.lit(1.0) if gain is None else gain
    start = F.lit(0.0) if gain is None else own
    state = materialize(g.nodes.join(levels, g.nodes["ord"] == levels["a"]).select(F.col("ord").alias("a"), "level", own.alias("gain"), start.alias("best"), F.lit(None).cast("long").alias("via")), "paths")
    top = state.agg(F.max("level")).first()[0]
    if top is None:
        return 0.0, []
    edges = materialize(g.indexed().select("a", "b").distinct(), "edges")
    for level in range(1, top + 1):
        got = state.select("a", "best").join(edges, "a").groupBy("b").agg(F.max(F.struct("best", (-F.col("a")).alias("from"))).alias("top"))
        new = state.join(got.withColumnRenamed("b", "a"), "a", "left")
        now = (F.col("level") == level) & F.col("top").isNotNull() & ((F.lit(True)) if gain is None else (F.col("top.best") + F.col("gain") > F.col("best")))
        state = materialize(new.select("a", "level", "gain", F.when(now, F.col("top.best") + F.col("gain")).otherwise(F.col("best")).alias("best"), F.when(now, -F.col("top.from")).otherwise(F.col("via")).alias("via")), "paths")
    end = state.orderBy(F.desc("best"), "a").first()
    path, at = [], end["a"]
    while at is not None:  # as many look-ups as the path has nodes
        path.append(at)
        at = state.filter(F.col("a") == at).first()["via"]
    names = {r["ord"]: r["id"] for r in g.nodes.filter(F.col("ord").isin(path)).select("id", "ord").collect()}
    return float(end["best"]), [names[a] for a in reversed(path)]


def longest_path(g: PropertyGraph) -> tuple[int, list[str]]:
    """Edges and nodes of a longest path; (0, []) of the empty graph."""
    best, path = heaviest_path(g, None)
    return int(best), path


def critical_path(g: PropertyGraph, weight: str = "latency_ms") -> tuple[float, list[str]]:
    """The path with the largest sum of node weights; missing weights are zero."""
    try:
        return heaviest_path(g, P.node_weight(F.col("props"), weight))
    except ValueError:
        raise
    except Exception as e:
        if "node weight" in str(e):
            raise WeightError(str(e).splitlines()[0]) from e
        raise
