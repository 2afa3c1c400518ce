"""Density, bipartiteness, cut structure, matchings and cliques."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.errors import LimitExceededError
from weft.graph import PropertyGraph
from weft.operators.components import connected_components, min_labels
from weft.operators.kernels import articulation_kernel, bridge_kernel, clique_kernel, matching_kernel, per_component
from weft.plans.fixpoint import written
from weft.runtime import materialize
from weft.settings import DEFAULTS


def density(g: PropertyGraph) -> float:
    n, e = g.n_nodes(), g.n_edges()
    return 0.0 if n <= 1 else (1 if g.directed else 2) * e / (n * (n - 1))


def degree_distribution(g: PropertyGraph) -> DataFrame:
    return g.degrees().groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def find_orphan_nodes(g: PropertyGraph) -> DataFrame:
    """``id`` of nodes without any edge; two anti joins, no counting."""
    return g.nodes.join(g.edges.select(F.col("src").alias("id")), "id", "left_anti").join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "ord")


def find_hub_nodes(g: PropertyGraph, threshold: int) -> DataFrame:
    return g.degrees().filter(F.col("degree") > threshold).select("id", "ord", "degree")


def is_bipartite(g: PropertyGraph) -> bool:
    """No node is connected to its own copy in the double cover; directions do not matter."""
    pairs = g.indexed(symmetric=False)
    cover = pairs.select(F.explode(F.array(F.struct((2 * F.col("a")).alias("a"), (2 * F.col("b") + 1).alias("b")), F.struct((2 * F.col("a") + 1).alias("a"), (2 * F.col("b")).alias("b")))).alias("e")).select("e.a", "e.b")
    label = materialize(min_labels(cover), "cover")
    odd = label.filter("a % 2 = 1").select((F.col("a") - 1).alias("a"), F.col("component").alias("other"))
    return not label.join(odd, "a").filter("component = other").limit(1).count()


def _components(g: PropertyGraph) -> DataFrame:
    label = connected_components(g).select(F.col("ord").alias("a"), "component")
    return g.indexed(symmetric=False).join(label, "a").select("component", "a", "b")


def bridges(g: PropertyGraph, max_edges: int | None = None) -> DataFrame:
    """``src, dst`` of edges whose removal splits a component, as stored; a pair with several edges
    (either way) is none."""
    found = per_component(_components(g), bridge_kernel, "a long, b long", max_edges)
    return g.named(g.named(found, "a", "src"), "b", "dst")


def articulation_points(g: PropertyGraph, max_edges: int | None = None) -> DataFrame:
    return g.named(per_component(_components(g), articulation_kernel, "a long", max_edges))


def greedy_matching(g: PropertyGraph) -> DataFrame:
    """``src, dst`` of a maximal matching: in each round every node names its smallest free
    neighbour, and edges that both ends name are taken. The smallest free edge is always one, so
    every round takes some."""
    live = materialize(g.indexed(symmetric=False).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "match-edges")
    taken = None
    while True:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pick = both.groupBy("a").agg(F.min("b").alias("b"))
        back = pick.select(F.col("b").alias("a"), F.col("a").alias("b"))
        new, seen = written(pick.join(back, ["a", "b"], "left_semi").filter("a < b"), "matched", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        taken = new if taken is None else taken.unionByName(new)
        gone = new.select(F.explode(F.array("a", "b")).alias("a"))
        live = materialize(live.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"), "match-edges")
    found = taken if taken is not None else live
    return g.named(g.named(found, "a", "src"), "b", "dst")


def maximum_matching(g: PropertyGraph, max_edges: int | None = None) -> DataFrame:
    """``src, dst`` of a matching with as many edges as possible."""
    found = per_component(_components(g), matching_kernel, "a long, b long", max_edges)
    return g.named(g.named(found, "a", "src"), "b", "dst")


def maximal_cliques(g: PropertyGraph, max_input_nodes: int = DEFAULTS.max_clique_nodes, max_cliques: int = DEFAULTS.max_cliques) -> DataFrame:
    """``clique, id``; refused above ``max_input_nodes`` nodes, cut at ``max_cliques`` cliques. A
    node without neighbours is a clique."""
    if g.nodes.limit(max_input_nodes + 1).count() > max_input_nodes:
        raise LimitExceededError(f"the graph has more than {max_input_nodes} nodes")
    rows = _components(g).unionByName(connected_components(g).select("component", F.col("ord").alias("a"), F.col("ord").alias("b")))
    found = materialize(per_component(rows, clique_kernel(max_cliques), "component long, at long, a long"), "cliques")
    few = found.select("component", "at").distinct().orderBy("component", "at").limit(max_cliques)
    rows = found.join(few, ["component", "at"], "left_semi").select((F.col("component") * max_cliques + F.col("at")).alias("clique"), "a")
    return g.named(rows)
