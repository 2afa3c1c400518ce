"""Communities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.errors import LimitExceededError
from weft.graph import PropertyGraph
from weft.operators import small
from weft.operators.components import connected_components, min_labels
from weft.operators.kernels import louvain_kernel
from weft.operators.structure import maximal_cliques
from weft.plans.fixpoint import written
from weft.runtime import materialize, ship
from weft.settings import DEFAULTS


def label_propagation(g: PropertyGraph, max_rounds: int = 100) -> DataFrame:
    """``id, ord, label``: synchronous rounds over distinct neighbours of either direction; a node
    keeps its label where that is among the most frequent, else takes the smallest of these."""
    edges, seen = written(g.indexed(symmetric=True).select("a", "b").filter("a <> b").distinct(), "lpa-edges", n=F.count(F.lit(1)))
    if small.fits(seen["n"] + g.n_nodes()):
        found = small.one_task([edges, g.nodes.select(F.col("ord").alias("a"))], small.propagate(max_rounds), "ord long, label long")
        return g.nodes.select("id", "ord").join(found, "ord").select("id", "ord", "label")
    state = materialize(g.nodes.select(F.col("ord").alias("a"), F.col("ord").alias("label")), "labels")
    for _ in range(max_rounds):
        votes = edges.join(state.withColumnRenamed("a", "b"), "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        own = state.withColumnRenamed("label", "own")
        best = votes.join(own, "a").groupBy("a").agg(F.max(F.struct("n", (F.col("label") == F.col("own")).alias("stay"), (-F.col("label")).alias("low"))).alias("top"))
        new = own.join(best, "a", "left").select("a", F.coalesce(-F.col("top.low"), F.col("own")).alias("label"), (F.coalesce(-F.col("top.low"), F.col("own")) != F.col("own")).alias("moved"))
        state, seen = written(new, "labels", n=F.sum(F.col("moved").cast("long")))
        state = state.select("a", "label")
        if not seen["n"]:
            break
    return g.nodes.select("id", "ord").join(state.withColumnRenamed("a", "ord"), "ord").select("id", "ord", "label")


def louvain_communities(g: PropertyGraph, max_edges: int | None = None) -> DataFrame:
    """``id, ord, community``: greedy modularity over the edge property ``weight``, one connected
    component a task (communities never span components); the modularity total is the component's."""
    spark = g.nodes.sparkSession
    ship(spark)
    limit = DEFAULTS.max_kernel_edges if max_edges is None else max_edges
    label = materialize(connected_components(g).select(F.col("ord").alias("a"), "component"), "components")
    rows = materialize(g.indexed("weight", symmetric=False).join(label, "a").select("component", "a", "b", "w"), "louvain-edges")
    large = rows.groupBy("component").count().filter(F.col("count") > limit).limit(1).collect()
    if large:
        raise LimitExceededError(f"component {large[0]['component']} has {large[0]['count']} edges; the limit of this operator is {limit}")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        triples = sorted(zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist()))
        return pd.DataFrame(list(louvain_kernel(key[0], triples)), columns=["ord", "community"])

    found = rows.groupBy("component").applyInPandas(run, "ord long, community long")
    return g.nodes.select("id", "ord").join(found, "ord", "left").select("id", "ord", F.coalesce("community", "ord").alias("community"))


def k_clique_communities(g: PropertyGraph, k: int, max_input_nodes: int = DEFAULTS.max_clique_nodes) -> DataFrame:
    """``community, id``: nodes of cliques of ``k`` or more that are linked by overlaps of ``k`` - 1;
    communities may overlap. Below 2 these are the connected components."""
    if k < 2:
        return connected_components(g).select(F.col("component").alias("community"), "id")
    rows = materialize(maximal_cliques(g, max_input_nodes=max_input_nodes).groupBy("clique").agg(F.collect_set("id").alias("ids")).filter(F.size("ids") >= k).select("clique", F.explode("ids").alias("id")), "cliques")
    left, right = rows.alias("l"), rows.alias("r")
    links = left.join(right, F.col("l.id") == F.col("r.id")).filter("l.clique < r.clique").groupBy(F.col("l.clique").alias("a"), F.col("r.clique").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k - 1)
    label = min_labels(links.select("a", "b")).withColumnRenamed("a", "clique")
    return rows.join(label, "clique", "left").select(F.coalesce("component", "clique").alias("community"), "id").distinct()
