"""Connected components, weak and strong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators import small
from weft.operators.traversal import reach
from weft.plans.fixpoint import written
from weft.runtime import materialize


def min_labels(edges: DataFrame) -> DataFrame:
    """``a, component`` (the smallest reachable node) for every node of ``edges(a, b)``, taken both
    ways: alternating large-star and small-star rounds over ever shallower trees."""

    def star(rows: DataFrame) -> DataFrame:
        low = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return rows.join(low, "u")

    count = F.count(F.lit(1))
    mix = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    rows, mark = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star", n=count, h=mix)
    if small.fits(mark["n"]):
        return small.one_task([rows.select(F.col("u").alias("a"), F.col("v").alias("b"))], small.min_labels, "a long, component long")
    while mark["n"]:
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        shallow = star(large).select("u", F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("e"))
        rows, now = written(shallow.select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).filter("u <> v").distinct(), "small-star", n=count, h=mix)
        if now == mark:
            break
        mark = now
    return rows.select(F.col("u").alias("a"), F.col("v").alias("component")).unionByName(rows.select(F.col("v").alias("a"), F.col("v").alias("component")).distinct())


def connected_components(g: PropertyGraph) -> DataFrame:
    """``id, ord, component``: the component's smallest node order."""
    found = min_labels(g.indexed(symmetric=False))
    return g.nodes.select("id", "ord").join(found.withColumnRenamed("a", "ord"), "ord", "left").select("id", "ord", F.coalesce("component", "ord").alias("component"))


def num_connected_components(g: PropertyGraph) -> int:
    return connected_components(g).filter("component = ord").count()


def is_weakly_connected(g: PropertyGraph) -> bool:
    return num_connected_components(g) <= 1


is_connected = is_weakly_connected


def components_from_edges(spark: SparkSession, n_nodes: int, edges: DataFrame) -> DataFrame:
    """``node, component`` for nodes 0 to n-1 of integer pairs ``edges(a, b)``."""
    wrong = edges.select(F.explode(F.array("a", "b")).alias("a")).filter((F.col("a") < 0) | (F.col("a") >= n_nodes)).limit(1).collect()
    if wrong:
        raise ValueError(f"node {wrong[0]['a']} is out of range for {n_nodes} nodes")
    found = min_labels(edges)
    return spark.range(n_nodes).withColumnRenamed("id", "node").join(found.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def strong_labels(edges: DataFrame) -> DataFrame:
    """``a, component`` for the nodes of ``edges(a, b)`` that lie on a cycle with another node.

    Rounds of trimming and colouring: what has no way in or out of its live part is alone; colours
    (the largest node that reaches a node) spread forward, and within a colour what reaches its root
    backward is one component.
    """
    live, seen = written(edges.filter("a <> b").select("a", "b").distinct(), "scc-edges", n=F.count(F.lit(1)))
    if small.fits(seen["n"]):
        return small.one_task([live], small.strong_labels, "a long, component long")
    done = None
    while True:
        while True:  # trim
            both = live.select("a").distinct().intersect(live.select(F.col("b").alias("a")).distinct())
            cut, seen = written(live.join(both, "a", "left_semi").join(both.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "scc-live", n=F.count(F.lit(1)))
            if seen["n"] == live.count():
                break
            live = cut
        live = cut
        if not seen["n"]:
            break
        colour = materialize(live.select(F.explode(F.array("a", "b")).alias("a")).distinct().withColumn("c", F.col("a")), "colour")
        while True:
            got = live.join(colour, "a").groupBy("b").agg(F.max("c").alias("in"))
            new = colour.join(got.withColumnRenamed("b", "a"), "a", "left").select("a", F.greatest("c", F.coalesce("in", "c")).alias("c"), (F.coalesce("in", "c") > F.col("c")).alias("changed"))
            colour, seen = written(new, "colour", n=F.sum(F.col("changed").cast("long")))
            colour = colour.select("a", "c")
            if not seen["n"]:
                break
        one = live.join(colour, "a").join(colour.withColumnsRenamed({"a": "b", "c": "d"}), "b").filter("c = d")
        back = reach(one.select(F.col("b").alias("a"), F.col("a").alias("b")), colour.filter("a = c").select("a")).select("a")
        found = materialize(back.join(colour, "a").select("a", F.col("c").alias("component")), "scc-found")
        done = found if done is None else done.unionByName(found)
        live = materialize(live.join(found, "a", "left_anti").join(found.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"), "scc-edges")
    return done if done is not None else edges.select("a", F.col("a").alias("component")).limit(0)


def strongly_connected_components(g: PropertyGraph) -> DataFrame:
    """``id, ord, component``: the smallest node order of the component. Undirected: weak ones."""
    if not g.directed:
        return connected_components(g)
    found = strong_labels(g.indexed())
    label = g.nodes.select("id", "ord").join(found.withColumnRenamed("a", "ord"), "ord", "left").select("id", "ord", F.coalesce("component", "ord").alias("group"))
    least = label.groupBy("group").agg(F.min("ord").alias("component"))
    return label.join(least, "group").select("id", "ord", "component")


def is_strongly_connected(g: PropertyGraph) -> bool:
    n = g.n_nodes()
    if n <= 1:
        return True
    first = g.nodes.agg(F.min("ord").alias("a"))
    edges = materialize(g.indexed().select("a", "b"), "edges")
    if reach(edges, first).count() < n:
        return False
    return reach(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), first).count() == n
