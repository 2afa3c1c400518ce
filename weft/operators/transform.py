"""Graphs from graphs: induced parts, reversal, merging, differences, condensation, closures."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import props as P
from weft.graph import PropertyGraph, numbered
from weft.operators.mutate import first_of_pair
from weft.plans.fixpoint import written
from weft.runtime import materialize


def induced(g: PropertyGraph, keep: DataFrame, ordered: bool = False) -> PropertyGraph:
    """The part of ``g`` on the nodes ``keep(id[, ord])``; an undirected part loses parallel edges."""
    if ordered:
        nodes = g.nodes.drop("ord").join(keep.select("id", "ord"), "id").select("id", "ord", "props")
    else:
        nodes = g.nodes.join(keep.select("id"), "id", "left_semi")
    ids = keep.select("id")
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "eord", "props")
    out = g.with_(nodes=nodes, edges=edges)
    return out if g.directed else out.with_(edges=first_of_pair(out))


def subgraph(g: PropertyGraph, node_ids: list[str]) -> PropertyGraph:
    """Nodes in the order of the list; unknown and repeated ids are ValueErrors."""
    if len(set(node_ids)) < len(node_ids):
        raise ValueError("duplicate node in the list")
    g.require(*node_ids, error=ValueError)
    keep = g.nodes.sparkSession.createDataFrame([(n, k) for k, n in enumerate(node_ids)], "id string, ord long")
    return induced(g, keep, ordered=True)


def ego_graph(g: PropertyGraph, center: str, radius: int = 1) -> PropertyGraph:
    """Nodes within ``radius`` steps in either direction."""
    from weft.operators.traversal import reach

    g.require(center)
    seeds = g.nodes.filter(F.col("id") == center).select(F.col("ord").alias("a"))
    near = g.named(reach(g.indexed(symmetric=True), seeds, max_depth=radius).select("a"))
    return induced(g, near)


def reverse(g: PropertyGraph) -> PropertyGraph:
    if not g.directed:
        return g.with_(edges=first_of_pair(g))
    return g.with_(edges=g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "eord", "props"))


def to_undirected(g: PropertyGraph) -> PropertyGraph:
    """The first edge of each unordered pair."""
    plain = g.with_(directed=False)
    return plain.with_(edges=first_of_pair(plain))


def _resolve(conflict: str, old: Column, new: Column) -> Column:
    if conflict == "keep_first":
        both = old
    elif conflict == "merge":
        both = F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))
    else:
        both = new
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(both)


def merge_graphs(base: PropertyGraph, other: PropertyGraph, conflict: str = "keep_latest") -> PropertyGraph:
    """The union. Conflicts: keep_first, merge, or else keep_latest. The result is simple and unnamed."""
    shift = F.lit((base.nodes.agg(F.max("ord")).first()[0] or 0) + 1)
    a, b = base.nodes.alias("a"), other.nodes.alias("b")
    nodes = a.join(b, "id", "full_outer").select("id", F.coalesce("a.ord", F.col("b.ord") + shift).alias("ord"), _resolve(conflict, F.col("a.props"), F.col("b.props")).alias("props"))
    step = F.lit((base.edges.agg(F.max("eord")).first()[0] or 0) + 1)
    x = base.edges.groupBy("src", "dst").agg(F.min("eord").alias("eord"), F.min_by("props", "eord").alias("props")).alias("x")
    y = other.edges.groupBy("src", "dst").agg(F.min("eord").alias("eord"), F.max_by("props", "eord").alias("props")).alias("y")
    edges = x.join(y, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("x.eord", F.col("y.eord") + step).alias("eord"), _resolve(conflict, F.col("x.props"), F.col("y.props")).alias("props"))
    out = PropertyGraph(nodes, edges, base.directed)
    return out if out.directed else out.with_(edges=first_of_pair(out))


def diff_graphs(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    """``kind, id, src, dst``: added_node, removed_node, changed_node, added_edge, removed_edge."""
    a, b = old.nodes.select("id", "props"), new.nodes.select("id", F.col("props").alias("own"))
    none = F.lit(None).cast("string")
    node = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", none.alias("src"), none.alias("dst"))
    edge = lambda df, kind: df.select(F.lit(kind).alias("kind"), none.alias("id"), "src", "dst")
    flat = lambda c: F.array_sort(F.map_entries(c))
    e, f = old.edges.select("src", "dst").distinct(), new.edges.select("src", "dst").distinct()
    return (
        node(b.join(a, "id", "left_anti"), "added_node")
        .unionByName(node(a.join(b, "id", "left_anti"), "removed_node"))
        .unionByName(node(a.join(b, "id").filter(~flat(F.col("props")).eqNullSafe(flat(F.col("own")))), "changed_node"))
        .unionByName(edge(f.join(e, ["src", "dst"], "left_anti"), "added_edge"))
        .unionByName(edge(e.join(f, ["src", "dst"], "left_anti"), "removed_edge"))
    )


def by_types(g: PropertyGraph, types: list[str]) -> PropertyGraph:
    return induced(g, g.nodes.filter(P.string(F.col("props")["type"]).isin(*types) if types else F.lit(False)))


def by_property(g: PropertyGraph, key: str, value: Any) -> PropertyGraph:
    return induced(g, g.nodes.filter(P.strictly_equals(F.col("props"), key, value)))


def extract_subgraph(g: PropertyGraph, *, node_types: list[str] | None = None, edge_types: list[str] | None = None, **properties: Any) -> PropertyGraph:
    """By node types, then node properties, then edges whose predicate (else type) is listed."""
    if node_types is not None:
        g = by_types(g, node_types)
    for key, value in properties.items():
        g = by_property(g, key, value)
    if edge_types is not None:
        kind = F.coalesce(P.truthy_string(F.col("props")["predicate"]), P.string(F.col("props")["type"]))
        g = g.with_(edges=g.edges.filter(kind.isin(*edge_types) if edge_types else F.lit(False)))
    return g


def condensation(g: PropertyGraph) -> PropertyGraph:
    """A node for each strongly connected component, named by its sorted ids."""
    from weft.operators.components import connected_components, strongly_connected_components

    label = materialize(strongly_connected_components(g) if g.directed else connected_components(g), "scc")
    names = materialize(label.groupBy("component").agg(F.concat_ws(",", F.sort_array(F.collect_list("id"))).alias("id"), F.min("ord").alias("ord")), "names")
    nodes = names.select("id", "ord", P.no_props().alias("props"))
    if not g.directed:
        return PropertyGraph(nodes, g.edges.limit(0), True)
    of = label.select("id", "component").join(names.select("component", F.col("id").alias("group")), "component").select("id", "group")
    cross = g.edges.join(of.withColumnsRenamed({"id": "src", "group": "s"}), "src").join(of.withColumnsRenamed({"id": "dst", "group": "d"}), "dst").filter("s <> d").groupBy("s", "d").agg(F.min("eord").alias("eord"))
    return PropertyGraph(nodes, cross.select(F.col("s").alias("src"), F.col("d").alias("dst"), "eord", P.no_props().alias("props")), True)


def closure_pairs(edges: DataFrame) -> DataFrame:
    """All ``a, b`` with a path of one or more edges from a to b, by path doubling."""
    known, seen = written(edges.select("a", "b").distinct(), "closure", n=F.count(F.lit(1)))
    size = seen["n"]
    while True:
        step = known.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        known, seen = written(known.unionByName(step).distinct(), "closure", n=F.count(F.lit(1)))
        if seen["n"] == size:
            return known
        size = seen["n"]


def _with_new(g: PropertyGraph, pairs: DataFrame, edges: DataFrame, props: Column) -> PropertyGraph:
    new = numbered(pairs, ["src", "dst"], "eord") if pairs is not None else None
    shift = (edges.agg(F.max("eord")).first()[0] or 0) + 1
    return PropertyGraph(g.nodes, edges.unionByName(new.select("src", "dst", (F.col("eord") + shift).alias("eord"), props.alias("props"))), g.directed)


def transitive_closure(g: PropertyGraph) -> PropertyGraph:
    """With an edge for every reachable other node; undirected components become complete."""
    first = first_of_pair(g)
    pairs = closure_pairs(g.indexed()).filter("a <> b")
    if not g.directed:
        pairs = pairs.filter("a < b")
    pairs = g.named(g.named(pairs, "a", "src"), "b", "dst")
    known = first.select("src", "dst")
    if not g.directed:
        known = known.unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _with_new(g, pairs.join(known, ["src", "dst"], "left_anti"), first, P.no_props())


def transitive_reduction(g: PropertyGraph) -> PropertyGraph:
    """Of a DAG, without the edges that a longer path replaces; a cycle is a ValueError."""
    from weft.operators.dag import is_dag

    if not is_dag(g):
        raise ValueError("transitive reduction needs a directed graph without cycles")
    edges = g.indexed().select("a", "b").distinct()
    far = closure_pairs(edges)
    longer = edges.select("a", F.col("b").alias("m")).join(far.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
    drop = g.named(g.named(longer, "a", "src"), "b", "dst")
    return PropertyGraph(g.nodes, first_of_pair(g).join(drop, ["src", "dst"], "left_anti").select("src", "dst", "eord", "props"), True)


def infer_types(g: PropertyGraph, predicate: str) -> PropertyGraph:
    """With an edge for every path of edges of ``predicate``, unless some edge links the pair."""
    own = g.with_(edges=g.edges.filter(P.predicate(F.col("props"), "infer") == predicate))
    pairs = g.named(g.named(closure_pairs(own.indexed(symmetric=False)), "a", "src"), "b", "dst")
    new = pairs.join(g.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return _with_new(g, new, g.edges, P.literal_map({"predicate": predicate, "type": predicate})).with_(multi=g.multi, name=g.name)


densify = infer_types


def project_triples(g: PropertyGraph) -> DataFrame:
    """``s, p, o`` for every edge."""
    return g.edges.select(F.col("src").alias("s"), P.predicate(F.col("props"), "triples").alias("p"), F.col("dst").alias("o"))


def from_triples(triples: DataFrame, directed: bool = True) -> PropertyGraph:
    """From ``s, p, o[, eord]``: the first triple of each pair; nodes in order of appearance."""
    rows = triples if "eord" in triples.columns else numbered(triples, ["s", "p", "o"], "eord")
    rows = materialize(rows.select("s", "p", "o", "eord"), "triples")
    both = rows.select(F.explode(F.array(F.struct(F.col("s").alias("id"), (2 * F.col("eord")).alias("at")), F.struct(F.col("o").alias("id"), (2 * F.col("eord") + 1).alias("at")))).alias("n")).groupBy("n.id").agg(F.min("n.at").alias("at"))
    nodes = numbered(both, ["at"], "ord").select("id", "ord", P.no_props().alias("props"))
    quoted = P.quote(F.col("p"))
    edges = rows.select(F.col("s").alias("src"), F.col("o").alias("dst"), "eord", F.create_map(F.lit("predicate"), quoted, F.lit("type"), quoted).alias("props"))
    out = PropertyGraph(nodes, edges, directed)
    return out.with_(edges=first_of_pair(out))
