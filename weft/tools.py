"""Stateless endpoints: JSON text in, plain dictionaries out, errors as ``{"error": ...}``.

Each call reads its graph anew and answers small questions; rankings are cut to ``TOP`` rows. For
large graphs use the operators on stored tables instead.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from weft.functions import props as P
from weft.graph import PropertyGraph
from weft.operators import centrality, community, components, dag, paths, schema, structure, transform, traversal
from weft.plans import sparql as sparql_plan
from weft.settings import DEFAULTS, Settings
from weft.sources import documents, rdf, tables

TOP = 20
TOOLS: dict[str, Callable[..., dict[str, Any]]] = {}


def tool(f):
    """Register ``f``; what it raises becomes a structured error."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> dict[str, Any]:
        try:
            return f(*args, **kwargs)
        except Exception as e:
            return {"error": type(e).__name__, "message": str(e)}

    TOOLS[f.__name__] = run
    return run


def _graph(spark: SparkSession, text: str, settings: Settings) -> PropertyGraph:
    return documents.from_json(spark, text, settings)


def _summary(g: PropertyGraph) -> dict[str, Any]:
    return {"graph_data": documents.to_json(g), "n_nodes": g.n_nodes(), "n_edges": g.n_edges(), "is_directed": g.directed}


def _ids(df, column: str = "id") -> list:
    return [r[column] for r in df.collect()]


@tool
def create(spark: SparkSession, data: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    return _summary(documents.from_inline_json(spark, data, settings))


@tool
def query(spark: SparkSession, graph_json: str, kind: str, node_id: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    """``kind``: node, neighbors, successors or predecessors."""
    g = _graph(spark, graph_json, settings)
    if kind == "node":
        g.require(node_id)
        return {"node": g.node(node_id), "degree": g.degree(node_id)}
    if kind not in ("neighbors", "successors", "predecessors"):
        raise ValueError(f"unknown query {kind!r}")
    found = _ids(getattr(g, kind)(node_id))
    return {kind: found, "count": len(found)}


@tool
def info(spark: SparkSession, graph_json: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    g = _graph(spark, graph_json, settings)
    return {"name": g.name, "is_directed": g.directed, "is_multi": g.multi, "n_nodes": g.n_nodes(), "n_edges": g.n_edges(), "is_dag": dag.is_dag(g), "is_connected": components.is_connected(g), "is_tree": dag.is_tree(g), "density": structure.density(g)}


@tool
def stats(spark: SparkSession, graph_json: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    from pyspark.sql import functions as F

    g = _graph(spark, graph_json, settings)
    row = g.degrees().agg(F.avg("degree").alias("avg"), F.max("degree").alias("max")).first()
    return {"node_count": g.n_nodes(), "edge_count": g.n_edges(), "density": structure.density(g), "avg_degree": round(row["avg"] or 0.0, 4), "max_degree": row["max"] or 0, "is_dag": dag.is_dag(g), "connected_components": components.num_connected_components(g), "is_directed": g.directed}


@tool
def transform_graph(spark: SparkSession, graph_json: str, operation: str, node_ids: list[str] | None = None, center: str | None = None, radius: int = 1, settings: Settings = DEFAULTS) -> dict[str, Any]:
    """``operation``: subgraph, ego_graph, reverse, to_undirected or condensation."""
    g = _graph(spark, graph_json, settings)
    run = {
        "subgraph": lambda: transform.subgraph(g, node_ids or []),
        "ego_graph": lambda: transform.ego_graph(g, center or "", radius),
        "reverse": lambda: transform.reverse(g),
        "to_undirected": lambda: transform.to_undirected(g),
        "condensation": lambda: transform.condensation(g),
    }
    if operation not in run:
        raise ValueError(f"unknown operation {operation!r}")
    return _summary(run[operation]())


_RANKS = {"pagerank": centrality.pagerank, "betweenness_centrality": centrality.betweenness_centrality, "closeness_centrality": centrality.closeness_centrality, "eigenvector_centrality": centrality.eigenvector_centrality, "degree_centrality": centrality.degree_centrality}


@tool
def algorithm(spark: SparkSession, graph_json: str, name: str, source: str | None = None, target: str | None = None, weight: str | None = None, settings: Settings = DEFAULTS) -> dict[str, Any]:
    g = _graph(spark, graph_json, settings)
    if name in _RANKS:
        return {"ranking": [{"node": r["id"], "score": r["score"]} for r in centrality.ranked(_RANKS[name](g), TOP).collect()]}
    if name in ("louvain", "label_propagation"):
        found, column = (community.louvain_communities(g), "community") if name == "louvain" else (community.label_propagation(g), "label")
        groups: dict[int, list[str]] = {}
        for r in found.orderBy("ord").collect():
            groups.setdefault(r[column], []).append(r["id"])
        return {"communities": list(groups.values()), "count": len(groups)}
    if name == "scc":
        groups = {}
        for r in components.strongly_connected_components(g).orderBy("ord").collect():
            groups.setdefault(r["component"], []).append(r["id"])
        return {"components": list(groups.values()), "count": len(groups)}
    if name == "topological_sort":
        return {"order": _ids(dag.topological_sort(g))}
    if name == "longest_path":
        length, path = dag.longest_path(g)
        return {"length": length, "path": path}
    if source is None:
        raise ValueError(f"{name} needs a source")
    if name == "shortest_path":
        if target is None:
            raise ValueError("shortest_path needs a target")
        found = paths.astar_path(g, source, target, weight)
        return {"found": found is not None, "cost": found[0] if found else None, "path": found[1] if found else []}
    run = {"bfs": lambda: _ids(traversal.bfs(g, source)), "dfs": lambda: _ids(traversal.dfs(g, source).orderBy("seq")), "ancestors": lambda: sorted(_ids(traversal.ancestors(g, source))), "descendants": lambda: sorted(_ids(traversal.descendants(g, source)))}
    if name not in run:
        raise ValueError(f"unknown algorithm {name!r}")
    return {"nodes": run[name]()}


@tool
def critical_path(spark: SparkSession, graph_json: str, weight: str = "latency_ms", settings: Settings = DEFAULTS) -> dict[str, Any]:
    cost, path = dag.critical_path(_graph(spark, graph_json, settings), weight)
    return {"cost": cost, "path": path}


@tool
def find_patterns(spark: SparkSession, graph_json: str, node_filter: dict | None = None, edge_filter: dict | None = None, settings: Settings = DEFAULTS) -> dict[str, Any]:
    g = _graph(spark, graph_json, settings)
    out: dict[str, Any] = {}
    if node_filter:
        out["nodes"] = _ids(g.filter_nodes(**node_filter))
        out["node_count"] = len(out["nodes"])
    if edge_filter:
        out["edges"] = [[r["src"], r["dst"]] for r in g.filter_edges(**edge_filter).collect()]
        out["edge_count"] = len(out["edges"])
    return out


@tool
def validate_schema(spark: SparkSession, graph_json: str, schema_json: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    doc = json.loads(schema_json)
    node_types = tuple(schema.NodeType(t["name"], tuple(t.get("required_properties", ())), tuple(t.get("optional_properties", ()))) for t in doc.get("node_types", []))
    edge_types = tuple(schema.EdgeType(t["name"], t.get("source_type"), t.get("target_type"), tuple(t.get("required_properties", ()))) for t in doc.get("edge_types", []))
    found = schema.GraphSchema(node_types, edge_types).validate(_graph(spark, graph_json, settings)).collect()
    return {"valid": not found, "violations": [r.asDict() for r in found]}


@tool
def load_rdf_file(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    """Refused unless ``settings.allowed_root`` is set."""
    if settings.allowed_root is None:
        raise ValueError("reading files needs an allowed root")
    g, seen = rdf.load_rdf(spark, path, is_path=True, settings=settings)
    return {**_summary(g), "triples": seen.triples, "literals": seen.literals}


@tool
def load_rdf_string(spark: SparkSession, data: str, format: str = "turtle", settings: Settings = DEFAULTS) -> dict[str, Any]:
    g, seen = rdf.load_rdf(spark, data, format, settings=settings)
    return {**_summary(g), "triples": seen.triples, "literals": seen.literals}


@tool
def sparql(spark: SparkSession, graph_json: str, text: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    g = _graph(spark, graph_json, settings)
    if sparql_plan.Parser(text).query().ask:
        return {"ask": sparql_plan.ask(g, text, settings)}
    found = sparql_plan.query(g, text, settings)
    return {"variables": found.variables, "rows": found.rows, "truncated": found.truncated}


_EXPORTS = {"json": documents.to_json, "mermaid": documents.to_mermaid, "dot": documents.to_dot, "turtle": rdf.to_turtle, "ntriples": rdf.to_ntriples, "graphml": documents.to_graphml, "gexf": documents.to_gexf, "jsonld": rdf.to_jsonld, "adjacency": documents.to_adjacency_json}


@tool
def export(spark: SparkSession, graph_json: str, format: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    if format not in _EXPORTS:
        raise ValueError(f"unknown format {format!r}")
    return {"format": format, "text": _EXPORTS[format](_graph(spark, graph_json, settings))}


@tool
def visualize(spark: SparkSession, graph_json: str, max_nodes: int = 50, direction: str = "TB", settings: Settings = DEFAULTS) -> dict[str, Any]:
    return {"mermaid": documents.to_mermaid(_graph(spark, graph_json, settings), max_nodes=max_nodes, direction=direction)}


@tool
def load_adjacency(spark: SparkSession, data: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    return _summary(documents.from_adjacency_json(spark, data, settings))


@tool
def export_adjacency(spark: SparkSession, graph_json: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    return {"text": documents.to_adjacency_json(_graph(spark, graph_json, settings))}


@tool
def trace_to_graph(spark: SparkSession, trace_json: str, settings: Settings = DEFAULTS) -> dict[str, Any]:
    g = tables.trace_to_graph(spark, trace_json)
    return {**_summary(g), "latencies": {r["id"]: P.decode(r["props"]["latency_ms"]) for r in g.nodes.collect()}}
