"""Graph documents: JSON, adjacency JSON, GraphML, GEXF, DOT and Mermaid.

Readers take bounded text. Writers build every line as a column expression, so ``*_lines`` can be
written by the cluster; the string forms gather those lines in order. ``weft.sources.folders`` writes
and reads documents of any size by the same lines and ``parse_*``.
"""

from __future__ import annotations

import json
from contextlib import suppress
from itertools import chain
from typing import Any, NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import InvalidFormatError, LimitExceededError
from weft.functions import props as P
from weft.graph import PropertyGraph
from weft.settings import DEFAULTS, Settings


class Parsed(NamedTuple):
    """What a document says: nodes (id, properties), edges (source, target, properties) and flags."""

    nodes: list
    edges: list
    directed: bool
    multi: bool = False
    name: str | None = None


def _capped(data: str, limit: int, what: str) -> str:
    if len(data.encode()) > limit:
        raise LimitExceededError(f"the {what} text has more than {limit} bytes")
    return data


def _counted(nodes: list, edges: list, settings: Settings) -> None:
    if len(nodes) > settings.max_nodes or len(edges) > settings.max_edges:
        raise LimitExceededError(f"more than {settings.max_nodes} nodes or {settings.max_edges} edges")


def _object(data: str) -> dict:
    try:
        parsed = json.loads(data)
    except json.JSONDecodeError as e:
        raise InvalidFormatError(f"invalid JSON: {e}") from e
    if not isinstance(parsed, dict):
        raise InvalidFormatError("the top level must be a JSON object")
    return parsed


# -- graph JSON --------------------------------------------------------------------------------------


def _strict(what: str, value: Any, required: set[str], optional: set[str] = frozenset()) -> dict:
    if not isinstance(value, dict) or not required <= set(value) or not set(value) <= required | optional:
        raise InvalidFormatError(f"{what} must have the fields {sorted(required)} and no others but {sorted(optional)}")
    return value


def parse_json(data: str) -> Parsed:
    doc = _strict("the graph", _object(data), {"directed", "name", "nodes", "edges"}, {"multi"})
    nodes = [_strict("a node", n, {"id", "properties"}) for n in doc["nodes"]]
    edges = [_strict("an edge", e, {"source", "target", "properties"}) for e in doc["edges"]]
    return Parsed([(n["id"], n["properties"]) for n in nodes], [(e["source"], e["target"], e["properties"]) for e in edges], doc["directed"], doc.get("multi", False), doc["name"] or None)


def from_json(spark: SparkSession, data: str, settings: Settings = DEFAULTS) -> PropertyGraph:
    """Strict form: every field is required but ``multi``, and unknown ones are refused."""
    parsed = parse_json(_capped(data, settings.max_bytes, "JSON"))
    _counted(parsed.nodes, parsed.edges, settings)
    return PropertyGraph.of(spark, *parsed)


def from_inline_json(spark: SparkSession, data: str, settings: Settings = DEFAULTS) -> PropertyGraph:
    """Relaxed form: every key besides the ids is a property."""
    doc = _object(_capped(data, settings.max_bytes, "JSON"))
    nodes = [(n["id"], {k: v for k, v in n.items() if k != "id"}) for n in doc.get("nodes", [])]
    edges = [(e["source"], e["target"], {k: v for k, v in e.items() if k not in ("source", "target")}) for e in doc.get("edges", [])]
    _counted(nodes, edges, settings)
    return PropertyGraph.of(spark, nodes, edges, doc.get("directed", True), doc.get("multi", False), doc.get("name") or None)


def props_json(props: Column) -> Column:
    """A property map as a JSON object with sorted keys."""
    fields = F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(P.quote(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def json_lines(g: PropertyGraph) -> tuple[str, DataFrame, str, DataFrame, str]:
    """Head, nodes (``k, value``), what stands between, edges and tail; commas are the writer's."""
    nodes = g.nodes.select(F.col("ord").alias("k"), F.concat(F.lit('{"id":'), P.quote(F.col("id")), F.lit(',"properties":'), props_json(F.col("props")), F.lit("}")).alias("value"))
    edges = g.edges.select(F.col("eord").alias("k"), F.concat(F.lit('{"source":'), P.quote(F.col("src")), F.lit(',"target":'), P.quote(F.col("dst")), F.lit(',"properties":'), props_json(F.col("props")), F.lit("}")).alias("value"))
    head = f'{{"directed":{json.dumps(g.directed)},"multi":{json.dumps(g.multi)},"name":{json.dumps(g.name or "")},"nodes":['
    return head, nodes, '],"edges":[', edges, "]}"


def to_json(g: PropertyGraph) -> str:
    head, nodes, middle, edges, tail = json_lines(g)
    return head + _gather(nodes, ",") + middle + _gather(edges, ",") + tail


# -- adjacency JSON ----------------------------------------------------------------------------------


def link(entry: Any) -> tuple[Any, dict] | None:
    """Target and properties of one entry of a source's list; None for what names no target."""
    match entry:
        case str():
            return entry, {}
        case [target, dict() as props, *_]:
            return target, props
        case [target, *_]:
            return target, {}
    return None


def parse_adjacency(data: str) -> Parsed:
    doc = _object(data)
    parts = doc.get("nodes", {}), doc.get("edges", {})
    if not all(isinstance(part, dict) for part in parts):
        raise InvalidFormatError("'nodes' and 'edges' must be JSON objects")
    declared, lists = parts
    links = {source: list(filter(None, map(link, entries))) if isinstance(entries, list) else [] for source, entries in lists.items()}
    named = chain.from_iterable((source, *(target for target, _ in own)) for source, own in links.items())
    nodes = [(n, p if isinstance(p, dict) else {}) for n, p in declared.items()] + [(n, {}) for n in dict.fromkeys(named) if n not in declared]
    edges = [(source, target, props) for source, own in links.items() for target, props in own]
    return Parsed(nodes, edges, doc.get("directed", True))


def from_adjacency_json(spark: SparkSession, data: str, settings: Settings = DEFAULTS) -> PropertyGraph:
    """Endpoints need no entry of their own; entries that are neither a list nor a string are skipped."""
    parsed = parse_adjacency(_capped(data, settings.max_bytes, "adjacency"))
    _counted(parsed.nodes, parsed.edges, settings)
    return PropertyGraph.of(spark, *parsed)


def adjacency_pair() -> Column:
    """An edge's entry in the list of its source."""
    return F.concat(F.lit("["), P.quote(F.col("dst")), F.lit(","), props_json(F.col("props")), F.lit("]"))


def adjacency_nodes(g: PropertyGraph) -> DataFrame:
    """``k, value``: each node with its properties as JSON."""
    return g.nodes.select(F.col("ord").alias("k"), F.concat(P.quote(F.col("id")), F.lit(":"), props_json(F.col("props"))).alias("value"))


def adjacency_rows(g: PropertyGraph) -> DataFrame:
    """``src, value``: each source with its targets as JSON."""
    rows = g.edges.select("src", "eord", adjacency_pair().alias("pair")).groupBy("src").agg(F.min("eord").alias("eord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("eord", "pair"))), lambda x: x["pair"]), ",").alias("pairs"))
    return rows.select("src", "eord", F.concat(P.quote(F.col("src")), F.lit(":["), "pairs", F.lit("]")).alias("value"))


def to_adjacency_json(g: PropertyGraph) -> str:
    body = f'{{"directed":{json.dumps(g.directed)},"nodes":{{' + _gather(adjacency_nodes(g), ",") + '},"edges":{' + _gather(adjacency_rows(g).withColumnRenamed("eord", "k"), ",") + "}}"
    return json.dumps(json.loads(body), indent=2)


# -- GraphML and GEXF ----------------------------------------------------------------------------------


def _xml(data: str) -> tuple[ElementTree.Element, str]:
    if "<!DOCTYPE" in data or "<!ENTITY" in data:
        raise InvalidFormatError("document types and entities are refused")
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise InvalidFormatError(f"invalid XML: {e}") from e
    return root, root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""


def _nested(text: str) -> Any:
    """Lists and objects are written as JSON in string attributes; other strings are kept as they are."""
    with suppress(ValueError):
        value = json.loads(text) if text.startswith(("{", "[")) else text
        return value
    return text


#: The names of GraphML's and GEXF's attribute types, each with its reader.
READERS = {
    "boolean": lambda text: text.lower() in {"true", "1"},
    **dict.fromkeys(("int", "integer", "long"), int),
    **dict.fromkeys(("float", "double"), float),
    "string": _nested,
}


def _value(text: str, kind: str) -> Any:
    return READERS.get(kind, str)(text)


def _graph_element(root: ElementTree.Element, ns: str) -> ElementTree.Element:
    found = root.find(f"{ns}graph")
    if found is None:
        raise InvalidFormatError("no graph element")
    return found


def _attribute(el: ElementTree.Element, name: str) -> str:
    value = el.get(name)
    if value is None:
        raise InvalidFormatError(f"an element has no {name!r}")
    return value


def parse_graphml(data: str) -> Parsed:
    root, ns = _xml(data)
    keys = {k.get("id", ""): (k.get("attr.name", k.get("id", "")), k.get("attr.type", "string")) for k in root.iter(f"{ns}key")}
    graph = _graph_element(root, ns)

    def props(el) -> dict[str, Any]:
        out = {}
        for d in el.findall(f"{ns}data"):
            name, kind = keys.get(d.get("key", ""), (d.get("key", ""), "text"))
            out[name] = _value(d.text or "", kind)
        return out

    nodes = [(_attribute(n, "id"), props(n)) for n in graph.iter(f"{ns}node")]
    edges = [(_attribute(e, "source"), _attribute(e, "target"), props(e)) for e in graph.iter(f"{ns}edge")]
    return Parsed(nodes, edges, graph.get("edgedefault", "directed") == "directed", name=graph.get("id") or None)


def from_graphml(spark: SparkSession, data: str, settings: Settings = DEFAULTS) -> PropertyGraph:
    return PropertyGraph.of(spark, *parse_graphml(_capped(data, settings.max_xml_bytes, "XML")))


def parse_gexf(data: str) -> Parsed:
    root, ns = _xml(data)
    graph = _graph_element(root, ns)
    known = {(group.get("class", ""), a.get("id", "")): (a.get("title", a.get("id", "")), a.get("type", "string")) for group in graph.findall(f"{ns}attributes") for a in group.findall(f"{ns}attribute")}

    def props(el, kind: str) -> dict[str, Any]:
        out = {"label": el.get("label")} if kind == "node" and el.get("label") is not None else {}
        for v in el.findall(f"{ns}attvalues/{ns}attvalue"):
            name, type_ = known.get((kind, v.get("for", "")), (v.get("for", ""), "text"))
            out[name] = _value(v.get("value", ""), type_)
        return out

    nodes = [(_attribute(n, "id"), props(n, "node")) for n in graph.findall(f"{ns}nodes/{ns}node")]
    edges = [(_attribute(e, "source"), _attribute(e, "target"), props(e, "edge")) for e in graph.findall(f"{ns}edges/{ns}edge")]
    return Parsed(nodes, edges, graph.get("defaultedgetype", "directed") == "directed")


def from_gexf(spark: SparkSession, data: str, settings: Settings = DEFAULTS) -> PropertyGraph:
    return PropertyGraph.of(spark, *parse_gexf(_capped(data, settings.max_xml_bytes, "XML")))


def key_types(rows: DataFrame) -> dict[str, str]:
    """The type of each property key of ``rows(props)``: string where values are mixed or nested.

    One row a key reaches the driver.
    """
    v = F.col("value")
    kind = F.when(v.isin("true", "false"), "boolean").when(v.rlike(r"^-?[0-9]+$"), "long").when(P.is_number(v), "double").otherwise("string")
    found = rows.select(F.explode("props").alias("key", "value")).groupBy("key").agg(F.collect_set(kind).alias("kinds"))
    return {r["key"]: r["kinds"][0] if len(r["kinds"]) == 1 else "string" for r in found.collect()}


def _plain(text: Column) -> Column:
    """JSON text as XML shows it: strings without quotes, everything else as it is."""
    return F.coalesce(P.string(text), text)


def _xml_text(c: Column) -> Column:
    """Line ends become references: readers keep them as they are, and raw ones are layout alone."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def _xml_attr(c: Column) -> Column:
    out = F.replace(F.replace(_xml_text(c), F.lit('"'), F.lit("&quot;")), F.lit("\t"), F.lit("&#09;"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _entries(each) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries("props")), each), "")


def graphml_lines(g: PropertyGraph) -> tuple[str, DataFrame, DataFrame, str]:
    """Head, node lines, edge lines (``k, value`` each) and tail."""
    types = [("node", "n_", key_types(g.nodes)), ("edge", "e_", key_types(g.edges))]
    head = ["<?xml version='1.0' encoding='utf-8'?>", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">']
    head += [f'  <key id={quoteattr(mark + k)} for="{what}" attr.name={quoteattr(k)} attr.type="{t}" />' for what, mark, keys in types for k, t in sorted(keys.items())]
    head.append(f'  <graph id={quoteattr(g.name or "G")} edgedefault="{"directed" if g.directed else "undirected"}">')
    data = lambda mark: _entries(lambda e: F.concat(F.lit("\n      <data key="), _xml_attr(F.concat(F.lit(mark), e["key"])), F.lit(">"), _xml_text(_plain(e["value"])), F.lit("</data>")))
    body = lambda tag, attrs, mark: F.concat(F.lit(f"    <{tag} "), attrs, F.when(F.size("props") > 0, F.concat(F.lit(">"), data(mark), F.lit(f"\n    </{tag}>"))).otherwise(" />"))
    nodes = g.nodes.select(F.col("ord").alias("k"), body("node", F.concat(F.lit("id="), _xml_attr(F.col("id"))), "n_").alias("value"))
    ends = F.concat(F.lit('id="e'), F.col("eord").cast("string"), F.lit('" source='), _xml_attr(F.col("src")), F.lit(" target="), _xml_attr(F.col("dst")))
    edges = g.edges.select(F.col("eord").alias("k"), body("edge", ends, "e_").alias("value"))
    return "\n".join(head) + "\n", nodes, edges, "  </graph>\n</graphml>\n"


def gexf_lines(g: PropertyGraph) -> tuple[str, DataFrame, DataFrame, str, str]:
    """Head, node lines, edge lines, what stands between them, and tail."""
    node_keys, edge_keys = sorted(key_types(g.nodes).items()), sorted(key_types(g.edges).items())
    head = ["<?xml version='1.0' encoding='utf-8'?>", '<gexf xmlns="http://gexf.net/1.3" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://gexf.net/1.3 http://gexf.net/1.3/gexf.xsd" version="1.3">', f'  <graph defaultedgetype="{"directed" if g.directed else "undirected"}">']
    for what, mark, keys in (("node", "", node_keys), ("edge", "e", edge_keys)):
        if keys:
            head.append(f'    <attributes class="{what}">')
            head += [f'      <attribute id="{mark}{k}" title={quoteattr(name)} type="{kind}" />' for k, (name, kind) in enumerate(keys)]
            head.append("    </attributes>")
    head.append("    <nodes>")

    def values(keys, mark):
        place = F.create_map(*[F.lit(x) for k, (name, _) in enumerate(keys) for x in (name, f"{mark}{k}")]) if keys else None
        if place is None:
            return F.lit("")
        return F.concat(F.lit("\n        <attvalues>"), _entries(lambda e: F.concat(F.lit('\n          <attvalue for="'), F.element_at(place, e["key"]), F.lit('" value='), _xml_attr(_plain(e["value"])), F.lit(" />"))), F.lit("\n        </attvalues>"))

    body = lambda tag, attrs, inner: F.concat(F.lit(f"      <{tag} "), attrs, F.when(F.size("props") > 0, F.concat(F.lit(">"), inner, F.lit(f"\n      </{tag}>"))).otherwise(" />"))
    label = F.coalesce(_plain(F.col("props")["label"]), F.col("id"))
    nodes = g.nodes.select(F.col("ord").alias("k"), body("node", F.concat(F.lit("id="), _xml_attr(F.col("id")), F.lit(" label="), _xml_attr(label)), values(node_keys, "")).alias("value"))
    ends = F.concat(F.lit('id="'), F.col("eord").cast("string"), F.lit('" source='), _xml_attr(F.col("src")), F.lit(" target="), _xml_attr(F.col("dst")))
    edges = g.edges.select(F.col("eord").alias("k"), body("edge", ends, values(edge_keys, "e")).alias("value"))
    return "\n".join(head) + "\n", nodes, edges, "    </nodes>\n    <edges>\n", "    </edges>\n  </graph>\n</gexf>\n"


def _gather(rows: DataFrame, between: str = "") -> str:
    lines = (r["value"] for r in rows.orderBy("k").toLocalIterator())
    return between.join(lines) if between else "".join(line + "\n" for line in lines)


def to_graphml(g: PropertyGraph) -> str:
    head, nodes, edges, tail = graphml_lines(g)
    return head + _gather(nodes) + _gather(edges) + tail


def to_gexf(g: PropertyGraph) -> str:
    head, nodes, edges, middle, tail = gexf_lines(g)
    return head + _gather(nodes) + middle + _gather(edges) + tail


# -- DOT and Mermaid -----------------------------------------------------------------------------------


def _dot(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(g: PropertyGraph, node_label: Column | None = None, edge_label: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge lines ``k, value``; labels are columns over ``id, props`` or ``src, dst, props``."""
    label = F.col("id") if node_label is None else node_label
    nodes = g.nodes.select(F.col("ord").alias("k"), F.concat(F.lit("    "), _dot(F.col("id")), F.lit(" [label="), _dot(label), F.lit("];")).alias("value"))
    op = " -> " if g.directed else " -- "
    mark = F.lit("") if edge_label is None else F.when(F.coalesce(edge_label, F.lit("")) != "", F.concat(F.lit(" [label="), _dot(edge_label), F.lit("]"))).otherwise("")
    edges = g.edges.select(F.col("eord").alias("k"), F.concat(F.lit("    "), _dot(F.col("src")), F.lit(op), _dot(F.col("dst")), mark, F.lit(";")).alias("value"))
    return nodes, edges


def to_dot(g: PropertyGraph, node_label: Column | None = None, edge_label: Column | None = None, graph_name: str = "G") -> str:
    nodes, edges = dot_lines(g, node_label, edge_label)
    name = graph_name.replace("\\", "\\\\").replace('"', '\\"')
    return f'{"digraph" if g.directed else "graph"} "{name}" {{\n' + _gather(nodes) + _gather(edges) + "}\n"


def _mermaid_id(c: Column) -> Column:
    safe = F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")
    return F.when(safe == "", "n_empty").when(safe.rlike("^[0-9]"), F.concat(F.lit("n_"), safe)).otherwise(safe)


def _mermaid_label(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit("#quot;")), F.lit('"'))


def to_mermaid(g: PropertyGraph, node_label: Column | None = None, edge_label: Column | None = None, max_nodes: int = 50, direction: str = "TB") -> str:
    """A flowchart of the first ``max_nodes`` nodes and the edges between them."""
    shown = g.nodes.orderBy("ord").limit(max_nodes)
    label = F.col("id") if node_label is None else node_label
    nodes = shown.select(F.col("ord").alias("k"), F.concat(F.lit("    "), _mermaid_id(F.col("id")), F.lit("["), _mermaid_label(label), F.lit("]")).alias("value"))
    ids = shown.select("id")
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    arrow = F.lit(" --> ") if edge_label is None else F.when(F.coalesce(edge_label, F.lit("")) != "", F.concat(F.lit(" -->|"), _mermaid_label(edge_label), F.lit("| "))).otherwise(" --> ")
    edges = edges.select(F.col("eord").alias("k"), F.concat(F.lit("    "), _mermaid_id(F.col("src")), arrow, _mermaid_id(F.col("dst"))).alias("value"))
    out = f"flowchart {direction}\n" + _gather(nodes) + _gather(edges)
    more = g.n_nodes() - max_nodes
    if more > 0:
        out += f'    truncated_note["... {more} more nodes omitted"]\n    style truncated_note fill:#fff3cd,stroke:#ffc107\n'
    return out


