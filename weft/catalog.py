"""Registered graph queries over the star-schema tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import props as P
from weft.graph import PropertyGraph
from weft.operators import centrality, community, components, dag, mutate, paths, schema, structure, transform, traversal
from weft.plans import sparql
from weft.runtime import scratch_path
from weft.sources import documents, folders, rdf, star, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_N = {
    "r": "SELECT 'r:' || r_regionkey AS id, CAST(r_regionkey AS BIGINT) AS ord, 'region' AS type, r_name AS name, NULL::VARCHAR AS segment, NULL::DOUBLE AS balance FROM region",
    "n": "SELECT 'n:' || n_nationkey, CAST(n_nationkey AS BIGINT) + 1000, 'nation', n_name, NULL, NULL FROM nation",
    "s": "SELECT 's:' || s_suppkey, s_suppkey + 1000000000, 'supplier', s_name, NULL, s_acctbal FROM supplier",
    "c": "SELECT 'c:' || c_custkey, c_custkey + 100000000000, 'customer', c_name, c_mktsegment, c_acctbal FROM customer",
    "o": "SELECT 'o:' || o_orderkey, o_orderkey + 10000000000000, 'order', NULL, NULL, NULL FROM orders",
}
_E = {
    "n": "SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'hasNation' AS type FROM nation",
    "s": "SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'hasSupplier' FROM supplier",
    "c": "SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'hasCustomer' FROM customer",
    "o": "SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'placed' FROM orders",
}


def _with(kinds: str, *more: str) -> str:
    nodes = "nodes AS (" + " UNION ALL ".join(_N[k] for k in kinds) + ")"
    edges = "edges AS (" + " UNION ALL ".join(_E[k] for k in kinds if k in _E) + ")"
    return "WITH RECURSIVE " + ",\n".join([nodes, edges, *more]) + "\n"


GEO, HIER = _with("rnsc"), _with("rnsco")
_REACH = "reach(a, b, d) AS (SELECT src, dst, 1 FROM edges UNION ALL SELECT r.a, e.dst, r.d + 1 FROM reach r JOIN edges e ON r.b = e.src)"
GEO_REACH, HIER_REACH = _with("rnsc", _REACH), _with("rnsco", _REACH)
_SUPPLY = """WITH RECURSIVE nodes AS (SELECT 's:' || s_suppkey AS id, s_suppkey + 1000000000 AS ord FROM supplier UNION ALL SELECT 'c:' || c_custkey, c_custkey + 100000000000 FROM customer),
edges AS (SELECT DISTINCT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
_TRADE = """WITH RECURSIVE nodes AS (SELECT 'n:' || n_nationkey AS id, CAST(n_nationkey AS BIGINT) + 1000 AS ord FROM nation),
edges AS (SELECT 'n:' || s_nationkey AS src, 'n:' || c_nationkey AS dst, CAST(count(*) AS DOUBLE) AS weight, CAST(greatest(1000 - count(*), 1) AS DOUBLE) AS cost
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def geo(spark, sf):
    return star.hierarchy(spark, sf)


def hier(spark, sf):
    return star.hierarchy(spark, sf, orders=True)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def _scores(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select("id", F.round("score", digits).alias("score"))


def _edges(g: PropertyGraph) -> DataFrame:
    return g.edges.select("src", "dst")


# -- numbers and look-ups ------------------------------------------------------------------------------


@query(HIER + "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0)), 12) AS density")
def graph_counts(spark, sf):
    g = hier(spark, sf)
    return _one(spark, n_nodes=g.n_nodes(), n_edges=g.n_edges(), density=round(structure.density(g), 12))


_DEG = "deg AS (SELECT id, ord, (SELECT 0) + coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM nodes LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY 1) ON id = dst LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY 1) ON id = src)"


@query(_with("rnsco", _DEG) + "SELECT id, i AS in_degree, o AS out_degree, i + o AS degree FROM deg")
def degrees(spark, sf):
    return hier(spark, sf).degrees().select("id", "in_degree", "out_degree", "degree")


@query(_SUPPLY + ", " + _DEG + " SELECT id, round((i + o) / ((SELECT count(*) FROM nodes) - 1.0), 9) AS score FROM deg")
def degree_centrality(spark, sf):
    return _scores(centrality.degree_centrality(star.supply(spark, sf)))


@query(_SUPPLY + ", " + _DEG + " SELECT id, round(i / ((SELECT count(*) FROM nodes) - 1.0), 9) AS score FROM deg")
def in_degree_centrality(spark, sf):
    return _scores(centrality.in_degree_centrality(star.supply(spark, sf)))


@query(_SUPPLY + ", " + _DEG + " SELECT id, round(o / ((SELECT count(*) FROM nodes) - 1.0), 9) AS score FROM deg")
def out_degree_centrality(spark, sf):
    return _scores(centrality.out_degree_centrality(star.supply(spark, sf)))


@query(_SUPPLY + ", " + _DEG + " SELECT id, round(i / ((SELECT count(*) FROM nodes) - 1.0), 9) AS score FROM deg ORDER BY i DESC, ord LIMIT 20")
def top_ranked(spark, sf):
    return _scores(centrality.ranked(centrality.in_degree_centrality(star.supply(spark, sf)), 20))


@query(_with("rnsco", _DEG) + "SELECT i + o AS degree, count(*) AS n FROM deg GROUP BY 1")
def degree_distribution(spark, sf):
    return structure.degree_distribution(hier(spark, sf))


@query(_SUPPLY + " SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)")
def orphan_nodes(spark, sf):
    return structure.find_orphan_nodes(star.supply(spark, sf)).select("id")


@query(_with("rnsco", _DEG) + "SELECT id, i + o AS degree FROM deg WHERE i + o > 12")
def hub_nodes(spark, sf):
    return structure.find_hub_nodes(hier(spark, sf), 12).select("id", "degree")


@query(GEO + "SELECT id FROM nodes WHERE type = 'customer' AND segment = 'BUILDING'")
def filter_nodes(spark, sf):
    return geo(spark, sf).filter_nodes(type="customer", segment="BUILDING").select("id")


@query(_TRADE + " SELECT src, dst FROM edges WHERE weight = 100")
def filter_edges(spark, sf):
    return star.trade(spark, sf).filter_edges(weight=100.0).select("src", "dst")


@query(GEO + "SELECT src, dst FROM edges WHERE type = 'hasSupplier'")
def edges_filtered(spark, sf):
    return geo(spark, sf).edges_filtered("type", "hasSupplier").select("src", "dst")


@query(GEO + "SELECT dst AS id FROM edges WHERE src = 'n:3'")
def successors(spark, sf):
    return geo(spark, sf).successors("n:3")


@query(GEO + "SELECT src AS id FROM edges WHERE dst = 'n:3'")
def predecessors(spark, sf):
    return geo(spark, sf).predecessors("n:3")


@query(_TRADE + " SELECT dst AS id FROM edges WHERE src = 'n:3' UNION SELECT src FROM edges WHERE dst = 'n:3'")
def neighbors(spark, sf):
    return star.trade(spark, sf).neighbors("n:3")


@query(GEO + "SELECT EXISTS (SELECT 1 FROM nodes WHERE id = 'n:3') AS has_node, EXISTS (SELECT 1 FROM nodes WHERE id = 'x') AS no_node, EXISTS (SELECT 1 FROM edges WHERE src = 'n:3') AS has_edge, EXISTS (SELECT 1 FROM edges WHERE dst = 'n:3' AND src NOT LIKE 'r:%') AS no_edge, (SELECT count(*) FROM edges WHERE src = 'n:3' OR dst = 'n:3') AS degree")
def lookups(spark, sf):
    g = geo(spark, sf)
    some = g.edges.filter("src = 'n:3'").first()["dst"]
    return _one(spark, has_node=g.has_node("n:3"), no_node=g.has_node("x"), has_edge=g.has_edge("n:3", some), no_edge=g.has_edge(some, "n:3"), degree=g.degree("n:3"))


@query(GEO + "SELECT id, type, name FROM nodes WHERE id = 'n:3'")
def node(spark, sf):
    found = geo(spark, sf).node("n:3")
    return _one(spark, id=found["id"], type=found["properties"]["type"], name=found["properties"]["name"])


@query(HIER + "SELECT id FROM nodes")
def node_ids(spark, sf):
    return hier(spark, sf).node_ids()


# -- changes -------------------------------------------------------------------------------------------


@query(GEO + "SELECT src, dst FROM edges WHERE src <> 'n:3' AND dst <> 'n:3'")
def remove_node(spark, sf):
    return _edges(mutate.remove_node(geo(spark, sf), "n:3"))


@query(GEO + "SELECT src, dst FROM edges WHERE NOT (src = 'r:' || (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) AND dst = 'n:3')")
def remove_edge(spark, sf):
    g = geo(spark, sf)
    return _edges(mutate.remove_edge(g, g.edges.filter("dst = 'n:3'").first()["src"], "n:3"))


@query(GEO + "SELECT src, dst FROM edges UNION ALL SELECT 'x', 'r:0'")
def add_node_and_edge(spark, sf):
    return _edges(mutate.add_edge(mutate.add_node(geo(spark, sf), "x", type="new"), "x", "r:0"))


@query(GEO + "SELECT id, CASE WHEN type = 'nation' THEN 'state' ELSE type END AS type, name FROM nodes")
def update_nodes(spark, sf):
    g = geo(spark, sf)
    new = g.nodes.filter("id LIKE 'n:%'").select("id", P.literal_map({"type": "state"}).alias("props"))
    rows = mutate.update_nodes(g, new).nodes
    return rows.select("id", P.string(F.col("props")["type"]).alias("type"), P.string(F.col("props")["name"]).alias("name"))


# -- transforms ----------------------------------------------------------------------------------------


@query(GEO + "SELECT src, dst FROM edges WHERE src IN ('r:0', 'r:1', 'n:3', 'n:5') AND dst IN ('r:0', 'r:1', 'n:3', 'n:5')")
def subgraph(spark, sf):
    return _edges(transform.subgraph(geo(spark, sf), ["n:5", "r:0", "r:1", "n:3"]))


@query(GEO + "SELECT dst AS id FROM edges WHERE src = 'n:3' UNION SELECT src FROM edges WHERE dst = 'n:3' UNION SELECT 'n:3'")
def ego_graph(spark, sf):
    return transform.ego_graph(geo(spark, sf), "n:3", 1).nodes.select("id")


@query(GEO + "SELECT dst AS src, src AS dst FROM edges")
def reverse(spark, sf):
    return _edges(transform.reverse(geo(spark, sf)))


@query(_TRADE + " SELECT count(*) AS n FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM edges)")
def to_undirected(spark, sf):
    return transform.to_undirected(star.trade(spark, sf)).edges.agg(F.count(F.lit(1)).alias("n"))


@query(GEO + "SELECT src, dst FROM edges WHERE split_part(src, ':', 1) IN ('r', 'n') AND split_part(dst, ':', 1) IN ('r', 'n')")
def subgraph_by_types(spark, sf):
    return _edges(transform.by_types(geo(spark, sf), ["region", "nation"]))


@query(GEO + "SELECT id FROM nodes WHERE segment = 'MACHINERY'")
def subgraph_by_property(spark, sf):
    return transform.by_property(geo(spark, sf), "segment", "MACHINERY").nodes.select("id")


@query(GEO + "SELECT src, dst FROM edges WHERE type = 'hasSupplier'")
def extract_subgraph(spark, sf):
    return _edges(transform.extract_subgraph(geo(spark, sf), node_types=["nation", "supplier", "customer"], edge_types=["urn:star:hasSupplier"]))


def _halves(spark, sf):
    g = geo(spark, sf)
    first = transform.by_types(g, ["region", "nation", "customer"])
    second = transform.by_types(g, ["nation", "supplier"])
    return first, mutate.update_nodes(second, second.nodes.filter("id LIKE 'n:%'").select("id", P.literal_map({"type": "state", "new": 1}).alias("props")))


@query(GEO + "SELECT id, CASE WHEN type = 'nation' THEN 'state' ELSE type END AS type, name FROM nodes")
def merge_graphs(spark, sf):
    rows = transform.merge_graphs(*_halves(spark, sf), "merge").nodes
    return rows.select("id", P.string(F.col("props")["type"]).alias("type"), P.string(F.col("props")["name"]).alias("name"))


@query(GEO + "SELECT src, dst FROM edges")
def merge_edges(spark, sf):
    return _edges(transform.merge_graphs(*_halves(spark, sf), "keep_first"))


@query(GEO + """SELECT 'added_node' AS kind, count(*) AS n FROM nodes WHERE type = 'supplier' UNION ALL SELECT 'removed_node', count(*) FROM nodes WHERE type IN ('region', 'customer')
UNION ALL SELECT 'changed_node', count(*) FROM nodes WHERE type = 'nation' UNION ALL SELECT 'added_edge', count(*) FROM edges WHERE type = 'hasSupplier' UNION ALL SELECT 'removed_edge', count(*) FROM edges WHERE type <> 'hasSupplier'""")
def diff_graphs(spark, sf):
    return transform.diff_graphs(*_halves(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_SCC = _TRADE + """, walk(a, b) AS (SELECT src, dst FROM edges UNION SELECT w.a, e.dst FROM walk w JOIN edges e ON w.b = e.src),
part AS (SELECT n.id, least(n.ord, min(m.ord)) AS component FROM nodes n LEFT JOIN walk x ON x.a = n.id LEFT JOIN walk y ON y.a = x.b AND y.b = n.id LEFT JOIN nodes m ON m.id = y.a GROUP BY n.id, n.ord)"""


@query(_SCC + " SELECT count(*) AS nodes, string_agg(id, ',' ORDER BY id) AS id FROM part GROUP BY component")
def condensation(spark, sf):
    g = transform.condensation(star.trade(spark, sf))
    return g.nodes.select(F.size(F.split("id", ",")).cast("long").alias("nodes"), "id")


@query(GEO_REACH + "SELECT DISTINCT a AS src, b AS dst FROM reach")
def transitive_closure(spark, sf):
    return _edges(transform.transitive_closure(geo(spark, sf)))


@query(GEO + "SELECT src, dst FROM edges")
def transitive_reduction(spark, sf):
    """The closure holds an edge for every longer path; the reduction must drop all of these."""
    return _edges(transform.transitive_reduction(transform.transitive_closure(geo(spark, sf))))


@query(GEO + "SELECT e.src, f.dst FROM edges e JOIN edges f ON e.dst = f.src UNION ALL SELECT src, dst FROM edges")
def infer_types(spark, sf):
    g = geo(spark, sf)
    part = g.with_(edges=g.edges.withColumn("props", P.literal_map({"predicate": "part"})))
    return _edges(transform.infer_types(part, "part"))


@query(GEO + "SELECT src AS s, 'urn:star:' || type AS p, dst AS o FROM edges")
def project_triples(spark, sf):
    return transform.project_triples(geo(spark, sf))


@query("SELECT DISTINCT user_id || '' AS src, event_type AS dst FROM events")
def from_triples(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("s"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("p"), F.col("event_type").alias("o"), F.col("event_id").cast("long").alias("eord"))
    return _edges(transform.from_triples(rows))


# -- walks and paths -----------------------------------------------------------------------------------


@query(HIER_REACH + "SELECT b AS id, CAST(d AS BIGINT) AS depth FROM reach WHERE a = 'r:0' UNION ALL SELECT 'r:0', 0")
def bfs_with_depth(spark, sf):
    return traversal.bfs_with_depth(hier(spark, sf), "r:0").select("id", "depth")


@query(HIER_REACH + "SELECT b AS id FROM reach WHERE a = 'r:0' AND d = 2")
def bfs_at_depth(spark, sf):
    return traversal.bfs_at_depth(hier(spark, sf), "r:0", 2)


@query(GEO_REACH + "SELECT a AS id FROM reach WHERE b = 'c:5'")
def ancestors(spark, sf):
    return traversal.ancestors(geo(spark, sf), "c:5")


@query(HIER_REACH + "SELECT b AS id FROM reach WHERE a = 'n:3'")
def descendants(spark, sf):
    return traversal.descendants(hier(spark, sf), "n:3")


@query(GEO_REACH + "SELECT EXISTS (SELECT 1 FROM reach WHERE a = 'r:0' AND b = 'c:5') AS down, false AS up, true AS self")
def has_path(spark, sf):
    g = geo(spark, sf)
    return _one(spark, down=traversal.has_path(g, "r:0", "c:5"), up=traversal.has_path(g, "c:5", "r:0"), self=traversal.has_path(g, "c:5", "c:5"))


@query(GEO_REACH + "SELECT 1 + count(*) AS entered, 1 + count(*) AS left_, true AS nested FROM reach WHERE a = 'r:0'")
def dfs_events(spark, sf):
    found = traversal.dfs_events(geo(spark, sf), "r:0")
    spans = found.groupBy("id").agg(F.min(F.when(F.col("event") == "enter", F.col("seq"))).alias("a"), F.max(F.when(F.col("event") == "exit", F.col("seq"))).alias("b"))
    return found.agg(F.sum((F.col("event") == "enter").cast("long")).alias("entered"), F.sum((F.col("event") == "exit").cast("long")).alias("left_")).crossJoin(spans.agg(F.min((F.col("a") < F.col("b")) & ((F.col("b") - F.col("a")) % 2 == 1)).alias("nested")))


_RELAX = _TRADE + ", d0 AS (SELECT 'n:0' AS id, 0.0::DOUBLE AS cost), " + ", ".join(f"d{k + 1} AS (SELECT id, min(cost) AS cost FROM (SELECT id, cost FROM d{k} UNION ALL SELECT e.dst, d.cost + e.cost FROM d{k} d JOIN edges e ON d.id = e.src) GROUP BY 1)" for k in range(8))


@query(_RELAX + " SELECT id, cost FROM d8")
def shortest_paths(spark, sf):
    return paths.shortest_paths(star.trade(spark, sf), "n:0", weight="cost").select("id", "cost")


@query(_RELAX + " SELECT id, cost FROM d8")
def bellman_ford_paths(spark, sf):
    return paths.bellman_ford_paths(star.trade(spark, sf), "n:0", weight="cost").select("id", "cost")


@query(_RELAX + " SELECT cost, cost AS path_cost FROM d8 WHERE id = 'n:7'")
def astar_path(spark, sf):
    g = star.trade(spark, sf)
    found = paths.astar_path(g, "n:0", "n:7", "cost")
    if found is None:
        return spark.createDataFrame([], "cost double, path_cost double")
    cost, path = found
    w = {(r["src"], r["dst"]): float(r["w"]) for r in g.edges.filter(F.col("src").isin(path)).select("src", "dst", P.edge_weight(F.col("props"), "cost").alias("w")).collect()}
    return _one(spark, cost=cost, path_cost=sum(w[a, b] for a, b in zip(path, path[1:])))


_TRANSIT = "WITH RECURSIVE edges AS (SELECT DISTINCT event_type AS src, nxt AS dst FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"


def transit(spark, sf) -> PropertyGraph:
    """event type -> the type of the user's next event; five nodes."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).filter("dst IS NOT NULL").distinct()
    names = {r[0]: k for k, r in enumerate(spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct().orderBy("event_type").collect())}
    place = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    nodes = spark.createDataFrame([(n, k, {}) for n, k in names.items()], "id string, ord long, props map<string,string>")
    return PropertyGraph(nodes, pairs.select("src", "dst", (F.element_at(place, F.col("src")) * 100 + F.element_at(place, F.col("dst"))).cast("long").alias("eord"), P.no_props().alias("props")))


@query(_TRANSIT + """, walk(node, path, n) AS (SELECT dst, ['click', dst], 2 FROM edges WHERE src = 'click' AND dst <> 'click'
UNION ALL SELECT e.dst, list_append(path, e.dst), n + 1 FROM walk w JOIN edges e ON w.node = e.src WHERE NOT list_contains(path, e.dst) AND node <> 'view' AND n < 4)
SELECT array_to_string(path, '>') AS path FROM walk WHERE node = 'view'""")
def all_simple_paths(spark, sf):
    return paths.all_simple_paths(transit(spark, sf), "click", "view", max_depth=4).select(F.array_join("path", ">").alias("path"))


@query(_TRANSIT + " SELECT string_agg(DISTINCT src, ',' ORDER BY src) AS ids FROM edges")
def find_cycles(spark, sf):
    return paths.find_cycles(transit(spark, sf)).select(F.array_join("ids", ",").alias("ids"))


@query(_TRANSIT + """, walk(a, b) AS (SELECT src, dst FROM edges UNION SELECT w.a, e.dst FROM walk w JOIN edges e ON w.b = e.src),
part AS (SELECT x.a, min(y.a) AS p FROM walk x JOIN walk y ON x.b = y.a AND y.b = x.a GROUP BY 1) SELECT count(DISTINCT p) AS cycles, 0::BIGINT AS broken FROM part""")
def find_cycle_paths(spark, sf):
    g = transit(spark, sf)
    found = paths.find_cycle_paths(g)
    steps = found.select(F.explode(F.arrays_zip("path", F.concat(F.slice("path", 2, 1000), F.slice("path", 1, 1)).alias("next"))).alias("e")).select(F.col("e.path").alias("src"), F.col("e.next").alias("dst"))
    broken = steps.join(g.edges, ["src", "dst"], "left_anti").count()
    return _one(spark, cycles=found.count(), broken=broken)


# -- components and order ------------------------------------------------------------------------------


@query(GEO_REACH + "SELECT b AS id, CAST(substr(a, 3) AS BIGINT) AS component FROM reach WHERE a LIKE 'r:%' UNION ALL SELECT id, ord FROM nodes WHERE type = 'region'")
def connected_components(spark, sf):
    return components.connected_components(geo(spark, sf)).select("id", "component")


@query("SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders UNION ALL SELECT r.i, r.i FROM range(0, (SELECT max(o_orderkey) + 1 FROM orders)) r(i) WHERE r.i NOT IN (SELECT o_orderkey FROM orders)")
def components_from_edges(spark, sf):
    """Orders of one customer, chained in order of their keys."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    pairs = orders.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("b")).filter("b IS NOT NULL")
    return components.components_from_edges(spark, orders.agg(F.max("o_orderkey")).first()[0] + 1, pairs)


@query(GEO + "SELECT id, ord AS component FROM nodes")
def strongly_connected_components(spark, sf):
    return components.strongly_connected_components(geo(spark, sf)).select("id", "component")


@query(_SCC + " SELECT id, component FROM part")
def strong_components_of_trade(spark, sf):
    return components.strongly_connected_components(star.trade(spark, sf)).select("id", "component")


@query(GEO_REACH.rstrip() + """, parts AS (SELECT count(*) AS n FROM nodes WHERE id NOT IN (SELECT dst FROM edges)),
level AS (SELECT id, coalesce(max(d), 0) AS d FROM nodes LEFT JOIN reach ON b = id GROUP BY 1)
SELECT n AS parts, NOT EXISTS (SELECT 1 FROM reach WHERE a = b) AS dag, n = 1 AS connected, n = 1 AND (SELECT count(*) FROM edges) = (SELECT count(*) FROM nodes) - 1 AS tree,
(SELECT count(*) FROM (SELECT DISTINCT a, b FROM reach)) = (SELECT count(*) * (count(*) - 1) FROM nodes) AS strong,
NOT EXISTS (SELECT 1 FROM edges JOIN level x ON src = x.id JOIN level y ON dst = y.id WHERE x.d % 2 = y.d % 2) AS bipartite FROM parts""")
def graph_flags(spark, sf):
    g = geo(spark, sf)
    return _one(spark, parts=components.num_connected_components(g), dag=dag.is_dag(g), connected=components.is_connected(g), tree=dag.is_tree(g), strong=components.is_strongly_connected(g), bipartite=structure.is_bipartite(g))


@query(_TRADE + """, sym AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), hops(a, b, odd) AS (SELECT a, b, 1 FROM sym UNION SELECT h.a, s.b, 1 - h.odd FROM hops h JOIN sym s ON h.b = s.a),
walk(a, b) AS (SELECT src, dst FROM edges UNION SELECT w.a, e.dst FROM walk w JOIN edges e ON w.b = e.src), part AS (SELECT n.id, least(n.id, min(h.b)) AS p FROM nodes n LEFT JOIN hops h ON h.a = n.id GROUP BY 1)
SELECT count(DISTINCT p) AS parts, NOT EXISTS (SELECT 1 FROM walk WHERE a = b) AS dag, count(DISTINCT p) = 1 AS connected,
NOT EXISTS (SELECT 1 FROM nodes x, nodes y WHERE x.id <> y.id AND NOT EXISTS (SELECT 1 FROM walk WHERE a = x.id AND b = y.id)) AS strong, NOT EXISTS (SELECT 1 FROM hops WHERE a = b AND odd = 1) AS bipartite FROM part""")
def trade_flags(spark, sf):
    g = star.trade(spark, sf)
    return _one(spark, parts=components.num_connected_components(g), dag=dag.is_dag(g), connected=components.is_connected(g), strong=components.is_strongly_connected(g), bipartite=structure.is_bipartite(g))


@query(HIER + "SELECT id, CAST(CASE split_part(id, ':', 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 WHEN 'o' THEN 3 ELSE 2 END AS BIGINT) AS level FROM nodes")
def topological_sort(spark, sf):
    return dag.topological_sort(hier(spark, sf)).select("id", "level")


@query(HIER_REACH + "SELECT CAST(max(d) AS BIGINT) AS length, CAST(max(d) + 1 AS BIGINT) AS nodes FROM reach")
def longest_path(spark, sf):
    length, path = dag.longest_path(hier(spark, sf))
    return _one(spark, length=length, nodes=len(path))


@query("SELECT round(max(greatest(c_acctbal, 0)), 6) AS cost FROM (SELECT c_acctbal FROM customer UNION ALL SELECT s_acctbal FROM supplier)")
def critical_path(spark, sf):
    cost, _ = dag.critical_path(geo(spark, sf), "balance")
    return _one(spark, cost=round(cost, 6))


# -- ranks, communities, structure -----------------------------------------------------------------------


def _pagerank_sql(base: str, rounds: int) -> str:
    steps = ", ".join(
        f"q{k} AS MATERIALIZED (SELECT n.id, {1 - 0.85} / (SELECT count(*) FROM nodes) + 0.85 * coalesce(c.x, 0) + 0.85 * (SELECT coalesce(sum(p.r), 0) FROM r{k - 1} p WHERE p.id NOT IN (SELECT src FROM edges)) / (SELECT count(*) FROM nodes) AS r"
        f" FROM nodes n LEFT JOIN (SELECT e.dst, sum(p.r / o.n) AS x FROM edges e JOIN r{k - 1} p ON e.src = p.id JOIN ways o ON e.src = o.src GROUP BY 1) c ON n.id = c.dst),"
        f" r{k} AS MATERIALIZED (SELECT id, r / (SELECT sum(r) FROM q{k}) AS r FROM q{k})"
        for k in range(1, rounds + 1)
    )
    return base + f", ways AS MATERIALIZED (SELECT src, count(*) AS n FROM edges GROUP BY 1), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes), {steps} SELECT id, round(r, 9) AS score FROM r{rounds}"


@query(_pagerank_sql(_SUPPLY.replace("edges AS (", "edges AS MATERIALIZED ("), 20))
def pagerank(spark, sf):
    return _scores(centrality.pagerank(star.supply(spark, sf), iterations=20))


def _eigen_sql(rounds: int) -> str:
    steps = ", ".join(
        f"q{k} AS MATERIALIZED (SELECT n.id, coalesce(sum(p.x), 0) AS x FROM nodes n LEFT JOIN edges e ON n.id = e.dst LEFT JOIN x{k - 1} p ON e.src = p.id GROUP BY 1), x{k} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM q{k}) AS x FROM q{k})"
        for k in range(1, rounds + 1)
    )
    return _TRADE.replace("edges AS (", "edges AS MATERIALIZED (") + f", x0 AS MATERIALIZED (SELECT id, 1 / sqrt((SELECT count(*) FROM nodes)) AS x FROM nodes), {steps} SELECT id, round(x, 8) AS score FROM x{rounds}"


@query(_eigen_sql(5))
def eigenvector_centrality(spark, sf):
    return _scores(centrality.eigenvector_centrality(star.trade(spark, sf), iterations=5, tolerance=0.0), 8)


@query(GEO_REACH + "SELECT id, round((SELECT count(*) FROM reach WHERE b = id) * (SELECT count(*) FROM reach WHERE a = id) / (((SELECT count(*) FROM nodes) - 1.0) * ((SELECT count(*) FROM nodes) - 2.0)), 12) AS score FROM nodes")
def betweenness_centrality(spark, sf):
    return _scores(centrality.betweenness_centrality(geo(spark, sf)), 12)


@query(GEO_REACH + "SELECT id, round(coalesce((SELECT count(*) / CAST(sum(d) AS DOUBLE) FROM reach WHERE a = id), 0), 9) AS score FROM nodes")
def closeness_centrality(spark, sf):
    return _scores(centrality.closeness_centrality(geo(spark, sf)))


def _labels_sql(rounds: int) -> str:
    steps = ", ".join(
        f"v{k} AS (SELECT s.a, l.label, count(*) AS n FROM sym s JOIN l{k - 1} l ON s.b = l.id GROUP BY 1, 2), l{k} AS MATERIALIZED (SELECT o.id, coalesce(w.label, o.label) AS label FROM l{k - 1} o LEFT JOIN"
        f" (SELECT v.a, v.label, row_number() OVER (PARTITION BY v.a ORDER BY v.n DESC, v.label = p.label DESC, v.label) AS k FROM v{k} v JOIN l{k - 1} p ON v.a = p.id) w ON o.id = w.a AND w.k = 1)"
        for k in range(1, rounds + 1)
    )
    return GEO.rstrip() + f", sym AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), l0 AS MATERIALIZED (SELECT id, ord AS label FROM nodes), {steps} SELECT id, label FROM l{rounds}"


@query(_labels_sql(4))
def label_propagation(spark, sf):
    return community.label_propagation(geo(spark, sf), max_rounds=4).select("id", "label")


@query(GEO + "SELECT count(*) AS nodes, true AS within FROM nodes")
def louvain_communities(spark, sf):
    g = geo(spark, sf)
    found = community.louvain_communities(g).join(components.connected_components(g).select("id", "component"), "id")
    parts = found.groupBy("community").agg(F.countDistinct("component").alias("k"), F.count(F.lit(1)).alias("n"))
    return parts.agg(F.sum("n").alias("nodes"), (F.max("k") == 1).alias("within"))


_CORE = _with("rn")


def _core(spark, sf):
    return transform.by_types(geo(spark, sf), ["region", "nation"])


@query(GEO + "SELECT src, dst FROM edges")
def bridges(spark, sf):
    return structure.bridges(geo(spark, sf)).select("src", "dst")


@query(GEO + "SELECT id FROM nodes WHERE type = 'nation' OR (type = 'region' AND (SELECT count(*) FROM edges WHERE src = id) > 1)")
def articulation_points(spark, sf):
    return structure.articulation_points(geo(spark, sf)).select("id")


@query(GEO + "SELECT count(*) AS n FROM nodes WHERE type = 'nation'")
def maximum_matching(spark, sf):
    return structure.maximum_matching(geo(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0::BIGINT AS twice, 0::BIGINT AS open_edges")
def greedy_matching(spark, sf):
    g = geo(spark, sf)
    found = structure.greedy_matching(g)
    ends = found.select(F.explode(F.array("src", "dst")).alias("id"))
    left = g.edges.join(ends.withColumnRenamed("id", "src"), "src", "left_anti").join(ends.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return _one(spark, twice=ends.groupBy("id").count().filter("count > 1").count(), open_edges=left.count())


@query(_CORE + "SELECT dst AS a, src AS b FROM edges")
def maximal_cliques(spark, sf):
    return structure.maximal_cliques(_core(spark, sf)).groupBy("clique").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")


@query(_CORE + "SELECT src AS first, 1 + count(*) AS n FROM edges GROUP BY 1")
def k_clique_communities(spark, sf):
    return community.k_clique_communities(_core(spark, sf), 2).groupBy("community").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).select("first", "n")


# -- validation ------------------------------------------------------------------------------------------

_RULES = schema.GraphSchema(
    (schema.NodeType("region", ("name",)), schema.NodeType("nation", ("name", "code")), schema.NodeType("customer", ("name", "vip"))),
    (schema.EdgeType("hasNation", "region", "nation", ("since",)), schema.EdgeType("hasCustomer", "region", "customer")),
)


@query(GEO + """SELECT 'unknown_node_type' AS kind, id AS element_id, 'supplier' AS detail FROM nodes WHERE type = 'supplier'
UNION ALL SELECT 'missing_property', id, 'code' FROM nodes WHERE type = 'nation' UNION ALL SELECT 'missing_property', id, 'vip' FROM nodes WHERE type = 'customer' AND NOT coalesce(balance > 5000, false)
UNION ALL SELECT 'missing_property', src || '->' || dst, 'since' FROM edges WHERE type = 'hasNation' UNION ALL SELECT 'unknown_edge_type', src || '->' || dst, type FROM edges WHERE type = 'hasSupplier'
UNION ALL SELECT 'invalid_source_type', src || '->' || dst, 'region' FROM edges WHERE type = 'hasCustomer'""")
def validate_schema(spark, sf):
    return _RULES.validate(geo(spark, sf))


# -- SPARQL ----------------------------------------------------------------------------------------------


def _sparql(text: str):
    def run(spark, sf):
        return sparql.compile_select(sparql.triples_of(geo(spark, sf)), "PREFIX s: <urn:star:> " + text)

    return run


_SPARQL = {
    "sparql_join": ("SELECT ?r ?c WHERE { ?r s:hasNation ?n . ?n s:hasCustomer ?c }", GEO + "SELECT e.src AS r, f.dst AS c FROM edges e JOIN edges f ON e.dst = f.src WHERE e.type = 'hasNation' AND f.type = 'hasCustomer'"),
    "sparql_constants": ("SELECT ?p ?o WHERE { <n:3> ?p ?o }", GEO + "SELECT 'urn:star:' || type AS p, dst AS o FROM edges WHERE src = 'n:3'"),
    "sparql_distinct": ("SELECT DISTINCT ?p WHERE { ?s ?p ?o }", GEO + "SELECT DISTINCT 'urn:star:' || type AS p FROM edges"),
    "sparql_optional": ("SELECT ?n ?c WHERE { ?r s:hasNation ?n OPTIONAL { ?n s:hasCustomer ?c FILTER(REGEX(?c, '1$')) } }", GEO + "SELECT e.dst AS n, f.dst AS c FROM edges e LEFT JOIN edges f ON e.dst = f.src AND f.type = 'hasCustomer' AND f.dst LIKE '%1' WHERE e.type = 'hasNation'"),
    "sparql_union": ("SELECT ?x WHERE { { <n:3> s:hasCustomer ?x } UNION { <n:4> s:hasSupplier ?x } }", GEO + "SELECT dst AS x FROM edges WHERE (src = 'n:3' AND type = 'hasCustomer') OR (src = 'n:4' AND type = 'hasSupplier')"),
    "sparql_minus": ("SELECT ?n WHERE { ?r s:hasNation ?n MINUS { <r:1> s:hasNation ?n } }", GEO + "SELECT dst AS n FROM edges WHERE type = 'hasNation' AND src <> 'r:1'"),
    "sparql_exists": ("SELECT ?n WHERE { ?r s:hasNation ?n FILTER EXISTS { ?n s:hasSupplier ?x } FILTER NOT EXISTS { <r:1> s:hasNation ?n } }", GEO + "SELECT dst AS n FROM edges e WHERE type = 'hasNation' AND src <> 'r:1' AND EXISTS (SELECT 1 FROM edges f WHERE f.src = e.dst AND f.type = 'hasSupplier')"),
    "sparql_exists_outer": ("SELECT ?n ?c WHERE { ?n s:hasCustomer ?c FILTER EXISTS { ?n s:hasCustomer ?d FILTER(STR(?d) < STR(?c)) } FILTER NOT EXISTS { ?r s:hasNation ?n FILTER(STRSTARTS(STR(?c), 'c:2') && ?r = <r:1>) } }", GEO + "SELECT e.src AS n, e.dst AS c FROM edges e WHERE type = 'hasCustomer' AND EXISTS (SELECT 1 FROM edges f WHERE f.src = e.src AND f.type = 'hasCustomer' AND f.dst < e.dst) AND NOT EXISTS (SELECT 1 FROM edges g WHERE g.dst = e.src AND g.src = 'r:1' AND e.dst LIKE 'c:2%')"),
    "sparql_optional_chain": ("SELECT ?r ?n ?c WHERE { ?r s:hasNation ?x OPTIONAL { ?r s:hasNation ?n FILTER(STRSTARTS(STR(?n), 'n:1')) } OPTIONAL { ?n s:hasCustomer ?c } }", GEO.rstrip() + ", a AS (SELECT e.src AS r, f.dst AS n FROM edges e LEFT JOIN edges f ON f.src = e.src AND f.type = 'hasNation' AND f.dst LIKE 'n:1%' WHERE e.type = 'hasNation'), c AS (SELECT src AS n, dst AS c FROM edges WHERE type = 'hasCustomer') SELECT a.r, a.n, c.c FROM a LEFT JOIN c ON a.n = c.n WHERE a.n IS NOT NULL UNION ALL SELECT a.r, c.n, c.c FROM a LEFT JOIN c ON true WHERE a.n IS NULL"),
    "sparql_product": ("SELECT ?a ?b WHERE { ?a s:hasNation <n:3> . <n:4> s:hasSupplier ?b }", GEO + "SELECT e.src AS a, f.dst AS b FROM edges e, edges f WHERE e.dst = 'n:3' AND e.type = 'hasNation' AND f.src = 'n:4' AND f.type = 'hasSupplier'"),
    "sparql_group": ("SELECT ?n (COUNT(?c) AS ?k) WHERE { ?n s:hasCustomer ?c } GROUP BY ?n HAVING (COUNT(?c) > 3)", GEO + "SELECT src AS n, CAST(count(*) AS VARCHAR) AS k FROM edges WHERE type = 'hasCustomer' GROUP BY 1 HAVING count(*) > 3"),
    "sparql_count_all": ("SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?p) AS ?k) WHERE { ?s ?p ?o }", GEO + "SELECT CAST(count(*) AS VARCHAR) AS n, CAST(count(DISTINCT type) AS VARCHAR) AS k FROM edges"),
    "sparql_order_limit": ("SELECT ?s ?o WHERE { ?s ?p ?o } ORDER BY DESC(?o) ?s LIMIT 10 OFFSET 5", GEO + "SELECT src AS s, dst AS o FROM edges ORDER BY dst DESC, src LIMIT 10 OFFSET 5"),
    "sparql_path": ("SELECT ?r ?x WHERE { ?r s:hasNation/(s:hasCustomer|s:hasSupplier) ?x }", GEO + "SELECT e.src AS r, f.dst AS x FROM edges e JOIN edges f ON e.dst = f.src"),
    "sparql_path_plus": ("SELECT ?x WHERE { <r:0> (s:hasNation|s:hasCustomer|s:hasSupplier)+ ?x }", GEO_REACH + "SELECT b AS x FROM reach WHERE a = 'r:0'"),
    "sparql_path_inverse": ("SELECT ?x ?y WHERE { ?x ^s:hasNation ?y }", GEO + "SELECT dst AS x, src AS y FROM edges WHERE type = 'hasNation'"),
    "sparql_bind_filter": ("SELECT ?o ?u ?n WHERE { ?s s:hasSupplier ?o BIND(UCASE(STR(?o)) AS ?u) BIND(STRLEN(?o) AS ?n) FILTER(STRSTARTS(?s, 'n:1') && ?n >= 3) }", GEO + "SELECT dst AS o, upper(dst) AS u, CAST(length(dst) AS VARCHAR) AS n FROM edges WHERE type = 'hasSupplier' AND src LIKE 'n:1%' AND length(dst) >= 3"),
    "sparql_values": ("SELECT ?n ?c WHERE { VALUES ?n { <n:1> <n:2> } ?n s:hasCustomer ?c }", GEO + "SELECT src AS n, dst AS c FROM edges WHERE type = 'hasCustomer' AND src IN ('n:1', 'n:2')"),
    "sparql_subquery": ("SELECT ?r ?n ?k WHERE { ?r s:hasNation ?n { SELECT ?n (COUNT(*) AS ?k) WHERE { ?n s:hasSupplier ?x } GROUP BY ?n } }", GEO + "SELECT e.src AS r, e.dst AS n, CAST(k AS VARCHAR) AS k FROM edges e JOIN (SELECT src, count(*) AS k FROM edges WHERE type = 'hasSupplier' GROUP BY 1) f ON e.dst = f.src WHERE e.type = 'hasNation'"),
}
for _key, (_text, _sql) in _SPARQL.items():
    QUERIES[_key] = _sparql(_text)
    ORACLE_SQL[_key] = _sql


@query(GEO + "SELECT EXISTS (SELECT 1 FROM edges WHERE src = 'n:3') AS some, EXISTS (SELECT 1 FROM edges WHERE dst = 'n:none') AS none_")
def sparql_ask(spark, sf):
    g = geo(spark, sf)
    return _one(spark, some=sparql.ask(g, "ASK { <n:3> ?p ?o }"), none_=sparql.ask(g, "ASK { ?s ?p <n:none> }"))


# -- formats ---------------------------------------------------------------------------------------------


@query(GEO + "SELECT '<' || src || '> <urn:star:' || type || '> <' || dst || '> .' AS value FROM edges")
def to_ntriples(spark, sf):
    return rdf.ntriples_lines(geo(spark, sf)).select("value")


@query(GEO + "SELECT src AS s, 'urn:star:' || type AS p, dst AS o FROM edges")
def read_ntriples(spark, sf):
    return rdf.line_triples(rdf.ntriples_lines(geo(spark, sf)).select("value")).select("s", "p", "o")


@query(GEO + """SELECT '"' || src || '":[' || string_agg('["' || dst || '",{"predicate":"urn:star:' || e.type || '","type":"' || e.type || '"}]', ',' ORDER BY ord) || ']' AS value FROM edges e JOIN nodes ON dst = id GROUP BY src""")
def to_adjacency(spark, sf):
    return documents.adjacency_rows(geo(spark, sf)).select("value")


@query(GEO + "SELECT id, type, coalesce(name, '') AS name, coalesce(segment, '') AS segment FROM nodes")
def to_tabular(spark, sf):
    return tables.to_tabular(geo(spark, sf))[0].select("id", "type", "name", "segment")


@query(GEO + """SELECT '    "' || id || '" [label="' || name || '"];' AS value FROM nodes UNION ALL SELECT '    "' || src || '" -> "' || dst || '";' FROM edges""")
def to_dot(spark, sf):
    nodes, edges = documents.dot_lines(geo(spark, sf), node_label=P.string(F.col("props")["name"]))
    return nodes.unionByName(edges).select("value")


@query(GEO + "SELECT id, type, name FROM nodes")
def json_round_trip(spark, sf):
    root = scratch_path(spark, "json")
    folders.save_json(geo(spark, sf), root)
    g = folders.load_json(spark, root)
    return g.nodes.select("id", P.string(F.col("props")["type"]).alias("type"), P.string(F.col("props")["name"]).alias("name"))


@query(GEO + "SELECT src, dst, type FROM edges")
def graphml_round_trip(spark, sf):
    root = scratch_path(spark, "graphml")
    folders.save_graphml(geo(spark, sf), root)
    g = folders.load_graphml(spark, root)
    return g.edges.select("src", "dst", P.string(F.col("props")["type"]).alias("type"))


@query(GEO + "SELECT src, dst, type FROM edges")
def gexf_round_trip(spark, sf):
    root = scratch_path(spark, "gexf")
    folders.save_gexf(geo(spark, sf), root)
    g = folders.load_gexf(spark, root)
    return g.edges.select("src", "dst", P.string(F.col("props")["type"]).alias("type"))


@query("SELECT 'u:' || user_id AS src, 'e:' || event_id AS dst, 'contains' AS type FROM events UNION ALL SELECT * FROM (SELECT 'e:' || event_id, 'e:' || lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, 'data_flow' FROM events) WHERE nxt IS NOT NULL")
def trace_graph(spark, sf):
    g = tables.spans_to_graph(star.event_spans(spark, sf))
    return g.edges.select("src", "dst", P.string(F.col("props")["type"]).alias("type"))


@query(GEO + "SELECT src, dst, 'urn:star:' || type AS predicate, type FROM edges")
def load_turtle(spark, sf):
    g, _ = rdf.load_rdf(spark, rdf.to_turtle(geo(spark, sf)), "turtle")
    return g.edges.select("src", "dst", P.string(F.col("props")["predicate"]).alias("predicate"), F.regexp_extract(P.string(F.col("props")["label"]), "[^:]*$", 0).alias("type"))


@query(GEO + "SELECT src, dst FROM edges")
def load_trig(spark, sf):
    g, _ = rdf.load_rdf(spark, "<urn:g> {\n" + rdf.to_turtle(geo(spark, sf)) + "}", "trig")
    return _edges(g)


@query(GEO + "SELECT count(*) AS triples, (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, 0::BIGINT AS literals FROM edges")
def rdf_stats(spark, sf):
    _, seen = rdf.load_rdf(spark, rdf.to_ntriples(geo(spark, sf)), "ntriples")
    return _one(spark, triples=seen.triples, nodes=seen.nodes, edges=seen.edges, literals=seen.literals)


@query(GEO.rstrip() + """, own AS (SELECT src, edges.type AS type, CASE WHEN count(*) = 1 THEN min('{"@id":"' || dst || '"}') ELSE '[' || string_agg('{"@id":"' || dst || '"}', ',' ORDER BY ord) || ']' END AS v FROM edges JOIN nodes n ON dst = n.id GROUP BY src, edges.type)
SELECT '{"@id":"' || src || '",' || string_agg('"urn:star:' || type || '":' || v, ',' ORDER BY type) || '}' AS value FROM own GROUP BY src
UNION ALL SELECT '{"@id":"' || id || '"}' FROM nodes WHERE id NOT IN (SELECT src FROM edges)""")
def to_jsonld(spark, sf):
    return rdf.jsonld_nodes(geo(spark, sf)).select("value")


@query(_CORE + """SELECT 'flowchart LR' AS line UNION ALL SELECT '    ' || replace(id, ':', '_') || '["' || id || '"]' FROM nodes UNION ALL SELECT '    ' || replace(src, ':', '_') || ' --> ' || replace(dst, ':', '_') FROM edges""")
def to_mermaid(spark, sf):
    text = documents.to_mermaid(_core(spark, sf), direction="LR")
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


@query(GEO + "SELECT src, dst, type FROM edges")
def adjacency_round_trip(spark, sf):
    root = scratch_path(spark, "adjacency")
    folders.save_adjacency(geo(spark, sf), root)
    g = folders.load_adjacency(spark, root)
    return g.edges.select("src", "dst", P.string(F.col("props")["type"]).alias("type"))


@query(GEO + "SELECT id, type, balance FROM nodes")
def storage_round_trip(spark, sf):
    root = scratch_path(spark, "store")
    tables.save(geo(spark, sf), root, "geo")
    return tables.load(spark, root, "geo").nodes.select("id", P.string(F.col("props")["type"]).alias("type"), P.number(F.col("props")["balance"]).alias("balance"))


@query(GEO + "SELECT id, CASE id WHEN 'r:0' THEN 'x' ELSE type END AS type FROM nodes")
def set_node_property(spark, sf):
    g = mutate.set_node_property(geo(spark, sf), "r:0", "type", "x")
    return g.nodes.select("id", P.string(F.col("props")["type"]).alias("type"))


@query(_with("rnsco", _DEG) + "SELECT count(*) AS node_count, (SELECT count(*) FROM edges) AS edge_count, round(avg(i + o), 4) AS avg_degree, max(i + o) AS max_degree FROM deg")
def graph_stats(spark, sf):
    g = hier(spark, sf)
    return g.degrees().agg(F.count(F.lit(1)).alias("node_count"), F.round(F.avg("degree"), 4).alias("avg_degree"), F.max("degree").alias("max_degree")).withColumn("edge_count", F.lit(g.n_edges()))


@query(GEO + "SELECT (SELECT count(*) FROM nodes WHERE type = 'nation') AS nodes, (SELECT count(*) FROM edges WHERE type = 'hasNation') AS edges")
def find_patterns(spark, sf):
    g = geo(spark, sf)
    return _one(spark, nodes=g.filter_nodes(type="nation").count(), edges=g.filter_edges(type="hasNation").count())


@query(GEO_REACH + "SELECT b AS id FROM reach WHERE a = 'r:0' AND d <= 2 UNION SELECT 'r:0'")
def ego_graph_of_two(spark, sf):
    return transform.ego_graph(geo(spark, sf), "r:0", 2).nodes.select("id")


@query(GEO_REACH + "SELECT CAST(d AS DOUBLE) AS hops FROM reach WHERE a = 'r:0' AND b = (SELECT min(b) FROM reach WHERE a = 'r:0' AND d = 2)")
def shortest_path_length(spark, sf):
    g = geo(spark, sf)
    far = traversal.bfs_at_depth(g, "r:0", 2).agg(F.min("id")).first()[0]
    return _one(spark, hops=paths.shortest_path_length(g, "r:0", far))


@query(GEO + "SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, true AS directed, false AS multi FROM nodes")
def reverse_twice(spark, sf):
    g = transform.reverse(transform.reverse(geo(spark, sf)))
    same = g.edges.join(geo(spark, sf).edges, ["src", "dst"], "left_semi").count()
    return _one(spark, nodes=g.n_nodes(), edges=same, directed=g.directed, multi=g.multi)
