"""Operators on small graphs with results worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from weft.errors import InvalidFormatError, LimitExceededError, WeightError
from weft.functions import props as P
from weft.graph import PropertyGraph, numbered
from weft.operators import centrality, community, components, dag, mutate, paths, schema, structure, transform, traversal


@pytest.fixture(autouse=True, scope="module")
def one_task():
    """Small graphs here; ``test_small.py`` compares with the distributed loops."""
    from weft.operators import small

    with small.one_task_up_to(1_000_000):
        yield


def make(spark, nodes, edges, **kind):
    return PropertyGraph.of(spark, list(nodes), list(edges), **kind)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


@pytest.fixture(scope="module")
def chain(spark):
    return make(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d")]).persist()


@pytest.fixture(scope="module")
def cycle(spark):
    return make(spark, "abc", [("a", "b"), ("b", "c"), ("c", "a")]).persist()


@pytest.fixture(scope="module")
def cliques(spark):
    full = [(x, y) for part in ("abcd", "efgh") for k, x in enumerate(part) for y in part[k + 1 :]]
    return make(spark, "abcdefgh", [*full, ("d", "e")], directed=False).persist()


def test_structure_errors(spark):
    with pytest.raises(ValueError):
        make(spark, ["a", "a"], [])
    with pytest.raises(ValueError):
        make(spark, "a", [("a", "x")])
    with pytest.raises(ValueError):
        make(spark, "ab", [("a", "b"), ("b", "a")], directed=False)
    assert make(spark, "ab", [("a", "b"), ("a", "b")], multi=True).n_edges() == 2


def test_lookups_and_filters(spark):
    g = make(spark, [("x", {"k": 1, "n": None}), ("y", {"k": 1.0}), ("z", {})], [("x", "y", {"w": 1}), ("y", "z", {"w": 1.0}), ("z", "x", {"w": True}), ("x", "x", {})])
    assert ids(g.filter_nodes(k=1)) == ["x"] and ids(g.filter_nodes(n=None)) == ["x"]
    assert g.filter_edges(w=1).count() == 3 and g.filter_edges(w=None).count() == 1 and g.edges_filtered("w", 1).count() == 1
    assert g.degree("x") == 4 and ids(g.neighbors("x")) == ["x", "y", "z"]
    assert g.node("x") == {"id": "x", "properties": {"k": 1, "n": None}} and g.node("q") is None
    with pytest.raises(KeyError):
        g.successors("q")
    loop = make(spark, "ab", [("a", "a"), ("a", "b")], directed=False)
    assert loop.degree("a") == 2 and loop.has_edge("b", "a")


def test_changes(spark, chain):
    g = mutate.add_edge(mutate.add_node(chain, "e", v=1.5), "d", "e", w=2)
    assert g.n_nodes() == 5 and g.n_edges() == 4 and g.node("e")["properties"] == {"v": 1.5}
    for wrong in (lambda: mutate.add_node(chain, "a"), lambda: mutate.add_edge(chain, "a", "b")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        mutate.remove_edge(chain, "b", "a")
    assert mutate.remove_node(chain, "b").n_edges() == 1
    twice = make(spark, "ab", [("a", "b", {"n": 1}), ("a", "b", {"n": 2})], multi=True)
    assert [P.decode(r["props"]["n"]) for r in mutate.remove_edge(twice, "a", "b").edges.collect()] == [2]
    assert mutate.update_node(mutate.set_node_property(chain, "a", "k", [1]), "a", j="x").node("a")["properties"] == {"k": [1], "j": "x"}


def test_transforms(spark, chain):
    g = transform.subgraph(chain, ["c", "b"])
    assert [r["id"] for r in g.node_ids().collect()] == ["c", "b"] and g.n_edges() == 1
    for wrong in (["a", "a"], ["a", "q"]):
        with pytest.raises(ValueError):
            transform.subgraph(chain, wrong)
    assert ids(transform.ego_graph(chain, "b").nodes) == ["a", "b", "c"]
    assert ids(transform.reverse(transform.reverse(chain)).edges, "src") == ["a", "b", "c"]
    two = make(spark, "ab", [("a", "b", {"k": 1}), ("b", "a", {"k": 2})])
    assert [P.decode(r["props"]["k"]) for r in transform.to_undirected(two).edges.collect()] == [1]
    x, y = make(spark, [("x", {"a": 1, "b": 2})], []), make(spark, [("x", {"b": 99, "c": 3}), "y"], [("x", "y")])
    assert transform.merge_graphs(x, y, "merge").node("x")["properties"] == {"a": 1, "b": 99, "c": 3}
    assert transform.merge_graphs(x, y, "keep_first").node("x")["properties"] == {"a": 1, "b": 2}
    assert transform.merge_graphs(x, y).node("x")["properties"] == {"b": 99, "c": 3}
    assert sorted(r["kind"] for r in transform.diff_graphs(x, y).collect()) == ["added_edge", "added_node", "changed_node"]


def test_knowledge(spark):
    g = make(spark, [("a", {"type": "person", "name": "Alice"}), ("b", {"type": "person"}), ("c", {"type": "org"})], [("a", "b", {"predicate": "knows"}), ("a", "c", {"predicate": "worksAt"}), ("b", "c", {})])
    assert transform.by_types(g, ["person"]).n_nodes() == 2
    assert [(r["src"], r["dst"]) for r in transform.extract_subgraph(g, edge_types=["knows"]).edges.collect()] == [("a", "b")]
    assert sorted(tuple(r) for r in transform.project_triples(g).collect()) == [("a", "knows", "b"), ("a", "worksAt", "c"), ("b", "relatedTo", "c")]
    isa = make(spark, "ABCD", [(a, b, {"predicate": "isa"}) for a, b in ("AB", "BC", "CD")] + [("A", "C", {"predicate": "other"})])
    assert transform.infer_types(isa, "isa").n_edges() == 6  # A->C is there already
    found = transform.from_triples(spark.createDataFrame([("b", "p", "a", 0), ("a", "q", "c", 1), ("b", "r", "a", 2)], "s string, p string, o string, eord long"))
    assert [r["id"] for r in found.node_ids().collect()] == ["b", "a", "c"] and found.n_edges() == 2


def test_walks(spark, chain, cycle):
    assert [r["id"] for r in traversal.bfs(chain, "a").collect()] == list("abcd")
    assert {r["id"]: r["depth"] for r in traversal.bfs_with_depth(chain, "b").collect()} == {"b": 0, "c": 1, "d": 2}
    assert [r["id"] for r in traversal.dfs(chain, "a").orderBy("seq").collect()] == list("abcd")
    assert ids(traversal.ancestors(chain, "c")) == ["a", "b"] and ids(traversal.descendants(cycle, "a")) == ["a", "b", "c"]
    assert traversal.has_path(chain, "a", "d") and not traversal.has_path(chain, "d", "a")
    path = make(spark, "abc", [("a", "b"), ("b", "c")], directed=False)
    assert ids(traversal.ancestors(path, "b")) == ["a", "b", "c"]
    with pytest.raises(KeyError):
        traversal.bfs(chain, "q")


def test_paths(spark):
    g = make(spark, "abcd", [("a", "b", {"weight": 1}), ("b", "c", {"weight": 1}), ("a", "c", {"weight": 10}), ("c", "d", {"weight": 2})]).persist()
    assert {r["id"]: r["cost"] for r in paths.shortest_paths(g, "a").collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r["id"]: r["cost"] for r in paths.shortest_paths(g, "a", weight="weight").collect()} == {"a": 0, "b": 1, "c": 2, "d": 4}
    assert paths.astar_path(g, "a", "d", "weight") == (4.0, list("abcd")) and paths.astar_path(g, "d", "a") is None
    assert paths.shortest_path_length(g, "d", "a") is None
    negative = make(spark, "abc", [("a", "b", {"w": 1}), ("b", "c", {"w": -3}), ("c", "b", {"w": 1})])
    with pytest.raises(ValueError):
        paths.bellman_ford_paths(negative, "a", "w")
    with pytest.raises(ValueError):
        paths.bellman_ford_paths(negative, "q")
    odd = make(spark, "ab", [("a", "b", {"w": "7"})])
    assert paths.shortest_path_length(odd, "a", "b", "w") == 1.0


def test_simple_paths_and_cycles(spark, chain):
    diamond = make(spark, "abcd", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert [r["path"] for r in paths.all_simple_paths(diamond, "a", "d").collect()] == [list("abd"), list("acd")]
    short = make(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")])
    assert [r["path"] for r in paths.all_simple_paths(short, "a", "d", max_depth=3).collect()] == [list("acd")]
    two = make(spark, "abcd", [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")])
    assert ids(paths.find_cycles(two), "ids") == [["a", "b"], ["c", "d"]]
    assert sorted(len(r["path"]) for r in paths.find_cycle_paths(two).collect()) == [2, 2]
    loop = make(spark, "a", [("a", "a")])
    assert ids(paths.find_cycles(loop), "ids") == [["a"]] and paths.find_cycles(chain).count() == 0


def test_components(spark, cycle, chain):
    found = components.components_from_edges(spark, 6, spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long"))
    assert [r["component"] for r in found.orderBy("node").collect()] == [0, 0, 0, 3, 3, 5]
    with pytest.raises(ValueError, match="5"):
        components.components_from_edges(spark, 3, spark.createDataFrame([(0, 5)], "a long, b long"))
    mixed = make(spark, "abcde", [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e")])
    groups = {r["id"]: r["component"] for r in components.strongly_connected_components(mixed).collect()}
    assert groups == {"a": 0, "b": 0, "c": 2, "d": 2, "e": 4}
    assert components.is_strongly_connected(cycle) and not components.is_strongly_connected(chain)
    long = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.min_labels(long).agg(F.max("component"), F.count(F.lit(1))).first()[:] == (0, 201)
    g = transform.condensation(mixed)
    assert ids(g.nodes) == ["a,b", "c,d", "e"] and g.n_edges() == 2 and dag.is_dag(g)


def test_order(spark, cycle, chain):
    with pytest.raises(ValueError):
        dag.topological_sort(cycle)
    assert dag.longest_path(chain) == (3, list("abcd")) and dag.is_tree(chain) and not dag.is_dag(cycle)
    g = make(spark, [("start", {"latency_ms": 0}), ("fast", {"latency_ms": 10}), ("slow", {"latency_ms": "500"}), ("end", {"latency_ms": 5})], [("start", "fast"), ("start", "slow"), ("fast", "end"), ("slow", "end")])
    cost, path = dag.critical_path(g)
    assert cost == 505.0 and path[-2:] == ["slow", "end"]
    with pytest.raises(WeightError):
        dag.critical_path(make(spark, [("a", {"latency_ms": True})], []))
    empty = PropertyGraph.empty(spark)
    assert dag.is_tree(empty) and dag.is_dag(empty) and components.is_connected(empty) and dag.longest_path(empty) == (0, [])
    assert dag.critical_path(empty) == (0.0, []) and structure.density(empty) == 0.0


def test_ranks(spark, chain, cycle):
    found = scores(centrality.pagerank(cycle, iterations=20))
    assert all(math.isclose(x, 1 / 3) for x in found.values())
    star = make(spark, ["hub", *(f"leaf{k}" for k in range(5))], [(f"leaf{k}", "hub") for k in range(5)])
    top = centrality.ranked(centrality.pagerank(star, iterations=30), 1).first()
    assert top["id"] == "hub" and math.isclose(sum(scores(centrality.pagerank(star, iterations=5)).values()), 1.0)
    single = make(spark, "ab", [("a", "b")], directed=False)
    rank = scores(centrality.pagerank(single, iterations=10))
    assert rank["b"] > rank["a"]  # stored orientation
    assert scores(centrality.betweenness_centrality(chain, normalized=False)) == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}
    assert math.isclose(scores(centrality.betweenness_centrality(chain))["b"], 2 / 6)
    assert scores(centrality.closeness_centrality(make(spark, "abc", [("a", "b"), ("b", "c")]))) == {"a": 2 / 3, "b": 1.0, "c": 0.0}
    assert all(math.isclose(x, 3**-0.5) for x in scores(centrality.eigenvector_centrality(cycle)).values())
    fan = make(spark, "abcd", [("a", "b"), ("a", "c")])
    assert math.isclose(scores(centrality.degree_centrality(fan))["a"], 2 / 3)
    assert {r["degree"]: r["n"] for r in structure.degree_distribution(fan).collect()} == {0: 1, 1: 2, 2: 1}
    assert ids(structure.find_orphan_nodes(fan)) == ["d"] and ids(structure.find_hub_nodes(fan, 1)) == ["a"]


def test_communities(spark, cliques):
    for df, column in ((community.louvain_communities(cliques), "community"), (community.label_propagation(cliques), "label")):
        groups = {}
        for r in df.collect():
            groups.setdefault(r[column], set()).add(r["id"])
        assert sorted(map(sorted, groups.values())) == [list("abcd"), list("efgh")]
    assert sorted(r["count"] for r in community.k_clique_communities(cliques, 3).groupBy("community").count().collect()) == [4, 4]
    assert sorted(r["count"] for r in structure.maximal_cliques(cliques).groupBy("clique").count().collect()) == [2, 4, 4]
    with pytest.raises(LimitExceededError):
        structure.maximal_cliques(cliques, max_input_nodes=3)
    with pytest.raises(LimitExceededError):
        structure.bridges(cliques, max_edges=3)


def test_structure(spark, cliques):
    assert [(r["src"], r["dst"]) for r in structure.bridges(cliques).collect()] == [("d", "e")]
    assert ids(structure.articulation_points(cliques)) == ["d", "e"]
    assert structure.maximum_matching(cliques).count() == 4
    assert not structure.is_bipartite(cliques)
    assert structure.is_bipartite(make(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]))
    assert not structure.is_bipartite(make(spark, "a", [("a", "a")]))
    pentagon = make(spark, "abcdef", [*zip("abcde", "bcdea"), ("a", "f")], directed=False)
    assert structure.maximum_matching(pentagon).count() == 3  # needs a blossom
    mutual = make(spark, "abc", [("a", "b"), ("b", "a"), ("b", "c")])
    assert [(r["src"], r["dst"]) for r in structure.bridges(mutual).collect()] == [("b", "c")]


def test_closures(spark, chain):
    assert transform.transitive_closure(chain).n_edges() == 6
    assert transform.transitive_closure(make(spark, "abc", [("a", "b"), ("b", "c")], directed=False)).n_edges() == 3
    assert transform.transitive_reduction(make(spark, "abc", [("a", "b"), ("b", "c"), ("a", "c")])).n_edges() == 2


def test_schema(spark):
    rules = schema.GraphSchema((schema.NodeType("Person", ("name",)), schema.NodeType("Organization", ("name", "industry"))), (schema.EdgeType("works_at", "Person", "Organization", ("since",)),))
    good = make(spark, [("a", {"type": "Person", "name": None}), ("b", {"type": "Organization", "name": "x", "industry": "y"}), "c"], [("a", "b", {"type": "works_at", "since": 2020}), ("a", "c", {})])
    assert rules.validate(good).count() == 0 and schema.GraphSchema().validate(good).count() == 0
    bad = make(spark, [("a", {"type": "Person"}), ("s", {"type": "Server"})], [("a", "s", {"type": "works_at"}), ("s", "a", {"type": "knows"})])
    assert sorted((r["kind"], r["element_id"]) for r in rules.validate(bad).collect()) == [("invalid_target_type", "a->s"), ("missing_property", "a"), ("missing_property", "a->s"), ("unknown_edge_type", "s->a"), ("unknown_node_type", "s")]


def test_numbering_and_props(spark):
    rows = numbered(spark.range(1000).select((1000 - F.col("id")).alias("id")), ["id"], "k").collect()
    assert all(r["k"] == r["id"] - 1 for r in rows)
    assert [P.encode(x) for x in (1, 1.0, True, None, "a\"b", [1, {"b": 1, "a": 2}], float("nan"), (1,), 2**70)] == ["1", "1.0", "true", "null", '"a\\"b"', '[1,{"a":2,"b":1}]', "null", '"(1,)"', "1.1805916207174113e+21"]
    texts = ["é\"\\\n", "", None, "x"]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select(P.quote(F.col("v")).alias("q")).collect()
    assert [json.loads(r["q"]) for r in got] == texts
    with pytest.raises(InvalidFormatError):
        from weft.sources import documents

        documents.from_json(spark, "[]")


def test_scratch_is_cleaned(spark):
    from weft import runtime

    kept = runtime.materialize(spark.range(5), "mine")
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(folder)
    runtime._SCRATCH[:] = [p for p in runtime._SCRATCH if "weft-mine-" in p]
    runtime.clean(spark)
    assert not os.path.isdir(folder)
