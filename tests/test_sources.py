"""Formats, RDF, SPARQL, tools and the streaming extension."""

import json

import pytest
from pyspark.sql import functions as F

from weft import tools
from weft.errors import InvalidFormatError, LimitExceededError, PathNotAllowedError
from weft.functions import props as P
from weft.graph import PropertyGraph
from weft.plans import sparql
from weft.settings import Settings
from weft.sources import documents, folders, rdf, tables

TURTLE = """@prefix ex: <http://example.org/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
ex:Animal a rdfs:Class ; rdfs:label "Animal"@en .
ex:Dog a rdfs:Class ; rdfs:subClassOf ex:Animal ; rdfs:label "Dog" .  # a comment
ex:Cat a rdfs:Class ; rdfs:subClassOf ex:Animal .
"""


def test_every_scheme_is_checked(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.ttl").write_text("")
    (tmp_path / "out.ttl").write_text("")
    own = Settings(allowed_root=str(tmp_path / "in"))
    for path in (f"{tmp_path}/in/a b.ttl", f"file://{tmp_path}/in/a b.ttl", f"file:{tmp_path}/in/a%20b.ttl", f"FILE://localhost{tmp_path}/in/a b.ttl"):
        assert rdf.allowed(path, own) == f"{tmp_path}/in/a b.ttl"
    for path in (f"file://{tmp_path}/out.ttl", f"file://{tmp_path}/in/../out.ttl", f"file://host{tmp_path}/in/a b.ttl", "s3a://bucket/x", "hdfs:///x", f"{tmp_path}/in/../out.ttl"):
        with pytest.raises(PathNotAllowedError):
            rdf.allowed(path, own)
    far = Settings(allowed_root="s3a://bucket/data")
    assert rdf.allowed("s3a://bucket/data/x/../y.ttl", far) == "s3a://bucket/data/y.ttl"
    for path in ("s3a://bucket/data/../x", "s3a://other/data/x", "s3a://bucket/database/x", f"{tmp_path}/out.ttl"):
        with pytest.raises(PathNotAllowedError):
            rdf.allowed(path, far)


@pytest.fixture(scope="module")
def small(spark):
    return PropertyGraph.of(spark, [("a", {"label": 'Node "A" <&>', "n": 1, "mix": 1}), ("b", {"label": "Node B", "deep": {"k": [1, 2]}, "mix": "x"}), "c"], [("a", "b", {"weight": 1.0}), ("b", "c", {"weight": 2.5, "ok": True})], name="small").persist()


def state(g):
    return (
        sorted((r["id"], json.dumps(P.decode_map(r["props"]), sort_keys=True)) for r in g.nodes.collect()),
        sorted((r["src"], r["dst"], json.dumps(P.decode_map(r["props"]), sort_keys=True)) for r in g.edges.collect()),
    )


def test_json(spark, small):
    back = documents.from_json(spark, documents.to_json(small))
    assert state(back) == state(small) and back.name == "small"
    for wrong in ('{"directed":true}', '{"directed":true,"name":"","nodes":[],"edges":[],"x":1}', "nope", '{"directed":true,"name":"","nodes":[{"id":"a","properties":{}},{"id":"a","properties":{}}],"edges":[]}'):
        with pytest.raises(ValueError):
            documents.from_json(spark, wrong)
    with pytest.raises(LimitExceededError):
        documents.from_json(spark, documents.to_json(small), Settings(max_nodes=2))
    inline = documents.from_inline_json(spark, '{"nodes":[{"id":"a","k":1},{"id":"b"}],"edges":[{"source":"a","target":"b","w":2}]}')
    assert state(inline) == ([("a", '{"k": 1}'), ("b", "{}")], [("a", "b", '{"w": 2}')])


def test_adjacency(spark, small):
    assert state(documents.from_adjacency_json(spark, documents.to_adjacency_json(small))) == state(small)
    g = documents.from_adjacency_json(spark, '{"edges":{"a":["b",["c",{"k":1}],5]}}')
    assert g.n_nodes() == 3 and g.n_edges() == 2
    with pytest.raises(InvalidFormatError):
        documents.from_adjacency_json(spark, '{"nodes":[]}')


def test_xml(spark, small):
    nodes, edges = state(documents.from_graphml(spark, documents.to_graphml(small)))
    assert edges == state(small)[1]
    want = {k: json.loads(v) for k, v in state(small)[0]}
    want["a"]["mix"] = "1"  # a key of mixed types is a string
    assert {k: json.loads(v) for k, v in nodes} == want
    gexf = dict(state(documents.from_gexf(spark, documents.to_gexf(small)))[0])
    assert json.loads(gexf["c"]) == {"label": "c"} and json.loads(gexf["b"])["deep"] == {"k": [1, 2]}
    with pytest.raises(InvalidFormatError):
        documents.from_graphml(spark, '<!DOCTYPE x [<!ENTITY a "b">]><graphml/>')
    with pytest.raises(InvalidFormatError):
        documents.from_gexf(spark, "<gexf/>")


FOLDERS = ["graphml", "gexf", "adjacency", "json"]
READERS = {"graphml": documents.from_graphml, "gexf": documents.from_gexf, "adjacency": documents.from_adjacency_json, "json": documents.from_json}


@pytest.fixture
def short_splits(spark):
    """Files are read in many splits, so lists and parts go over their ends."""
    own = {"spark.sql.files.maxPartitionBytes": "1200", "spark.sql.files.openCostInBytes": "1"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k in own:
        spark.conf.unset(k)


@pytest.mark.parametrize("kind", FOLDERS)
def test_folders(spark, tmp_path, short_splits, kind):
    nodes = [(f"n{k}", {"label": f"line\n{k}\r\n\tof <&> \"x\"", "n": k, "deep": {"k": ["]", "[", k]}} if k % 3 else {}) for k in reversed(range(40))]
    edges = [(f"n{a}", f"n{b}", {"w": a / 2, "note": ',"[\n]'} if b % 2 else {}) for a, b in [(k, k // 2) for k in range(1, 40)] + [(7, k) for k in range(8, 30)]]
    for directed, g in ((True, PropertyGraph.of(spark, nodes, edges, name="odd <&>")), (False, PropertyGraph.of(spark, nodes[:1], [], directed=False)), (True, PropertyGraph.empty(spark))):
        root = tmp_path / f"{directed}{g.n_nodes()}"
        getattr(folders, f"save_{kind}")(g, f"file://{root}")
        text = "".join(f.read_text() for f in sorted(root.glob("*/part-*")))
        back, whole = getattr(folders, f"load_{kind}")(spark, f"file://{root}"), READERS[kind](spark, text)
        assert state(back) == state(whole) and (back.directed, back.multi, back.name) == (whole.directed, whole.multi, whole.name) and back.directed == directed
        order = lambda x: ([r["id"] for r in x.nodes.orderBy("ord").collect()], [(r["src"], r["dst"]) for r in x.edges.orderBy("eord").collect()])
        assert order(back) == order(whole) and order(back)[0] == order(g)[0]
        assert state(back)[1] == state(g)[1]
    (part := root / "1-nodes").mkdir(exist_ok=True)
    (part / "part-9").write_text("nonsense\n")
    with pytest.raises(InvalidFormatError):
        getattr(folders, f"load_{kind}")(spark, f"file://{root}")


def test_drawings(spark, small):
    dot = documents.to_dot(small, node_label=F.coalesce(P.string(F.col("props")["label"]), "id"))
    assert dot.startswith('digraph "G" {\n') and '"a" [label="Node \\"A\\" <&>"];' in dot and '"a" -> "b";' in dot
    odd = PropertyGraph.of(spark, ["1 x", "", "y"], [("1 x", "y")], directed=False)
    shown = documents.to_mermaid(odd, max_nodes=2)
    assert 'n_1_x["1 x"]' in shown and 'n_empty[""]' in shown and "1 more nodes omitted" in shown and "-->" not in shown


def test_adjacency_folder(spark, tmp_path):
    def load(*lines):
        for part, text in (("0-head", '{"nodes":{'), ("1-nodes", '"a":{"k":1}\n,"c":{}'), ("2-middle", '},"edges":{'), ("3-edges", "\n".join(lines)), ("4-tail", "}}")):
            (tmp_path / part).mkdir(exist_ok=True)
            (tmp_path / part / "part-0").write_text(text)
        return folders.load_adjacency(spark, f"file://{tmp_path}"), documents.from_adjacency_json(spark, "".join(f.read_text() for f in sorted(tmp_path.glob("*/part-*"))))

    back, whole = load('"z":[', ']', ',"b":[', '"y"', ',["c",{"k":1}]', ",5", ']', ',"a":[', '["x"]', "]")
    assert state(back) == state(whole) and [r["id"] for r in back.nodes.orderBy("ord").collect()] == ["a", "c", "z", "b", "y", "x"] == [r["id"] for r in whole.nodes.orderBy("ord").collect()]
    for wrong in (['["c",{}]'], ['"b":[', "]", '["c",{}]'], ['"b":[', "[5]", "]"]):
        with pytest.raises(ValueError):
            load(*wrong)


def test_tables_and_storage(spark, small, tmp_path):
    nodes, edges = tables.to_tabular(small)
    assert nodes.columns == ["id", "deep", "label", "mix", "n"] and edges.columns == ["source", "target", "ok", "weight"]
    assert nodes.filter("id = 'c'").first()[:] == ("c", "", "", "", "")
    tables.register_views(small, "t_")
    assert spark.sql("SELECT count(*) FROM t_nodes WHERE n = '1'").first()[0] == 1
    tables.save(small, str(tmp_path), "one")
    assert state(tables.load(spark, str(tmp_path), "one")) == state(small)
    with pytest.raises(ValueError):
        tables.load(spark, str(tmp_path), "../x")


def test_turtle(spark):
    g, seen = rdf.load_rdf(spark, TURTLE, "turtle")
    assert (seen.triples, seen.nodes, seen.edges, seen.literals) == (7, 4, 5, 2) and g.multi and g.directed
    assert g.node("http://example.org/Dog")["properties"] == {"label": "Dog"}
    prefix = "PREFIX ex: <http://example.org/> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> "
    found = sparql.query(g, prefix + "SELECT ?x WHERE { ?x rdfs:subClassOf ex:Animal }")
    assert sorted(r["x"] for r in found.rows) == ["http://example.org/Cat", "http://example.org/Dog"] and not found.truncated
    assert sparql.query(g, "SELECT * WHERE { ?s ?p ?o }", max_rows=3).truncated
    assert sparql.ask(g, prefix + "ASK { ex:Dog a rdfs:Class }") and not sparql.ask(g, prefix + "ASK { ex:Unicorn ?p ?o }")
    for wrong in ("SELECT", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "SELECT ?x WHERE { ?x nope:y ?z }", "SELECT ?x WHERE { ?x ?p "):
        with pytest.raises(ValueError):
            sparql.query(g, wrong)


def test_rdf_formats(spark, tmp_path):
    lines = '<urn:a> <urn:p> <urn:b> .\n# note\n_:x <urn:p> "l \\" q"@en .\n<urn:a> <urn:q> _:x <urn:graph> .\n\n<urn:a> <urn:q> "5"^^<urn:int> .\n'
    (tmp_path / "f.nq").write_text(lines)
    g, seen = rdf.load_rdf(spark, str(tmp_path / "f.nq"), is_path=True)
    assert (seen.triples, seen.edges, seen.literals) == (4, 2, 2) and g.has_node("_:x")
    trig = "@prefix e: <urn:e/> . e:g { e:a e:p [ e:q e:b ; e:r (e:c 1 true) ] . } { e:a e:p e:b }"
    assert rdf.load_rdf(spark, trig, "trig")[1].triples == 10
    owl = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="urn:o#" xml:base="http://x.org/">
    <o:Class rdf:about="A" o:note="n"><o:sub rdf:resource="#B"/><o:label>hi</o:label><o:part rdf:parseType="Resource"><o:k rdf:resource="C"/></o:part></o:Class></rdf:RDF>"""
    (tmp_path / "f.owl").write_text(owl)
    g, seen = rdf.load_owl(spark, str(tmp_path / "f.owl"))
    assert (seen.triples, seen.literals) == (6, 2) and g.has_node("http://x.org/A") and g.has_node("http://x.org/C")
    with pytest.raises(ValueError):
        rdf.load_rdf(spark, str(tmp_path / "f.xml"), is_path=True)
    with pytest.raises(PathNotAllowedError):
        rdf.allowed(str(tmp_path / "f.owl"), Settings(allowed_root="/root/repo"))
    with pytest.raises(LimitExceededError):
        rdf.load_rdf(spark, TURTLE, "turtle", settings=Settings(max_triples=2))


def test_rdf_export(spark):
    g = PropertyGraph.of(spark, ["urn:a", "urn:b", "_:c", "urn:alone"], [("urn:a", "urn:b", {"predicate": "urn:p"}), ("urn:a", "_:c", {"type": "urn:t"}), ("urn:a", "urn:b", {})], multi=True)
    text = rdf.to_ntriples(g)
    assert text.splitlines() == ["<urn:a> <urn:p> <urn:b> .", "<urn:a> <urn:t> _:c .", "<urn:a> <urn:weft:relatedTo> <urn:b> ."]
    assert rdf.load_rdf(spark, text, "ntriples")[1].triples == 3
    doc = json.loads(rdf.to_jsonld(g))["@graph"]
    assert doc[0]["@id"] == "urn:a" and doc[0]["urn:p"] == {"@id": "urn:b"} and {"@id": "_:c"} in doc
    with pytest.raises(ValueError):
        rdf.to_ntriples(PropertyGraph.of(spark, ["a b", "c"], [("a b", "c", {})]))


def test_programs_and_traces(spark):
    g = tables.program_to_graph(spark, {"class_name": "P", "children": {"x": {"class_name": "X"}, "q": {"class_name": "Q", "children": {"y": {"class_name": "Y"}}}}})
    assert sorted(r["id"] for r in g.nodes.collect()) == ["__program__", "q", "q.y", "x"]
    t = {"call_name": "pipeline", "trace_id": "t", "latency_ms": 500.0, "children": [{"call_name": "extract", "latency_ms": 200.0, "trace_id": "u"}, {"call_name": "summarize", "latency_ms": 300.0, "trace_id": "v"}]}
    g = tables.trace_to_graph(spark, t)
    assert sorted(r["id"] for r in g.nodes.collect()) == ["pipeline", "pipeline.extract", "pipeline.summarize"]
    assert sorted(P.decode(r["props"]["type"]) for r in g.edges.collect()) == ["contains", "contains", "data_flow"]


ORG = {
    "nodes": [{"id": n, "type": "person", "latency_ms": v} for n, v in (("ceo", 100.0), ("vp_eng", 50.0), ("vp_sales", 40.0), ("lead_a", 30.0), ("lead_b", 35.0), ("dev_1", 20.0), ("dev_2", 25.0))],
    "edges": [{"source": a, "target": b, "type": "manages", "weight": 1.0} for a, b in (("ceo", "vp_eng"), ("ceo", "vp_sales"), ("vp_eng", "lead_a"), ("vp_eng", "lead_b"), ("lead_a", "dev_1"), ("lead_a", "dev_2"))] + [{"source": "lead_b", "target": "dev_2", "type": "collaborates", "weight": 0.5}, {"source": "dev_1", "target": "dev_2", "type": "collaborates", "weight": 0.3}],
}


def test_tools(spark):
    text = tools.create(spark, json.dumps(ORG))["graph_data"]
    seen = tools.stats(spark, text)
    assert (seen["node_count"], seen["edge_count"], seen["is_dag"], seen["connected_components"]) == (7, 8, True, 1) and abs(seen["density"] - 8 / 42) < 1e-12
    assert tools.algorithm(spark, text, "shortest_path", source="ceo", target="dev_1")["path"] == ["ceo", "vp_eng", "lead_a", "dev_1"]
    assert tools.critical_path(spark, text) == {"cost": 225.0, "path": ["ceo", "vp_eng", "lead_a", "dev_1", "dev_2"]}
    assert tools.find_patterns(spark, text, edge_filter={"type": "collaborates"})["edge_count"] == 2
    assert tools.query(spark, text, "neighbors", "lead_b")["neighbors"]
    assert tools.transform_graph(spark, text, "reverse")["n_edges"] == 8
    assert tools.export(spark, text, "mermaid")["text"].startswith("flowchart")
    assert tools.create(spark, "nope")["error"] == "InvalidFormatError"
    assert tools.algorithm(spark, text, "unknown", source="ceo")["error"] == "ValueError"
    assert tools.load_rdf_file(spark, "/x.ttl")["error"] == "ValueError"
    assert tools.sparql(spark, tools.load_rdf_string(spark, TURTLE)["graph_data"], "ASK { ?s ?p ?o }") == {"ask": True}
    assert tools.validate_schema(spark, text, '{"node_types":[{"name":"person","required_properties":["role"]}]}')["violations"].__len__() == 7


def test_stream(spark, tmp_path):
    from weft.streaming import degrees

    rows = [("a", "b", "2024-01-01 00:00:00"), ("a", "c", "2024-01-01 00:30:00"), ("b", "c", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "src string, dst string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, dst string, ts timestamp").parquet(str(tmp_path / "in"))
    run = degrees.running_degrees(stream).writeStream.format("memory").queryName("deg").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert {r["id"]: r["degree"] for r in spark.table("deg").collect()} == {"a": 2, "b": 2, "c": 2}
