"""RDF in and out.

N-Triples and N-Quads are read line by line by the whole cluster; the nested formats are parsed one
file a task. IRIs and blank nodes become nodes, triples between them edges of a directed multigraph;
literals are counted and left out, and named graphs are not told apart.
"""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import InvalidFormatError, LimitExceededError, PathNotAllowedError
from weft.functions import props as P
from weft.graph import PropertyGraph, numbered
from weft.runtime import materialize, ship
from weft.settings import DEFAULTS, Settings
from weft.sources.rdf_text import PARSERS

EXTENSIONS = {".ttl": "turtle", ".nt": "ntriples", ".nq": "nquads", ".trig": "trig", ".rdf": "rdfxml", ".owl": "rdfxml"}
ALIASES = {"ttl": "turtle", "nt": "ntriples", "n-triples": "ntriples", "nq": "nquads", "n-quads": "nquads", "rdf": "rdfxml", "xml": "rdfxml", "rdf/xml": "rdfxml", "owl": "rdfxml"}
_SUBJECT = r"(<[^<>\"\s]*>|_:\S+)"
_LINE = rf'^\s*{_SUBJECT}\s*(<[^<>"\s]*>)\s*(?:{_SUBJECT}|("(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?))\s*(?:(?:<[^<>"\s]*>|_:\S+)\s*)?\.\s*(?:#.*)?$'
TRIPLES = "seq long, s string, p string, o string, literal boolean"


@dataclass(frozen=True)
class RdfStats:
    triples: int
    nodes: int
    edges: int
    literals: int


def format_of(name: str, given: str | None = None) -> str:
    if given is not None:
        kind = ALIASES.get(given.lower(), given.lower())
        if kind not in (*PARSERS, "ntriples", "nquads"):
            raise InvalidFormatError(f"unknown RDF format {given!r}")
        return kind
    suffix = Path(name).suffix.lower()
    if suffix not in EXTENSIONS:
        raise InvalidFormatError(f"unknown RDF file extension {suffix!r}; name the format")
    return EXTENSIONS[suffix]


_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+):(.*)", re.S)


def _place(path: str, strict: bool) -> tuple[str, str]:
    """Store (empty for the local disk) and normalised path."""
    scheme, rest = found.groups() if (found := _SCHEME.fullmatch(path)) else ("", path)
    if scheme.lower() not in ("", "file"):
        store, _, inner = rest.removeprefix("//").partition("/")
        return f"{scheme.lower()}://{store}", posixpath.normpath("/" + unquote(inner))
    if scheme:
        host, _, inner = rest.removeprefix("//").partition("/") if rest.startswith("//") else ("", "", rest.removeprefix("/"))
        if host not in ("", "localhost"):
            raise PathNotAllowedError(f"{path!r} names another host")
        rest = "/" + unquote(inner)
    return "", str(Path(rest).resolve(strict=strict))


def allowed(path: str, settings: Settings = DEFAULTS) -> str:
    """The resolved path, where it lies within ``settings.allowed_root`` (if there is one). Paths of
    every scheme are checked: one of another store than the root's is refused."""
    if settings.allowed_root is None:
        return path
    store, inner = _place(path, strict=True)
    root_store, root = _place(settings.allowed_root, strict=True)
    if store != root_store or not PurePosixPath(inner).is_relative_to(root):
        raise PathNotAllowedError(f"{path!r} is outside the allowed root")
    return store + inner


def _unescaped(c: Column) -> Column:
    """IRIs seldom hold escapes; those that do are decoded by the JSON reader."""
    return F.when(c.contains("\\u"), F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>")[0]).otherwise(c)


def line_triples(lines: DataFrame) -> DataFrame:
    """Triples of N-Triples or N-Quads ``lines(value)``; a malformed line is an error."""
    part = lambda k: F.regexp_extract("value", _LINE, k)
    rows = lines.filter(~F.col("value").rlike(r"^\s*(?:#.*)?$")).select(F.monotonically_increasing_id().alias("seq"), "value")
    wrong = F.raise_error(F.concat(F.lit("malformed RDF line: "), F.col("value"))).cast("string")
    bare = lambda c: _unescaped(F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c))
    rows = rows.select("seq", F.when(F.col("value").rlike(_LINE), part(1)).otherwise(wrong).alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("l"))
    return rows.select("seq", bare(F.col("s")).alias("s"), bare(F.col("p")).alias("p"), F.when(F.col("l") != "", F.col("l")).otherwise(bare(F.col("o"))).alias("o"), (F.col("l") != "").alias("literal"))


def _parsed(texts: DataFrame, kind: str) -> DataFrame:
    """Triples of whole-file ``texts(value)``; a file is one row."""
    ship(texts.sparkSession)

    def run(frames):
        made = 0
        for frame in frames:
            for text in frame["value"]:
                rows = []
                for s, p, o, literal in PARSERS[kind](text):
                    rows.append((made, s, p, o, literal))
                    made += 1
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=["seq", "s", "p", "o", "literal"])
                        rows = []
                yield pd.DataFrame(rows, columns=["seq", "s", "p", "o", "literal"])

    return texts.select("value").mapInPandas(run, TRIPLES)


def read_triples(spark: SparkSession, source: str, format: str | None = None, *, is_path: bool = False, settings: Settings = DEFAULTS) -> DataFrame:
    """``seq, s, p, o, literal`` from a path or from text."""
    if is_path:
        kind = format_of(source, format)
        source = allowed(source, settings)
        texts = spark.read.text(source, wholetext=kind in PARSERS)
    else:
        if len(source.encode()) > settings.max_bytes:
            raise LimitExceededError(f"the text has more than {settings.max_bytes} bytes")
        kind = format_of("", format or "turtle")
        parts = [source] if kind in PARSERS else source.splitlines()
        texts = spark.createDataFrame([(x,) for x in parts], "value string")
    return _parsed(texts, kind) if kind in PARSERS else line_triples(texts)


def short(iri: Column) -> Column:
    """What follows the last ``#``, else the last ``/``, else all."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).when(iri.contains("/"), F.substring_index(iri, "/", -1)).otherwise(iri)


def load_rdf(spark: SparkSession, source: str, format: str | None = None, *, is_path: bool = False, settings: Settings = DEFAULTS) -> tuple[PropertyGraph, RdfStats]:
    rows = materialize(read_triples(spark, source, format, is_path=is_path, settings=settings), "rdf")
    seen = rows.limit(settings.max_triples + 1).count()
    if seen > settings.max_triples:
        raise LimitExceededError(f"more than {settings.max_triples} triples")
    ends = rows.select(F.explode(F.when(F.col("literal"), F.array(F.struct(F.col("s").alias("id"), (2 * F.col("seq")).alias("at")))).otherwise(F.array(F.struct(F.col("s").alias("id"), (2 * F.col("seq")).alias("at")), F.struct(F.col("o").alias("id"), (2 * F.col("seq") + 1).alias("at"))))).alias("n")).groupBy("n.id").agg(F.min("n.at").alias("at"))
    label = lambda c: P.quote(short(c))
    nodes = numbered(ends, ["at"], "ord").select("id", "ord", F.create_map(F.lit("label"), label(F.col("id"))).alias("props"))
    edges = rows.filter("not literal").select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("seq").alias("eord"), F.create_map(F.lit("predicate"), P.quote(F.col("p")), F.lit("label"), label(F.col("p")), F.lit("type"), label(F.col("p"))).alias("props"))
    g = PropertyGraph(nodes, edges, True, True)
    literals = rows.filter("literal").count()
    return g, RdfStats(seen, ends.count(), seen - literals, literals)


def load_owl(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> tuple[PropertyGraph, RdfStats]:
    return load_rdf(spark, path, "rdfxml", is_path=True, settings=settings)


def _term(c: Column, what: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"invalid {what}: "), c)).cast("string")
    blank = c.startswith("_:") & (F.lit(what) != "predicate IRI")
    return F.when(blank & c.rlike(r"^_:[\w](?:[\w.-]*[\w-])?$"), c).when(~blank & c.rlike(r'^[A-Za-z][A-Za-z0-9+.-]*:[^<>"{}|^`\\\s]*$'), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(bad)


def ntriples_lines(g: PropertyGraph, default_predicate: str = DEFAULTS.default_predicate) -> DataFrame:
    """``eord, value``: a line for each edge; for ``write.text`` select ``value``. The lines are valid
    Turtle too. Nodes without edges and node properties are not part of the format."""
    p = P.predicate(F.col("props"), "rdf", default_predicate)
    return g.edges.select("eord", F.concat(_term(F.col("src"), "subject"), F.lit(" "), _term(p, "predicate IRI"), F.lit(" "), _term(F.col("dst"), "object"), F.lit(" .")).alias("value"))


def to_ntriples(g: PropertyGraph, default_predicate: str = DEFAULTS.default_predicate) -> str:
    try:
        return "".join(r["value"] + "\n" for r in ntriples_lines(g, default_predicate).orderBy("eord").toLocalIterator())
    except Exception as e:
        if "invalid " in str(e):
            raise ValueError(str(e).splitlines()[0]) from e
        raise


to_turtle = to_ntriples


def jsonld_nodes(g: PropertyGraph, default_predicate: str = DEFAULTS.default_predicate) -> DataFrame:
    """``id, rank, value``: the JSON object of each subject, then of nodes that are objects alone."""
    ref = F.concat(F.lit('{"@id":'), P.quote(F.col("dst")), F.lit("}"))
    by_predicate = g.edges.select("src", P.predicate(F.col("props"), "rdf", default_predicate).alias("p"), ref.alias("ref"), "eord").groupBy("src", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("eord", "ref"))), lambda x: x["ref"]).alias("refs"))
    body = F.concat(P.quote(F.col("p")), F.lit(":"), F.when(F.size("refs") == 1, F.col("refs")[0]).otherwise(F.concat(F.lit("["), F.array_join("refs", ","), F.lit("]"))))
    fields = F.transform(F.array_sort(F.collect_list(F.struct("p", body.alias("body")))), lambda x: x["body"])
    subjects = by_predicate.groupBy(F.col("src").alias("id")).agg(fields.alias("fields")).select("id", F.lit(0).cast("long").alias("rank"), F.concat(F.lit('{"@id":'), P.quote(F.col("id")), F.lit(","), F.array_join("fields", ","), F.lit("}")).alias("value"))
    objects = g.nodes.join(g.edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").join(g.edges.select(F.col("src").alias("id")), "id", "left_anti").select("id", (F.col("ord") + 1).alias("rank"), F.concat(F.lit('{"@id":'), P.quote(F.col("id")), F.lit("}")).alias("value"))
    return subjects.unionByName(objects)


def to_jsonld(g: PropertyGraph, default_predicate: str = DEFAULTS.default_predicate) -> str:
    rows = jsonld_nodes(g, default_predicate).orderBy("rank", "id").toLocalIterator()
    return json.dumps({"@graph": [json.loads(r["value"]) for r in rows]}, indent=2, ensure_ascii=False)
