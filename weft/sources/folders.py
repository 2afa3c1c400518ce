"""Graph documents of any size: folders of text files that the cluster writes and reads.

The files of a folder, put together in the order of their paths, are the document. Its head, what
stands between nodes and edges, and its tail are a file each; nodes and edges are lines, an element a
line (XML elements with all that they hold, JSON ones with the comma before them). So any lines of a
part make a small document with the head and the tail, and a worker reads each batch of them by the
reader of texts. Nothing but heads, tails and a row for each split of a file reaches the driver.

In adjacency JSON a line opens the list of a source, an entry is a line, and a line closes the list:
the targets of a source need not fit one row. Lines before the first open list of a split belong to
the last one of the splits before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.errors import InvalidFormatError
from weft.functions import props as P
from weft.graph import PropertyGraph
from weft.runtime import materialize, ship
from weft.sources import documents
from weft.sources.documents import Parsed

_PLACE = "_file string, _start long"
_ROWS = pa.schema([("a", pa.string()), ("b", pa.string()), ("props", pa.map_(pa.string(), pa.string())), ("wrong", pa.string()), ("_file", pa.string()), ("_start", pa.int64())])


# -- writing -----------------------------------------------------------------------------------------


def _ordered(g: PropertyGraph) -> PropertyGraph:
    """Sorted before the text is made: rows are shuffled while they are small, and any input is spread."""
    return g.with_(nodes=g.nodes.orderBy("ord"), edges=g.edges.orderBy("eord"))


def _save(spark: SparkSession, path: str, head: str, nodes: DataFrame, middle: str, edges: DataFrame, tail: str) -> None:
    for part, text in (("0-head", head), ("2-middle", middle), ("4-tail", tail)):
        spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(f"{path}/{part}", lineSep="\n")
    for part, rows in (("1-nodes", nodes), ("3-edges", edges)):
        rows.select("value").write.text(f"{path}/{part}", lineSep="\n")


def _listed(rows: DataFrame) -> DataFrame:
    """``rows`` with a comma before all values but the first."""
    first = rows.agg(F.min("k")).first()[0]
    return rows.select("k", F.when(F.col("k") > first, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))


def _flat(rows: DataFrame) -> DataFrame:
    """XML elements on one line: line ends within values are references."""
    return rows.select("k", F.replace("value", F.lit("\n"), F.lit("")).alias("value"))


def save_json(g: PropertyGraph, path: str) -> None:
    head, nodes, middle, edges, tail = documents.json_lines(_ordered(g))
    _save(g.nodes.sparkSession, path, head, _listed(nodes), middle, _listed(edges), tail)


def save_graphml(g: PropertyGraph, path: str) -> None:
    head, nodes, edges, tail = documents.graphml_lines(_ordered(g))
    _save(g.nodes.sparkSession, path, head, _flat(nodes), "", _flat(edges), tail)


def save_gexf(g: PropertyGraph, path: str) -> None:
    head, nodes, edges, middle, tail = documents.gexf_lines(_ordered(g))
    _save(g.nodes.sparkSession, path, head, _flat(nodes), middle, _flat(edges), tail)


def save_adjacency(g: PropertyGraph, path: str) -> None:
    ends = g.edges.groupBy("src").agg(F.min("eord").alias("lo"), F.max("eord").alias("hi"))
    first = ends.agg(F.min("lo")).first()[0]
    opens = F.concat(F.when(F.col("lo") > F.lit(first), ",").otherwise(""), P.quote(F.col("src")), F.lit(":[\n"))
    rows = g.edges.join(ends, "src").orderBy("lo", "eord")
    value = F.concat(F.when(F.col("eord") == F.col("lo"), opens).otherwise(","), documents.adjacency_pair(), F.when(F.col("eord") == F.col("hi"), "\n]").otherwise(""))
    _save(g.nodes.sparkSession, path, f'{{"directed":{json.dumps(g.directed)},"nodes":{{', _listed(documents.adjacency_nodes(_ordered(g))), '},"edges":{', rows.select(value.alias("value")), "}}")


# -- reading -----------------------------------------------------------------------------------------


def _text(spark: SparkSession, path: str) -> str:
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def _record(rows: list[tuple], file: list, start: list) -> pa.RecordBatch:
    a, b, props, wrong = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((a, b, props, wrong, file, start), _ROWS.types)], schema=_ROWS)


def _props(value: dict) -> list[tuple[str, str]]:
    return list(P.encode_map(value).items())


def _elements(parse: Callable[[str], Parsed], head: str, tail: str, part: str) -> Callable[[Iterator], Iterator]:
    """Reads batches of lines, each as a document between ``head`` and ``tail``."""

    def rows_of(lines: list[str]) -> list[tuple]:
        parsed = parse(head + "\n".join([lines[0].removeprefix(","), *lines[1:]]) + tail)
        found, other = (parsed.nodes, parsed.edges) if part == "nodes" else (parsed.edges, parsed.nodes)
        if other or len(found) != len(lines):
            raise InvalidFormatError(f"the lines of {part} must be one element each")
        return [(e[0], e[1] if part == "edges" else None, _props(e[-1]), None) for e in found]

    def run(batches):
        for batch in batches:
            lines, file, start = (c.to_pylist() for c in batch.columns)
            if not lines:
                continue
            try:
                out = _record(rows_of(lines), file, start)
            except (ValueError, TypeError, AttributeError, LookupError) as e:
                out = _record([(None, None, None, str(e))], file[:1], start[:1])
            yield out

    return run


def _entries(batches: Iterator) -> Iterator:
    """A row for each line that opens a list (``b`` is null) and for each entry; ``a``, the source, is
    null for entries before the first open list of a split."""
    split, source, closed = None, None, False
    for batch in batches:
        rows, file, start = [], [], []
        for line, *place in zip(*(c.to_pylist() for c in batch.columns)):
            if place != split:
                split, source, closed = place, None, False
            line = line.strip().removeprefix(",")
            try:
                if line == "]":
                    closed = True
                    continue
                if line.endswith("["):
                    ((source, _),) = json.loads("{" + line + "]}").items()
                    closed, row = False, (source, None, None, None)
                elif closed:
                    raise InvalidFormatError("an entry outside the list of a source")
                else:
                    to = documents.link(json.loads(line))
                    if to is None:
                        continue
                    if not isinstance(to[0], str):
                        raise InvalidFormatError("a target must be a string")
                    row = (source, to[0], _props(to[1]), None)
            except (ValueError, TypeError) as e:
                row = (None, None, None, str(e))
            rows.append(row)
            file.append(place[0])
            start.append(place[1])
        if rows:
            yield _record(rows, file, start)


def _read(spark: SparkSession, path: str, run: Callable[[Iterator], Iterator]) -> DataFrame:
    """The rows that ``run`` finds in the lines of a part, stored; with each its place ``at`` in the part
    and the last list opened before its split, ``open``."""
    ship(spark)
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).filter("trim(value) <> ''")
    found = lines.mapInArrow(run, f"a string, b string, props {P.MAP}, wrong string, {_PLACE}")
    rows = materialize(found.withColumn("_at", F.monotonically_increasing_id()), "lines")
    wrong = rows.filter("wrong is not null").select("wrong").limit(1).collect()
    if wrong:
        raise InvalidFormatError(f"invalid lines: {wrong[0]['wrong']}")
    sizes = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"), F.max_by("a", F.when(F.col("b").isNull(), F.col("_at"))).alias("open"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = sizes.select("_file", "_start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.last("open", ignorenulls=True).over(before).alias("open"))
    return rows.join(F.broadcast(splits), ["_file", "_start"]).withColumn("at", F.col("base") + F.col("_at") - F.col("first"))


def _load(spark: SparkSession, path: str, parse: Callable[[str], Parsed]) -> PropertyGraph:
    head, middle, tail = (_text(spark, f"{path}/{part}") for part in ("0-head", "2-middle", "4-tail"))
    flags = parse(head + middle + tail)
    nodes = _read(spark, f"{path}/1-nodes", _elements(parse, head, middle + tail, "nodes"))
    edges = _read(spark, f"{path}/3-edges", _elements(parse, head + middle, tail, "edges"))
    nodes, edges = nodes.select(F.col("a").alias("id"), F.col("at").alias("ord"), "props"), edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("at").alias("eord"), "props")
    return PropertyGraph(nodes, edges, flags.directed, flags.multi, flags.name).checked()


def load_json(spark: SparkSession, path: str) -> PropertyGraph:
    return _load(spark, path, documents.parse_json)


def load_graphml(spark: SparkSession, path: str) -> PropertyGraph:
    return _load(spark, path, documents.parse_graphml)


def load_gexf(spark: SparkSession, path: str) -> PropertyGraph:
    return _load(spark, path, documents.parse_gexf)


def load_adjacency(spark: SparkSession, path: str) -> PropertyGraph:
    """Endpoints need no entry among the nodes; they follow those that have one, as they are named."""
    head, middle, tail = (_text(spark, f"{path}/{part}") for part in ("0-head", "2-middle", "4-tail"))
    flags = documents.parse_adjacency(head + middle + tail)
    nodes = _read(spark, f"{path}/1-nodes", _elements(documents.parse_adjacency, head, middle + tail, "nodes"))
    rows = _read(spark, f"{path}/3-edges", _entries)
    edges = rows.filter("b is not null").select(F.coalesce("a", "open").alias("src"), F.col("b").alias("dst"), F.col("at").alias("eord"), "props")
    if edges.filter("src is null").limit(1).count():
        raise InvalidFormatError("an entry outside the list of a source")
    declared = nodes.select(F.col("a").alias("id"), F.col("at").alias("ord"), "props")
    named = rows.groupBy(F.coalesce("b", "a").alias("id")).agg(F.min("at").alias("ord")).join(declared, "id", "left_anti")
    more = materialize(named.select("id", (F.col("ord") + declared.count()).alias("ord"), P.no_props().alias("props")), "named")
    return PropertyGraph(declared.unionByName(more), edges, flags.directed, flags.multi, flags.name).checked()
