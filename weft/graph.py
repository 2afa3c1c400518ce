"""The property graph: two DataFrames and three flags.

``nodes(id string, ord long, props map)`` and ``edges(src string, dst string, eord long, props
map)``; property values are canonical JSON text. ``ord`` and ``eord`` carry insertion order. An
undirected edge is one row, in the orientation it was given.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.errors import NodeNotFoundError
from weft.functions import props as P
from weft.runtime import materialize

NODE_SCHEMA = "id string, ord long, props map<string,string>"
EDGE_SCHEMA = "src string, dst string, eord long, props map<string,string>"


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = True
    multi: bool = False
    name: str | None = None

    # -- making ---------------------------------------------------------------------------------

    @classmethod
    def empty(cls, spark: SparkSession, directed: bool = True, name: str | None = None, multi: bool = False) -> PropertyGraph:
        return cls(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA), directed, multi, name)

    @classmethod
    def of(cls, spark: SparkSession, nodes: list, edges: list, directed: bool = True, multi: bool = False, name: str | None = None) -> PropertyGraph:
        """From Python lists of ids or (id, properties), and (source, target[, properties])."""
        rows = [(n, k, {}) if isinstance(n, str) else (n[0], k, P.encode_map(n[1])) for k, n in enumerate(nodes)]
        links = [(e[0], e[1], k, P.encode_map(e[2] if len(e) > 2 else None)) for k, e in enumerate(edges)]
        return cls(spark.createDataFrame(rows, NODE_SCHEMA), spark.createDataFrame(links, EDGE_SCHEMA), directed, multi, name).checked()

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True, multi: bool = False, name: str | None = None) -> PropertyGraph:
        """From ``edges(src, dst[, eord][, props])`` and optional ``nodes(id[, ord][, props])``.

        Nodes are else the distinct endpoints. Orders that are not given follow the ids, counted
        within range partitions, so no task sees all rows.
        """
        if "props" not in edges.columns:
            edges = edges.withColumn("props", P.no_props())
        if nodes is None:
            nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if "props" not in nodes.columns:
            nodes = nodes.withColumn("props", P.no_props())
        if "ord" not in nodes.columns:
            nodes = numbered(nodes, ["id"], "ord")
        if "eord" not in edges.columns:
            edges = numbered(edges, ["src", "dst"], "eord")
        return cls(nodes.select("id", F.col("ord").cast("long").alias("ord"), "props"), edges.select("src", "dst", F.col("eord").cast("long").alias("eord"), "props"), directed, multi, name)

    def checked(self) -> PropertyGraph:
        """Raise ValueError for duplicate nodes, missing endpoints and, unless multi, parallel edges."""
        twice = self.nodes.groupBy("id").count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"duplicate node: {twice[0]['id']!r}")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        lost = ends.join(self.nodes, "id", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"edge endpoint is no node: {lost[0]['id']!r}")
        if not self.multi:
            again = self.pairs().groupBy("a", "b").count().filter("count > 1").limit(1).collect()
            if again:
                raise ValueError(f"parallel edge in a simple graph: {again[0]['a']!r}, {again[0]['b']!r}")
        return self

    def pairs(self) -> DataFrame:
        """``edges`` with the pair that identifies an edge: ordered when undirected."""
        a, b = ("src", "dst") if self.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        return self.edges.select("*", (F.col(a) if isinstance(a, str) else a).alias("a"), (F.col(b) if isinstance(b, str) else b).alias("b"))

    def with_(self, **changes: Any) -> PropertyGraph:
        return replace(self, **changes)

    def persist(self) -> PropertyGraph:
        """A copy whose tables are written once to the shared scratch folder."""
        return replace(self, nodes=materialize(self.nodes, "nodes"), edges=materialize(self.edges, "edges"))

    # -- views ----------------------------------------------------------------------------------

    def sym(self) -> DataFrame:
        """Edges both ways, self-loops once."""
        back = self.edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "eord", "props")
        return self.edges.unionByName(back)

    def out_edges(self) -> DataFrame:
        """Edges as a walk may use them: both ways when undirected."""
        return self.edges if self.directed else self.sym()

    def node_ids(self) -> DataFrame:
        return self.nodes.select("id", "ord").orderBy("ord").select("id")

    def node(self, node_id: str) -> dict[str, Any] | None:
        row = self.nodes.filter(F.col("id") == node_id).limit(1).collect()
        return {"id": node_id, "properties": P.decode_map(row[0]["props"])} if row else None

    def has_node(self, node_id: str) -> bool:
        return bool(self.nodes.filter(F.col("id") == node_id).limit(1).count())

    def has_edge(self, source: str, target: str) -> bool:
        return bool(self.out_edges().filter((F.col("src") == source) & (F.col("dst") == target)).limit(1).count())

    def require(self, *node_ids: str, error: type[Exception] = NodeNotFoundError) -> None:
        have = {r["id"] for r in self.nodes.filter(F.col("id").isin(*node_ids)).select("id").distinct().collect()} if node_ids else set()
        for n in node_ids:
            if n not in have:
                raise error(n)

    def filter_nodes(self, **wanted: Any) -> DataFrame:
        """Nodes whose properties equal all of ``wanted`` by JSON equality; sorted ids."""
        test = reduce(lambda a, b: a & b, [P.strictly_equals(F.col("props"), k, v) for k, v in wanted.items()], F.lit(True))
        return self.nodes.filter(test).orderBy("id" if wanted else "ord")

    def filter_edges(self, **wanted: Any) -> DataFrame:
        """Edges whose properties equal all of ``wanted`` by value."""
        test = reduce(lambda a, b: a & b, [P.loosely_equals(F.col("props"), k, v) for k, v in wanted.items()], F.lit(True))
        return self.edges.filter(test).orderBy("eord")

    def edges_filtered(self, key: str, value: Any) -> DataFrame:
        return self.edges.filter(P.strictly_equals(F.col("props"), key, value)).orderBy("eord")

    def successors(self, node_id: str) -> DataFrame:
        """``id`` once for every outgoing edge."""
        self.require(node_id)
        return self.out_edges().filter(F.col("src") == node_id).select(F.col("dst").alias("id"))

    def predecessors(self, node_id: str) -> DataFrame:
        self.require(node_id)
        if not self.directed:
            return self.successors(node_id)
        return self.edges.filter(F.col("dst") == node_id).select(F.col("src").alias("id"))

    def neighbors(self, node_id: str) -> DataFrame:
        """Outgoing neighbours once an edge, then incoming ones that are not among them, once."""
        out = self.successors(node_id)
        if not self.directed:
            return out
        return out.unionByName(self.predecessors(node_id).distinct().join(out, "id", "left_anti"))

    # -- numbers --------------------------------------------------------------------------------

    def n_nodes(self) -> int:
        return self.nodes.count()

    def n_edges(self) -> int:
        return self.edges.count()

    def degrees(self) -> DataFrame:
        """``id, ord, in_degree, out_degree, degree``. A self-loop counts two when directed, one
        when undirected; parallel edges count."""
        if self.directed:
            ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
        else:
            ends = self.sym().select(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).alias("e"))
        sums = ends.groupBy("e.id").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        rows = self.nodes.select("id", "ord").join(sums, "id", "left").select("id", "ord", zero(F.col("i")).alias("i"), zero(F.col("o")).alias("o"))
        if self.directed:
            return rows.select("id", "ord", F.col("i").alias("in_degree"), F.col("o").alias("out_degree"), (F.col("i") + F.col("o")).alias("degree"))
        return rows.select("id", "ord", F.col("o").alias("in_degree"), F.col("o").alias("out_degree"), F.col("o").alias("degree"))

    def degree(self, node_id: str) -> int:
        self.require(node_id)
        return self.degrees().filter(F.col("id") == node_id).first()["degree"]

    # -- dense numbers for iteration ---------------------------------------------------------------

    def indexed(self, weight: str | None = None, symmetric: bool | None = None) -> DataFrame:
        """``a, b`` (node orders) and ``w`` for every edge, both ways when undirected (or as asked)."""
        both = (not self.directed) if symmetric is None else symmetric
        edges = self.edges.select("src", "dst", P.edge_weight(F.col("props"), weight).alias("w"))
        number = self.nodes.select("id", "ord")
        rows = edges.join(number.withColumnsRenamed({"id": "src", "ord": "a"}), "src").join(number.withColumnsRenamed({"id": "dst", "ord": "b"}), "dst").select("a", "b", "w")
        if both:
            rows = rows.unionByName(rows.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        return rows

    def named(self, rows: DataFrame, key: str = "a", to: str = "id") -> DataFrame:
        """Replace node orders in column ``key`` by ids in ``to``."""
        return rows.join(self.nodes.select(F.col("ord").alias(key), F.col("id").alias(to)), key).drop(key)


def numbered(df: DataFrame, by: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Add 0, 1, 2, ... in the order of ``by``: range partitions are counted, each row then adds its
    place within its partition to the rows of those before. ``by`` should tell rows apart."""
    spark = df.sparkSession
    placed = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a partition
    return placed.join(F.broadcast(start), "_p").withColumn(name, F.col("base") + F.col("_at") - F.col("first")).drop("_p", "_at", "base", "first")
