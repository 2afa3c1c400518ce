"""Validation of a graph against node and edge types."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import props as P
from weft.graph import PropertyGraph


@dataclass(frozen=True)
class NodeType:
    name: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()


@dataclass(frozen=True)
class EdgeType:
    name: str
    source_type: str | None = None
    target_type: str | None = None
    required: tuple[str, ...] = ()


@dataclass(frozen=True)
class GraphSchema:
    node_types: tuple[NodeType, ...] = field(default=())
    edge_types: tuple[EdgeType, ...] = field(default=())

    def validate(self, g: PropertyGraph) -> DataFrame:
        """``kind, element_id, detail``; edges are ``source->target``. Types that are missing or
        empty are not checked; a required key counts where it is present, even with null."""
        node_type = P.truthy_string(F.col("props")["type"])
        nodes = g.nodes.select("id", "props", node_type.alias("type"), F.col("id").alias("element"))
        out = []
        if self.node_types:
            typed = nodes.filter(F.col("type").isNotNull())
            out += self._checks(typed, "node", {t.name: t.required for t in self.node_types})
        if self.edge_types:
            ends = g.nodes.select("id", P.string(F.col("props")["type"]).alias("end_type"))
            edges = g.edges.select("src", "dst", "props", P.truthy_string(F.col("props")["type"]).alias("type"), F.concat("src", F.lit("->"), "dst").alias("element")).filter(F.col("type").isNotNull())
            out += self._checks(edges, "edge", {t.name: t.required for t in self.edge_types})
            for side, end in (("source", "src"), ("target", "dst")):
                wanted = {t.name: getattr(t, f"{side}_type") for t in self.edge_types if getattr(t, f"{side}_type")}
                if wanted:
                    need = self._lookup(wanted)
                    rows = edges.withColumn("need", need).filter(F.col("need").isNotNull()).join(ends.withColumnRenamed("id", end), end, "left")
                    out.append(rows.filter(~F.col("need").eqNullSafe(F.col("end_type"))).select(F.lit(f"invalid_{side}_type").alias("kind"), F.col("element").alias("element_id"), F.col("need").alias("detail")))
        if not out:
            return nodes.limit(0).select(F.lit("").alias("kind"), F.col("id").alias("element_id"), F.col("id").alias("detail"))
        return reduce(DataFrame.unionByName, out)

    @staticmethod
    def _lookup(values: dict[str, str]) -> Column:
        return reduce(lambda c, kv: c.when(F.col("type") == kv[0], F.lit(kv[1])), values.items(), F)

    @staticmethod
    def _checks(rows: DataFrame, what: str, required: dict[str, tuple[str, ...]]) -> list[DataFrame]:
        row = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), F.col("element").alias("element_id"), detail.alias("detail"))
        out = [row(rows.filter(~F.col("type").isin(*required)), f"unknown_{what}_type", F.col("type"))]
        needs = {k: v for k, v in required.items() if v}
        if needs:
            keys = reduce(lambda c, kv: c.when(F.col("type") == kv[0], F.array(*[F.lit(k) for k in kv[1]])), needs.items(), F)
            missing = rows.withColumn("key", F.explode(keys)).filter(~F.map_contains_key("props", F.col("key")))
            out.append(row(missing, "missing_property", F.col("key")))
        return out
