"""Graphs over the star-schema tables. Node orders come from the keys, so nothing is numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import props as P
from weft.graph import PropertyGraph

#: Where the orders of each kind of node begin.
BASE = {"r": 0, "n": 1_000, "s": 1_000_000_000, "c": 100_000_000_000, "o": 10_000_000_000_000}
KIND = {"r": "region", "n": "nation", "s": "supplier", "c": "customer", "o": "order"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _ord(kind: str, key: str) -> Column:
    return F.col(key).cast("long") + BASE[kind]


def _node(df: DataFrame, kind: str, key: str, **props: Column) -> DataFrame:
    pairs = [F.lit("type"), F.lit(P.encode(KIND[kind]))]
    for k, v in props.items():
        pairs += [F.lit(k), v]
    filled = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return df.select(_id(kind, key).alias("id"), _ord(kind, key).alias("ord"), filled.alias("props"))


def _edge(df: DataFrame, parent: str, parent_key: str, child: str, key: str, name: str) -> DataFrame:
    text = P.encode(f"urn:star:{name}")
    return df.select(_id(parent, parent_key).alias("src"), _id(child, key).alias("dst"), _ord(child, key).alias("eord"), F.create_map(F.lit("predicate"), F.lit(text), F.lit("type"), F.lit(P.encode(name))).alias("props"))


def _double(c: str) -> Column:
    """A double as canonical JSON text."""
    return F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)


def hierarchy(spark: SparkSession, sf_dir: str, orders: bool = False) -> PropertyGraph:
    """region -> nation -> customer (-> order) and nation -> supplier; edges point at the part."""
    t = lambda n: _table(spark, sf_dir, n)
    nation, customer, supplier = t("nation"), t("customer"), t("supplier")
    nodes = (
        _node(t("region"), "r", "r_regionkey", name=P.quote(F.col("r_name")))
        .unionByName(_node(nation, "n", "n_nationkey", name=P.quote(F.col("n_name"))))
        .unionByName(_node(supplier, "s", "s_suppkey", name=P.quote(F.col("s_name")), balance=_double("s_acctbal")))
        .unionByName(_node(customer, "c", "c_custkey", name=P.quote(F.col("c_name")), segment=P.quote(F.col("c_mktsegment")), balance=_double("c_acctbal"), vip=F.when(F.col("c_acctbal") > 5000, F.lit("true"))))
    )
    edges = _edge(nation, "r", "n_regionkey", "n", "n_nationkey", "hasNation").unionByName(_edge(supplier, "n", "s_nationkey", "s", "s_suppkey", "hasSupplier")).unionByName(_edge(customer, "n", "c_nationkey", "c", "c_custkey", "hasCustomer"))
    if orders:
        o = t("orders")
        nodes = nodes.unionByName(_node(o, "o", "o_orderkey", status=P.quote(F.col("o_orderstatus"))))
        edges = edges.unionByName(_edge(o, "c", "o_custkey", "o", "o_orderkey", "placed"))
    return PropertyGraph(nodes, edges, True, False, "hierarchy")


def supply(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """customer -> supplier of what the customer ordered; all customers and suppliers are nodes."""
    t = lambda n: _table(spark, sf_dir, n)
    nodes = _node(t("supplier"), "s", "s_suppkey").unionByName(_node(t("customer"), "c", "c_custkey"))
    pairs = t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey").select("o_custkey", "l_suppkey").distinct()
    edges = pairs.select(_id("c", "o_custkey").alias("src"), _id("s", "l_suppkey").alias("dst"), (F.col("o_custkey").cast("long") * 10_000_000 + F.col("l_suppkey").cast("long")).alias("eord"), P.no_props().alias("props"))
    return PropertyGraph(nodes, edges, True, False, "supply")


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """supplier nation -> customer nation; ``weight`` is the number of line items, ``cost`` 1000 less that, at least 1."""
    t = lambda n: _table(spark, sf_dir, n)
    rows = (
        t("lineitem").select("l_orderkey", "l_suppkey")
        .join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey")), "l_orderkey")
        .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        .groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    )
    props = F.create_map(F.lit("weight"), F.col("n").cast("string"), F.lit("cost"), F.greatest(F.lit(1000) - F.col("n"), F.lit(1)).cast("string"))
    edges = rows.select(_id("n", "s_nationkey").alias("src"), _id("n", "c_nationkey").alias("dst"), (F.col("s_nationkey").cast("long") * 1000 + F.col("c_nationkey").cast("long")).alias("eord"), props.alias("props"))
    return PropertyGraph(_node(t("nation"), "n", "n_nationkey"), edges, True, False, "trade")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: a root for each user, the user's events below it in time order."""
    events = _table(spark, sf_dir, "events")
    root = events.select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.col("user_id").cast("long").alias("seq"), F.lit("user").alias("call_name")).distinct()
    leaf = events.select(F.concat(F.lit("e:"), F.col("event_id").cast("string")).alias("span_id"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("parent_id"), (F.col("event_id").cast("long") + 1_000_000_000).alias("seq"), F.col("event_type").alias("call_name"))
    return root.unionByName(leaf)
