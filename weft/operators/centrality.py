"""Centralities. Scores are rows ``id, ord, score``; callers sort by score descending, then order."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators import small
from weft.plans.fixpoint import written
from weft.runtime import discard, materialize, shuffle_partitions


def ranked(scores: DataFrame, limit: int | None = None) -> DataFrame:
    rows = scores.orderBy(F.desc("score"), "ord")
    return rows if limit is None else rows.limit(limit)


def degree_centrality(g: PropertyGraph, kind: str = "degree") -> DataFrame:
    """Degree over n - 1; ``kind`` is degree, in_degree or out_degree (all degree when undirected)."""
    n = g.n_nodes()
    kind = kind if g.directed else "degree"
    score = F.lit(0.0) if n <= 1 else F.col(kind) / F.lit(float(n - 1))
    return g.degrees().select("id", "ord", score.alias("score"))


def in_degree_centrality(g: PropertyGraph) -> DataFrame:
    return degree_centrality(g, "in_degree")


def out_degree_centrality(g: PropertyGraph) -> DataFrame:
    return degree_centrality(g, "out_degree")


def _kept(edges: DataFrame, key: str) -> DataFrame:
    """Edges that stay hash-partitioned by ``key`` over all rounds, so that a round shuffles node
    rows alone. Lost blocks are read again from their written table."""
    return materialize(edges, "loop-edges").repartition(shuffle_partitions(edges.sparkSession), key).persist(StorageLevel.MEMORY_AND_DISK)


def pagerank(g: PropertyGraph, damping: float = 0.85, iterations: int = 100) -> DataFrame:
    """Exactly ``iterations`` unweighted rounds along stored orientations; dangling mass is spread
    evenly and ranks are brought to a sum of one each round. Parallel edges count.

    A round is one job: the sums of the next round (all mass, dangling mass) are observed as its
    table is written, so the normalisation is a constant of the next plan.
    """
    n = g.n_nodes()
    if n == 0:
        return g.nodes.select("id", "ord", F.lit(0.0).alias("score"))
    pairs, seen = written(g.indexed(symmetric=False).select("a", "b"), "rank-edges", n=F.count(F.lit(1)))
    if small.fits(seen["n"] + n):
        found = small.one_task([pairs, g.nodes.select(F.col("ord").alias("a"))], small.pagerank(damping, iterations), "ord long, score double")
        return g.nodes.select("id", "ord").join(found, "ord").select("id", "ord", "score")
    edges = _kept(pairs, "a")
    ways = edges.groupBy("a").agg(F.count(F.lit(1)).alias("ways"))
    spark = g.nodes.sparkSession
    nodes = materialize(g.nodes.select(F.col("ord").alias("a")).join(ways, "a", "left"), "rank-nodes").repartition(shuffle_partitions(spark), "a").persist(StorageLevel.MEMORY_AND_DISK)
    state = nodes.withColumn("rank", F.lit(1.0 / n))
    sums = {"total": F.sum("rank"), "dangling": F.sum(F.when(F.col("ways").isNull(), F.col("rank")).otherwise(0.0))}
    first = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ways").isNull().cast("long")).alias("d")).first()
    seen = {"total": 1.0, "dangling": first["d"] / n}
    old = None
    for _ in range(iterations):
        scale = 1.0 / seen["total"] if seen["total"] > 0 else 1.0
        base = (1.0 - damping) / n + damping * (seen["dangling"] or 0.0) * scale / n
        share = state.filter(F.col("ways").isNotNull()).select("a", (F.col("rank") * scale / F.col("ways")).alias("share"))
        got = edges.join(share, "a").groupBy("b").agg(F.sum("share").alias("got")).withColumnRenamed("b", "a")
        new = nodes.join(got, "a", "left").select("a", "ways", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        state, seen = written(new, "ranks", **sums)
        if old is not None:
            discard(old)
        old = state
    scale = 1.0 / seen["total"] if iterations and seen["total"] > 0 else 1.0
    out = g.nodes.select("id", "ord").join(state.select(F.col("a").alias("ord"), (F.col("rank") * scale).alias("score")), "ord").select("id", "ord", "score")
    edges.unpersist()
    nodes.unpersist()
    return out


def eigenvector_centrality(g: PropertyGraph, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Power iteration over incoming edges with L2 norm; stops when the change's norm is below
    ``tolerance``. All scores may become zero on a graph without cycles."""
    n = g.n_nodes()
    if n == 0:
        return g.nodes.select("id", "ord", F.lit(0.0).alias("score"))
    pairs, seen = written(g.indexed().select("a", "b"), "eigen-edges", n=F.count(F.lit(1)))
    if small.fits(seen["n"] + n):
        found = small.one_task([pairs, g.nodes.select(F.col("ord").alias("a"))], small.eigenvector(iterations, tolerance), "ord long, score double")
        return g.nodes.select("id", "ord").join(found, "ord").select("id", "ord", "score")
    edges = _kept(pairs, "a")
    state = materialize(g.nodes.select(F.col("ord").alias("a"), F.lit(1.0 / n**0.5).alias("x")), "eigen")
    for _ in range(iterations):
        got = edges.join(state, "a").groupBy("b").agg(F.sum("x").alias("y")).withColumnRenamed("b", "a")
        raw, seen = written(state.join(got, "a", "left").select("a", "x", F.coalesce("y", F.lit(0.0)).alias("y")), "eigen", norm=F.sqrt(F.sum(F.col("y") * F.col("y"))), xy=F.sum(F.col("x") * F.col("y")), xx=F.sum(F.col("x") * F.col("x")))
        norm = seen["norm"] or 0.0
        scale = 1.0 / norm if norm > 0 else 1.0
        state = raw.select("a", (F.col("y") * scale).alias("x"))
        # |y/norm - x|^2 from the observed products
        change = max(0.0, (norm * scale) ** 2 - 2 * scale * (seen["xy"] or 0.0) + (seen["xx"] or 0.0)) ** 0.5
        if change < tolerance and (change == 0.0 or raw.agg(F.sqrt(F.sum((F.col("y") * scale - F.col("x")) ** 2))).first()[0] < tolerance):
            break
    edges.unpersist()
    return g.nodes.select("id", "ord").join(state.select(F.col("a").alias("ord"), F.col("x").alias("score")), "ord").select("id", "ord", "score")


def walks(g: PropertyGraph, sources: DataFrame | None = None, keep_counts: bool = True) -> list[DataFrame]:
    """Shortest-path levels from every source at once: a table ``s, a, n`` for each depth (``n``
    counts the shortest paths; parallel edges count)."""
    edges = _kept(g.indexed().select("a", "b").filter("a <> b"), "a")
    start = g.nodes.select(F.col("ord").alias("s")) if sources is None else sources
    levels = [materialize(start.select("s", F.col("s").alias("a"), F.lit(1.0).alias("n")), "level")]
    seen = levels[0].select("s", "a")
    while True:
        step = levels[-1].join(edges, "a").groupBy("s", F.col("b").alias("a")).agg(F.sum("n").alias("n")).join(seen, ["s", "a"], "left_anti")
        new, count = written(step, "level", n=F.count(F.lit(1)))
        if not count["n"]:
            edges.unpersist()
            return levels
        levels.append(new)
        seen = seen.unionByName(new.select("s", "a"))
        if len(levels) % 16 == 0:
            seen = materialize(seen, "seen")


def betweenness_centrality(g: PropertyGraph, normalized: bool = True) -> DataFrame:
    """Brandes' accumulation over all sources at once, one join a level in each direction; endpoints
    do not count. The state is a row for every reachable pair, spread over the cluster."""
    n = g.n_nodes()
    if n <= 2:
        return g.nodes.select("id", "ord", F.lit(0.0).alias("score"))
    levels = walks(g)
    back = _kept(g.indexed().select("a", "b").filter("a <> b"), "b")
    total = None
    above = levels[-1].withColumn("d", F.lit(0.0)) if len(levels) > 1 else None
    for depth in range(len(levels) - 2, -1, -1):
        send = above.select("s", F.col("a").alias("b"), ((1 + F.col("d")) / F.col("n")).alias("x"))
        got = send.join(back, "b").join(levels[depth].select("s", "a"), ["s", "a"], "left_semi").groupBy("s", "a").agg(F.sum("x").alias("x"))
        here = levels[depth].join(got, ["s", "a"], "left").select("s", "a", "n", (F.col("n") * F.coalesce("x", F.lit(0.0))).alias("d"))
        above = materialize(here, "delta")
        if depth:
            part = above.filter("d > 0").groupBy("a").agg(F.sum("d").alias("d"))
            total = part if total is None else total.unionByName(part)
    back.unpersist()
    scale = 1.0 if g.directed else 0.5
    if normalized:
        scale /= (n - 1) * (n - 2) * (1.0 if g.directed else 0.5)
    rows = g.nodes.select("id", "ord")
    if total is None:
        return rows.withColumn("score", F.lit(0.0))
    sums = total.groupBy(F.col("a").alias("ord")).agg((F.sum("d") * scale).alias("score"))
    return rows.join(sums, "ord", "left").select("id", "ord", F.coalesce("score", F.lit(0.0)).alias("score"))


def closeness_centrality(g: PropertyGraph) -> DataFrame:
    """Nodes reached over the sum of their distances, along outgoing edges."""
    far: DataFrame | None = None
    for depth, level in enumerate(walks(g)):
        if depth:
            part = level.groupBy("s").agg(F.count(F.lit(1)).alias("k"), (F.count(F.lit(1)) * depth).alias("d"))
            far = part if far is None else far.unionByName(part)
    rows = g.nodes.select("id", "ord")
    if far is None:
        return rows.withColumn("score", F.lit(0.0))
    score: Column = F.sum("k") / F.sum("d").cast("double")
    return rows.join(far.groupBy(F.col("s").alias("ord")).agg(score.alias("score")), "ord", "left").select("id", "ord", F.coalesce("score", F.lit(0.0)).alias("score"))
