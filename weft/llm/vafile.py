"""Exact top-k inner-product search with vector-approximation files.

Components count as ``floor(scale * x)``. Equal vectors are one group first, of which the ``k + 1``
smallest ids can matter. Vectors are then packed into blocks and each component is quantised to one
byte on a grid of the block: the approximation file, which holds no exact vector.

Cells of blocks of queries (a stated set) meet every block of the file: they bound each inner product
from both sides, and a candidate whose upper bound is below the k-th largest lower bound so far is
discarded; that bound goes from block to block of a task. What is left is cut by the k-th largest
lower bound of all tasks. Exact vectors are fetched for these survivors only, in the order of their
bound: the first ``FIRST * k`` of each query, then those whose bound still reaches the k-th exact score;
behind them the result is certain. Bounds are widened by their rounding errors, exact scores are whole
numbers, so the result does not depend on the quantisation or on the size of components.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null
id take no part; only vectors of a query's length are its candidates; rows that share a query's id
are not its candidates; repeated candidate rows each count; ties go to the smaller id; scores that a
long cannot hold saturate at its limits and tie there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import join_lookup
from weft.runtime import materialize, shuffle_partitions, ship

SCALE = 256
QUERY_BLOCK, BLOCK, PART = 4096, 4096, 256
FIRST = 2
#: Grids end here; a component beyond has no bounds and its vector is always read.
EDGE = 1e150
_LONG = 2**63
_FILE = ("ats", "ids", "low", "step", "slack", "cells")


def _usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def scaled(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` as doubles, ended at ``EDGE``."""
    with np.errstate(over="ignore"):
        return np.floor(x * float(scale)).clip(-EDGE, EDGE)


def to_cells(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grid origin, step and slack of each component, and every value's cell: one byte each. A value
    lies between ``low + cell * step - slack`` and ``low + cell * step + step - 1 + slack``."""
    low = v.min(axis=0) if len(v) else np.zeros(v.shape[1])
    high = v.max(axis=0) if len(v) else low
    step = np.maximum(1.0, np.ceil((high - low + 1) / 256))
    cells = np.floor((v - low) / step).clip(0, 255).astype(np.uint8)
    under = low + cells * step
    over = under + (step - 1)
    slack = np.maximum(0.0, np.maximum(under - v, v - over)).max(axis=0, initial=0.0)
    slack[(np.abs(v) >= EDGE).any(axis=0)] = np.inf
    return low, step, slack, cells


def bounds(query: np.ndarray, low: np.ndarray, step: np.ndarray, slack: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores."""
    base = low + cells.astype(np.float64) * step
    under, over = base - slack, base + (step - 1 + slack)
    up, down = np.maximum(query, 0.0), np.minimum(query, 0.0)
    with np.errstate(invalid="ignore"):
        lower, upper = up @ under.T + down @ over.T, up @ over.T + down @ under.T
        error = (len(low) + 8) * 2.0**-51 * (np.abs(query) @ np.maximum(np.abs(under), np.abs(over)).max(axis=0, initial=0.0))
        lower, upper = lower - error[:, None], upper + error[:, None]
    wide = (np.abs(query) >= EDGE).any(axis=1)[:, None]
    limit = float(_LONG)  # where scores saturate
    return np.where(np.isnan(lower) | wide, -limit, lower.clip(-limit, limit)), np.where(np.isnan(upper) | wide, limit, upper.clip(-limit, limit))


def whole_number(x: float, scale: int = SCALE) -> int:
    """``floor(scale * x)``, exactly."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def exact_scores(queries: np.ndarray, vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Inner products of the rows of both, as long; whole-number arithmetic throughout."""
    a, b = scaled(queries, scale), scaled(vectors, scale)
    small = (np.abs(a) * np.abs(b)).sum(axis=1) < 2.0**62
    small &= (np.abs(a) < 2.0**62).all(axis=1) & (np.abs(b) < 2.0**62).all(axis=1)
    out = np.zeros(len(a), np.int64)
    out[small] = np.einsum("ij,ij->i", a[small].astype(np.int64), b[small].astype(np.int64))
    for k in np.flatnonzero(~small):
        total = sum(whole_number(x, scale) * whole_number(y, scale) for x, y in zip(queries[k].tolist(), vectors[k].tolist()))
        out[k] = max(-_LONG, min(_LONG - 1, total))
    return out


class Scan:
    """Query blocks of one cell of the grid against file blocks that come one after another."""

    def __init__(self, k: int):
        self.k, self.blocks = k, []

    def add(self, ats: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        self.blocks.append((ats, ids, values, np.full((len(ids), self.k), -np.inf)))

    def survivors(self, ats: np.ndarray, ids: np.ndarray, grid: tuple):
        """Yield (query, its id, candidate, lower, upper) as arrays."""
        for query_ats, query_ids, values, best in self.blocks:
            if values.shape[1] != len(grid[0]):
                continue
            for at in range(0, len(query_ids), PART):
                part = slice(at, at + PART)
                lower, upper = bounds(values[part], *grid)
                lower[query_ids[part, None] == ids[None, :]] = -np.inf
                cut = max(0, len(ids) - self.k)
                top = np.concatenate([best[part], np.partition(lower, cut, axis=1)[:, cut:]], axis=1)
                best[part] = np.partition(top, top.shape[1] - self.k, axis=1)[:, -self.k :]
                q, c = np.nonzero((upper >= best[part].min(axis=1)[:, None]) & (query_ids[part, None] != ids[None, :]))
                yield query_ats[part][q], query_ids[part][q], ats[c], lower[q, c], upper[q, c]


def _lists(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // len(column) if len(column) else 0)


def blocks(df: DataFrame, size: int, *, exact: bool = False, scale: int = SCALE) -> DataFrame:
    """Blocks of up to ``size`` of the rows ``at, id, x`` with vectors of one length, made where the
    rows lie: an approximation file, or the scaled components (column ``values``)."""
    ship(df.sparkSession)
    names = ("ats", "ids", "values") if exact else _FILE

    def run(batches):
        wait: dict[int, list] = {}

        def pack(dim, parts):
            ats, ids, v = (np.concatenate([p[k] for p in parts]) for k in range(3))
            row = (ats, ids, v) if exact else (ats, ids, *to_cells(v))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in row)], ["dim", *names])

        for batch in batches:
            ats, ids, lists = batch.column("at").to_numpy(), batch.column("id").to_numpy(), batch.column("x")
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                v = scaled(_lists(lists.take(pa.array(own))).reshape(len(own), dim), scale)
                for at in range(0, len(own), size):
                    part = slice(at, at + size)
                    wait.setdefault(dim, []).append((ats[own[part]], ids[own[part]], v[part]))
                    if sum(len(p[0]) for p in wait[dim]) >= size:
                        yield pack(dim, wait.pop(dim))
        for dim, parts in wait.items():
            yield pack(dim, parts)

    return df.select("at", "id", "x").mapInArrow(run, "dim int, " + ", ".join(f"{n} binary" for n in names))


def _survivors(asked: DataFrame, file: DataFrame, turns: int, salts: int, k: int) -> DataFrame:
    """``query, query_id, at, lower, upper``: every block of ``asked`` (column ``turn``) meets every
    block of ``file`` in one of ``turns`` times ``salts`` cells."""
    none = F.lit(None).cast("binary")
    left = asked.select("turn", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "dim", "ats", "ids", "values", *[none.alias(c) for c in _FILE[2:]])
    salt = F.pmod(F.xxhash64("ats", "dim"), F.lit(salts)).cast("int")
    right = file.select(F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), salt.alias("salt"), F.lit(1).alias("kind"), "dim", "ats", "ids", none.alias("values"), *_FILE[2:])
    cells = left.unionByName(right).repartition("turn", "salt").sortWithinPartitions("turn", "salt", "kind")
    names = ["query", "query_id", "at", "lower", "upper"]

    def run(batches):
        here, scan = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["turn"], row["salt"]) != here:
                    here, scan = (row["turn"], row["salt"]), Scan(k)
                longs = [np.frombuffer(row[c], np.int64) for c in ("ats", "ids")]
                shape = (len(longs[0]), row["dim"])
                if row["kind"] == 0:
                    scan.add(*longs, np.frombuffer(row["values"], np.float64).reshape(shape))
                    continue
                grid = [np.frombuffer(row[c], np.float64) for c in ("low", "step", "slack")]
                for found in scan.survivors(*longs, (*grid, np.frombuffer(row["cells"], np.uint8).reshape(shape))):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    return cells.mapInArrow(run, "query long, query_id long, at long, lower double, upper double")


def _read(wanted: DataFrame, queries: DataFrame, vectors: DataFrame, scale: int) -> DataFrame:
    """The rows ``query, query_id, at`` with ``vec_id, copies, score``: exact vectors of these alone."""
    counts = wanted.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    lookup = counts.join(vectors.select("at", F.col("id").alias("vec_id"), "copies", "x"), "at")
    rows = join_lookup(wanted, lookup, "at", "n", wanted.count()).join(queries.select(F.col("at").alias("query"), F.col("x").alias("q")), "query")

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("x").offsets.to_numpy())
            score = np.zeros(len(sizes), np.int64)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                x, q = (_lists(batch.column(c).take(pa.array(own))).reshape(len(own), dim) for c in ("x", "q"))
                score[own] = exact_scores(q, x, scale)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query", "query_id", "vec_id", "copies")), pa.array(score)], ["query", "query_id", "vec_id", "copies", "score"])

    return rows.select("query", "query_id", "vec_id", "copies", "x", "q").mapInArrow(run, "query long, query_id long, vec_id long, copies long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, first: int = FIRST) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries`` its ``k`` best candidates."""
    spark = queries.sparkSession
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).filter(F.col("id").isNotNull() & _usable(F.col("x")))
    number = F.monotonically_increasing_id().alias("at")
    queries = materialize(usable(queries).select(number, "*"), "queries")
    vectors = usable(candidates).groupBy("x", "id").agg(F.count(F.lit(1)).alias("copies"))
    vectors = vectors.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy("id"))).filter(F.col("place") <= k + 1).drop("place")
    vectors = materialize(vectors.select(number, "*"), "vectors")
    turns = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = blocks(queries.repartition(turns), QUERY_BLOCK, exact=True, scale=scale).withColumn("turn", F.spark_partition_id())
    file = materialize(blocks(vectors, BLOCK, scale=scale), "approximations")
    found = materialize(_survivors(materialize(asked, "asked"), file, turns, shuffle_partitions(spark), k), "survivors")
    by = Window.partitionBy("query")
    lowest = found.withColumn("place", F.row_number().over(by.orderBy(F.desc("lower")))).filter(F.col("place") <= k)
    lowest = lowest.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("lower")).alias("least"))
    found = found.join(lowest, "query").filter("least is null or upper >= least")
    found = materialize(found.withColumn("place", F.row_number().over(by.orderBy(F.desc("upper"), "at"))).drop("least", "lower"), "in-order")
    early = materialize(_read(found.filter(F.col("place") <= first * k).select("query", "query_id", "at"), queries, vectors, scale), "first-read")
    kth = early.withColumn("place", F.row_number().over(by.orderBy(F.desc("score")))).filter(F.col("place") == k).select("query", F.col("score").cast("double").alias("kth"))
    late = found.filter(F.col("place") > first * k).join(kth, "query", "left").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth") - F.abs("kth") * 1e-15 - 1))
    every = early.unionByName(_read(materialize(late.select("query", "query_id", "at"), "open"), queries, vectors, scale))
    every = every.select("query", "query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("copy"))
    order = by.orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
