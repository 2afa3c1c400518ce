"""Degrees over a stream of edges ``src, dst, ts``: late edges count until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_ends(edges: DataFrame) -> DataFrame:
    end = lambda c, i, o: F.struct(F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    return edges.select("ts", F.explode(F.array(end("src", 0, 1), end("dst", 1, 0))).alias("e")).select("ts", "e.*")


def running_degrees(edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree, degree`` so far; for update or complete mode."""
    sums = edge_ends(edges).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return sums.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def windowed_degrees(edges: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Degrees within each event-time window; append mode emits a window once it is closed."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return edge_ends(edges.withWatermark("ts", late)).groupBy(span.alias("span"), "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
