"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least one row in this many, so there are never more hot keys.
HOT_SHARE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(col: Column | str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def join_lookup(big: DataFrame, lookup: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join ``big`` to ``lookup`` (one row a key; ``count`` = rows of ``big`` with that key).

    Keys that hold at least ``1/HOT_SHARE`` of ``total`` rows are joined by broadcast: there are
    at most ``HOT_SHARE`` of them, whatever the data. All other keys go through a shuffle in
    which no key exceeds that share. ``count`` is dropped.
    """
    limit = max(1, -(-total // HOT_SHARE))
    values = [c for c in lookup.columns if c not in (key, count)]
    hot = lookup.filter(F.col(count) >= limit).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    cold = lookup.filter(F.col(count) < limit).drop(count)
    marked = big.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    first = marked.filter(F.col("_hot_key").isNotNull()).select(*big.columns, *[F.col(f"_hot_{c}").alias(c) for c in values])
    rest = marked.filter(F.col("_hot_key").isNull()).select(*big.columns).join(cold, key, "left")
    return first.unionByName(rest)


def join_spread(big: DataFrame, counts: DataFrame, lookup: DataFrame, key: str, count: str, total: int, by: str) -> DataFrame:
    """Inner join of ``big`` to ``lookup`` (one row a key, of any size in bytes) without broadcasting it.

    ``counts`` has the number of rows of ``big`` a key. Each ``1/HOT_SHARE`` of ``total`` that a key
    holds is a part of its own: rows of ``big`` are dealt to parts by the column ``by``, the row of
    ``lookup`` goes to each part. That makes at most ``HOT_SHARE`` copies besides the first of each
    key; only keys and numbers of parts are broadcast, of at most ``HOT_SHARE`` keys.
    """
    limit = max(1, -(-total // HOT_SHARE))
    parts = F.ceil(F.col(count) / limit).cast("int")
    hot = counts.filter(F.col(count) > limit).select(F.col(key).alias("_hot_key"), parts.alias("_parts"))
    dealt = big.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").select(*big.columns, F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0)).alias("_part"))
    copies = counts.join(lookup, key).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return dealt.join(copies, [key, "_part"]).drop("_part")
