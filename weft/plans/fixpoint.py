"""Driver of iterative plans: one plan a round, cut by a written table, stopped by one number.

The stopping metric is observed while the round is written, so a round costs one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation

from weft.runtime import discard, scratch_path


def written(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df``; the table and what was observed on the way."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if metrics:
        seen = Observation(label)
        df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
        values = seen.get
    else:
        df.write.parquet(path)
        values = {}
    return spark.read.schema(df.schema).parquet(path), values


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], more: Callable[[dict], bool], metrics: dict[str, Column], max_rounds: int, label: str = "round") -> DataFrame:
    """Apply ``step`` until ``more`` says no or ``max_rounds`` is reached; the last state."""
    for turn in range(max_rounds):
        after, seen = written(step(state, turn), label, **metrics)
        if turn:
            discard(state)
        state = after
        if not more(seen):
            break
    return state
