"""Rounds of an iterative plan.

Each round writes its state to the shared folder, which cuts lineage, and counts what it has
changed in the same job (an observation on the written frame).  The two latest states are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.store import Scratch


class Rounds:
    def __init__(self, spark: SparkSession, label: str):
        self.scratch, self.n = Scratch(spark, label), 0

    def cut(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """The state as written, and how many of its rows meet each condition."""
        self.n += 1
        seen = Observation()
        watched = df.observe(seen, *[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()]) if counts else df
        table = self.scratch.table(watched, f"r{self.n}")
        if self.n > 2:
            self.scratch.drop(f"r{self.n - 2}")
        return table, seen.get if counts else {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table that stays for all rounds."""
        return self.scratch.table(df, name)


def bucket_loop(state: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame], order: str = "increasing", max_iter: int = 10_000, label: str = "buckets") -> DataFrame:
    """Takes the lowest (or highest) open bucket until none is left.

    ``state`` has a column ``bucket``, null for what is done; ``step(state, active, bucket)``
    returns the next state.  Stale copies can't exist: a row has one bucket at a time.
    """
    rounds = Rounds(state.sparkSession, label)
    state, _ = rounds.cut(state)
    pick = F.min if order == "increasing" else F.max
    for _i in range(max_iter):
        bucket = state.agg(pick("bucket").alias("b")).first()["b"]
        if bucket is None:
            return state
        state, _ = rounds.cut(step(state, state.filter(F.col("bucket") == bucket), bucket))
    raise RuntimeError("buckets stay open")
