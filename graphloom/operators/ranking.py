"""PageRank in three forms, and collaborative filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.plans.rounds import Rounds


def _shares(g: PropertyGraph) -> DataFrame:
    """src, dst, deg: edges with their source's out-degree, hashed by source once."""
    deg = g.edges.groupBy("src").agg(F.count("*").alias("deg"))
    return g.edges.select("src", "dst").join(deg, "src").repartition("src").persist()


def pagerank(g: PropertyGraph, max_iter: int = 10, damping: float = 0.85, eps: float = 1e-7) -> DataFrame:
    """id, rank. The mass of vertices without out-edges is lost."""
    rounds, arcs, n = Rounds(g.edges.sparkSession, "pagerank"), _shares(g), g.vertices.count()
    state, _ = rounds.cut(g.vertices.select("id", F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(max_iter):
        sums = arcs.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("s"))
        new = state.join(sums, "id", "left").select("id", (F.lit(damping) * F.coalesce("s", F.lit(0.0)) + F.lit((1 - damping) / n)).alias("rank"), F.col("rank").alias("old"))
        state, _ = rounds.cut(new)
        if state.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).first()["d"] < eps:
            break
        state = state.select("id", "rank")
    arcs.unpersist()
    return state.select("id", "rank")


def pagerank_delta(g: PropertyGraph, max_iter: int = 20, damping: float = 0.85, eps: float = 1e-7, eps2: float = 0.01) -> DataFrame:
    """id, rank: only changes above ``eps2`` of a rank are added and travel on."""
    rounds, arcs, n = Rounds(g.edges.sparkSession, "delta-rank"), _shares(g), g.vertices.count()
    state, _ = rounds.cut(g.vertices.select("id", F.lit(0.0).alias("rank"), F.lit(1.0 / max(n, 1)).alias("delta"), F.lit(True).alias("active")))
    for i in range(1, max_iter + 1):
        front = state.filter("active").select(F.col("id").alias("src"), "delta")
        sums = arcs.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("delta") / F.col("deg")).alias("s"))
        got = state.select("id", "rank").join(sums, "id", "left").withColumn("d", damping * F.coalesce("s", F.lit(0.0)) + (F.lit((1 - damping) / n) if i == 1 else 0.0))
        if i == 1:
            new = got.select("id", (F.col("rank") + F.col("d")).alias("rank"), (F.col("d") - 1.0 / n).alias("delta"))
            new = new.withColumn("active", F.abs("delta") > eps2 * F.col("rank"))
        else:
            big = F.abs("d") > eps2 * F.col("rank")
            new = got.select("id", F.when(big, F.col("rank") + F.col("d")).otherwise(F.col("rank")).alias("rank"), F.col("d").alias("delta"), big.alias("active"))
        state, seen = rounds.cut(new, active=F.col("active"))
        if not seen["active"] or state.agg(F.sum(F.abs("delta")).alias("s")).first()["s"] < eps:
            break
    arcs.unpersist()
    return state.select("id", "rank")


def pagerank_unnormalised(g: PropertyGraph, iters: int = 10, teleport: float = 0.15) -> DataFrame:
    """id, rank: starts at 1, no division by n, a fixed number of dense rounds."""
    rounds, arcs = Rounds(g.edges.sparkSession, "raw-rank"), _shares(g)
    state, _ = rounds.cut(g.vertices.select("id", F.lit(1.0).alias("rank")))
    for _ in range(iters):
        sums = arcs.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("s"))
        state, _ = rounds.cut(state.join(sums, "id", "left").select("id", (F.lit(teleport) + (1 - teleport) * F.coalesce("s", F.lit(0.0))).alias("rank")))
    arcs.unpersist()
    return state


def cf(g: PropertyGraph, k: int = 20, iters: int = 5, step: float = 3.5e-7, lam: float = 0.001, init: float = 0.5) -> DataFrame:
    """id, latent: gradient steps towards the edge weights, x += step (sum err x_src - lam x)."""
    rounds = Rounds(g.edges.sparkSession, "cf")
    arcs = g.edges.select("src", "dst", F.col("w").cast("double").alias("w")).repartition("src").persist()
    state, _ = rounds.cut(g.vertices.select("id", F.array_repeat(F.lit(init), k).alias("latent")))
    for _ in range(iters):
        both = arcs.join(state.select(F.col("id").alias("src"), F.col("latent").alias("xs")), "src").join(state.select(F.col("id").alias("dst"), F.col("latent").alias("xd")), "dst")
        dot = F.aggregate(F.zip_with("xs", "xd", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        both = both.withColumn("err", F.col("w") - dot)
        sums = both.groupBy(F.col("dst").alias("id")).agg(F.array(*[F.sum(F.col("err") * F.col("xs")[i]) for i in range(k)]).alias("grad"))
        new = state.join(sums, "id", "left")
        grad = F.coalesce("grad", F.array_repeat(F.lit(0.0), k))
        state, _ = rounds.cut(new.select("id", F.zip_with("latent", grad, lambda x, d: x + step * (d - lam * x)).alias("latent")))
    arcs.unpersist()
    return state
