"""BFS traces, level features, and K-means by L1 distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.exprs import l1, uniform
from graphloom.graph import PropertyGraph
from graphloom.operators.traverse import bfs
from graphloom.plans.rounds import Rounds


def starters(g: PropertyGraph, rounds: int, seed: int = 42) -> list[int]:
    """``rounds`` vertices with out-edges, in hash order."""
    order = uniform("id", F.lit(seed))
    return [r["id"] for r in g.degrees().filter("out_deg >= 1").orderBy(order, "id").limit(rounds).collect()]


def bfs_trace(g: PropertyGraph, sources: list[int]) -> DataFrame:
    """sample, level, id: the frontier before each step, the source's level included."""
    store = Rounds(g.edges.sparkSession, "trace")
    out = None
    for i, s in enumerate(sources):
        one = store.keep(bfs(g, s).filter("level is not null").select(F.lit(i).alias("sample"), "level", "id"), f"s{i}")
        out = one if out is None else out.unionByName(one)
    return out


def embed(trace: DataFrame, vertices: DataFrame, samples: int) -> DataFrame:
    """id, feat: level in each sample, 0 for the source and for what isn't reached."""
    return attributes(trace, vertices, samples).withColumn("feat", F.transform("feat", lambda x: F.coalesce(x, F.lit(0))))


def attributes(trace: DataFrame, vertices: DataFrame, samples: int) -> DataFrame:
    """id, feat: level in each sample, null for what isn't reached."""
    cols = [F.max(F.when(F.col("sample") == i, F.col("level"))).alias(f"s{i}") for i in range(samples)]
    wide = vertices.select("id").join(trace, "id", "left").groupBy("id").agg(*cols)
    return wide.select("id", F.array(*[f"s{i}" for i in range(samples)]).alias("feat"))


def duplicates(trace: DataFrame) -> DataFrame:
    """sample, id of vertices that a trace visits twice; none in a right trace."""
    return trace.groupBy("sample", "id").count().filter("count > 1").select("sample", "id")


def block_count(trace: DataFrame) -> DataFrame:
    """sample, level, blocks: runs of neighbouring ids in each frontier."""
    from pyspark.sql import Window

    w = Window.partitionBy("sample", "level").orderBy("id")
    first = (F.col("id") - F.lag("id").over(w) != 1) | F.lag("id").over(w).isNull()
    return trace.withColumn("first", first.cast("int")).groupBy("sample", "level").agg(F.sum("first").alias("blocks"))


def assign(features: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """id, feat, cluster, dist: nearest centroid by L1, the lowest index of equals.

    The few centroids are literals of the plan, so rows stay where they are.
    """
    cells = [F.struct(l1(F.col("feat"), F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]
    best = F.array_min(F.array(*cells))
    return features.withColumn("_b", best).select("id", "feat", F.col("_b.i").alias("cluster"), F.col("_b.d").alias("dist"))


def recentre(assigned: DataFrame, dim: int) -> DataFrame:
    """cluster, centre, n: means rounded half away from zero."""
    means = [F.round(F.avg(F.col("feat")[i])).alias(f"c{i}") for i in range(dim)]
    return assigned.groupBy("cluster").agg(*means, F.count("*").alias("n")).select("cluster", F.array(*[F.col(f"c{i}") for i in range(dim)]).alias("centre"), "n")


def seeds(features: DataFrame, k: int, seed: int = 42) -> list[list[float]]:
    """K-means++ by squared L1 distance: each pick is the smallest of exponential keys, one job a pick,
    then chained so that each centroid is followed by its nearest one."""
    first = features.orderBy(uniform("id", F.lit(seed)), "id").select("feat").first()
    if first is None:
        return []
    picked = [[float(x) for x in first["feat"]]]
    for i in range(1, k):
        u = uniform("id", F.lit(seed), F.lit(i))
        d = F.col("dist")
        row = assign(features, picked).filter("dist > 0").agg(F.min_by("feat", F.struct((-F.log(u) / (d * d)).alias("x"), "id")).alias("f")).first()["f"]
        if row is None:
            break  # fewer different vectors than clusters
        picked.append([float(x) for x in row])
    return chain(picked)


def chain(points: list[list[float]]) -> list[list[float]]:
    out = [np.array(p) for p in points]
    for i in range(len(out) - 1):
        j = min(range(i + 1, len(out)), key=lambda j: (np.abs(out[i] - out[j]).sum(), j))
        out[i + 1], out[j] = out[j], out[i + 1]
    return [p.tolist() for p in out]


def kmeans_l1(features: DataFrame, k: int = 16, seed: int = 42, max_iter: int = 100, rate: float = 0.1, start: list[list[float]] | None = None) -> DataFrame:
    """id, cluster. Stops when fewer than ``rate`` x k centroids move; an empty cluster keeps its centroid."""
    features = Rounds(features.sparkSession, "kmeans").keep(features.select("id", "feat"), "features")
    centroids = start or seeds(features, k, seed)
    if not centroids:
        return features.select("id", F.lit(0).alias("cluster"))
    dim = len(centroids[0])
    for _ in range(max_iter):
        used = centroids
        moved, centroids = 0, list(centroids)
        for row in recentre(assign(features, used), dim).collect():  # k rows
            if list(row["centre"]) != list(used[row["cluster"]]):
                moved += 1
            centroids[row["cluster"]] = list(row["centre"])
        if moved < rate * k:
            break
    return assign(features, used).select("id", "cluster")


def elbow(features: DataFrame, ks: list[int] | None = None, seed: int = 42) -> DataFrame:
    """k, distortion: mean Euclidean distance to the nearest centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ks = ks or sorted({round(2 ** (2 + i * 4 / 9)) for i in range(10)})
    data = Rounds(features.sparkSession, "elbow").keep(features.select("id", "feat"), "features")
    vectors = data.select("feat", array_to_vector(F.col("feat").cast("array<double>")).alias("features")).persist()
    rows = []
    for k in ks:
        centres = [[float(x) for x in c] for c in KMeans(k=k, seed=seed, maxIter=20).fit(vectors).clusterCenters()]
        near = F.array_min(F.array(*[F.sqrt(F.aggregate(F.zip_with(F.col("feat").cast("array<double>"), F.array(*[F.lit(x) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for c in centres]))
        rows.append((k, data.select(near.alias("d")).agg(F.avg("d").alias("m")).first()["m"]))
    vectors.unpersist()
    return features.sparkSession.createDataFrame(rows, "k int, distortion double")
