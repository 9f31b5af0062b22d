"""Traversals: BFS, components, shortest paths, and the multi-source BFS behind radii and eccentricities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.plans.rounds import Rounds


def bfs(g: PropertyGraph, source: int) -> DataFrame:
    """id, level, parent of every vertex; null where unreached. The parent is the smallest id a level up."""
    spark = g.edges.sparkSession
    rounds, arcs = Rounds(spark, "bfs"), g.arcs()
    start = spark.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0).alias("level"), F.lit(source).cast("long").alias("parent"))
    seen, _ = rounds.cut(start)
    level = 0
    while True:
        level += 1
        front = seen.filter(F.col("level") == level - 1).select(F.col("id").alias("src"))
        found = arcs.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        found = found.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level"), "parent")
        seen, new = rounds.cut(seen.unionByName(found), found=F.col("level") == level)
        if not new["found"]:
            break
    arcs.unpersist()
    return g.vertices.join(seen, "id", "left").select("id", "level", "parent")


def bfs_bitvector(g: PropertyGraph, source: int) -> DataFrame:
    """BFS under its other name: a bitmap of visited vertices is a physical choice that Spark doesn't need."""
    return bfs(g, source)


def _min_labels(g: PropertyGraph, shortcut: bool, label: str) -> DataFrame:
    rounds, arcs = Rounds(g.edges.sparkSession, label), g.arcs()
    state, _ = rounds.cut(g.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("moved")))
    while True:
        front = state.filter("moved").select(F.col("id").alias("src"), F.col("label").alias("offer"))
        offers = arcs.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min("offer").alias("offer"))
        new = state.join(offers, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        if shortcut:  # the label's label, as of the round before
            jump = state.select(F.col("id").alias("label"), F.col("label").alias("far"))
            new = new.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        state, seen = rounds.cut(new.select("id", "label", (F.col("label") < F.col("old")).alias("moved")), moved=F.col("moved"))
        if not seen["moved"]:
            arcs.unpersist()
            return state.select("id", "label")


def components(g: PropertyGraph, shortcut: bool = False) -> DataFrame:
    """id, label: the smallest id that reaches the vertex over out-edges.

    ``shortcut`` also follows the label's own label each round; it is for symmetric graphs.
    """
    return _min_labels(g, shortcut, "components")


def bfs_cc(g: PropertyGraph) -> DataFrame:
    """Reach in the order of ids: the first vertex that reaches another is the smallest one."""
    return _min_labels(g, False, "bfscc")


def sssp(g: PropertyGraph, source: int, weight: str | None = None) -> DataFrame:
    """id, dist: null where unreached; -infinity everywhere reachable is reported as null with a negative cycle error."""
    spark = g.edges.sparkSession
    rounds = Rounds(spark, "sssp")
    n = g.vertices.count()
    arcs = g.edges.select("src", "dst", (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).repartition("src").persist()
    state, _ = rounds.cut(spark.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0).cast("long").alias("dist"), F.lit(True).alias("moved")))
    for _ in range(n):
        front = state.filter("moved").select(F.col("id").alias("src"), "dist")
        offers = arcs.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        new = state.join(offers, "id", "full").select(
            "id", F.least("dist", "offer").alias("dist"), (F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))).alias("moved")
        )
        state, seen = rounds.cut(new, moved=F.col("moved"))
        if not seen["moved"]:
            arcs.unpersist()
            return g.vertices.join(state, "id", "left").select("id", "dist")
    arcs.unpersist()
    raise ValueError("negative cycle")


def delta_stepping(g: PropertyGraph, source: int, delta: int = 1, weight: str | None = None) -> DataFrame:
    """id, dist by buckets of width ``delta``: only the lowest open bucket relaxes."""
    spark = g.edges.sparkSession
    rounds = Rounds(spark, "delta")
    arcs = g.edges.select("src", "dst", (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).repartition("src").persist()
    state, _ = rounds.cut(spark.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0).cast("long").alias("dist"), F.lit(0).cast("long").alias("bucket")))
    while True:
        low = state.agg(F.min("bucket").alias("b")).first()["b"]
        if low is None:
            arcs.unpersist()
            return g.vertices.join(state, "id", "left").select("id", "dist")
        front = state.filter(F.col("bucket") == low).select(F.col("id").alias("src"), "dist")
        offers = arcs.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))
        new = state.join(offers, "id", "full").select(
            "id", F.least("dist", "offer").alias("dist"),
            F.when(better, F.floor(F.col("offer") / delta)).when(F.col("bucket") != low, F.col("bucket")).alias("bucket"),
        )
        state, _ = rounds.cut(new)


def reach_sets(g: PropertyGraph, sources: DataFrame, label: str = "reach", max_rounds: int | None = None) -> DataFrame:
    """id, word, last: the last round in which any bit of the word reached the vertex.

    ``sources``: id, word, bits (LONG).  Sets of 64 sources travel as one long and are combined
    by bit-or; only words that changed travel on.
    """
    rounds, arcs = Rounds(g.edges.sparkSession, label), g.arcs()
    state, _ = rounds.cut(sources.groupBy("id", "word").agg(F.bit_or("bits").alias("bits")).select("id", "word", "bits", F.lit(0).alias("last")))
    r = 0
    while max_rounds is None or r < max_rounds:
        r += 1
        front = state.filter(F.col("last") == r - 1).select(F.col("id").alias("src"), "word", "bits")
        sent = arcs.join(front, "src").groupBy(F.col("dst").alias("id"), "word").agg(F.bit_or("bits").alias("more"))
        whole = F.coalesce("bits", F.lit(0).cast("long")).bitwiseOR(F.coalesce("more", F.lit(0).cast("long")))
        new = state.join(sent, ["id", "word"], "full").select("id", "word", whole.alias("now"), "bits", "last")
        new = new.select("id", "word", F.col("now").alias("bits"), F.when(F.col("bits").isNull() | (F.col("now") != F.col("bits")), F.lit(r)).otherwise(F.col("last")).alias("last"))
        state, seen = rounds.cut(new, moved=F.col("last") == r)
        if not seen["moved"]:
            break
    arcs.unpersist()
    return state


def distances(g: PropertyGraph, sources: DataFrame, label: str = "distances") -> DataFrame:
    """source, id, dist for every vertex that each row of ``sources`` (id) reaches."""
    rounds, arcs = Rounds(g.edges.sparkSession, label), g.arcs()
    state, _ = rounds.cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist")))
    d = 0
    while True:
        d += 1
        front = state.filter(F.col("dist") == d - 1).select("source", F.col("id").alias("src"))
        found = arcs.join(front, "src").select("source", F.col("dst").alias("id")).distinct()
        found = found.join(state.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(d).alias("dist"))
        state, seen = rounds.cut(state.unionByName(found), found=F.col("dist") == d)
        if not seen["found"]:
            arcs.unpersist()
            return state
