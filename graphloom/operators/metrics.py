"""Metrics of orders and labellings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.primitives import ranks
from graphloom.operators.reorder import rabbit_adjacency


def _gaps(g: PropertyGraph) -> DataFrame:
    """src, dst, gap to the neighbour before (null for the first)."""
    return g.edges.select("src", "dst", (F.col("dst") - F.lag("dst").over(Window.partitionBy("src").orderBy("dst"))).alias("gap"))


def gap_cost(g: PropertyGraph) -> DataFrame:
    """value: sum of log2 of the gaps between neighbours, over the number of edges."""
    return _gaps(g).agg((F.sum(F.when(F.col("gap") > 0, F.log2("gap")).otherwise(0.0)) / F.count("*")).alias("value"))


def gap_entropy(g: PropertyGraph) -> DataFrame:
    """value: sum of p log2 p over gap lengths; the first neighbour's gap is its id."""
    m = g.edges.count()
    p = F.col("n") / m
    return _gaps(g).groupBy(F.coalesce("gap", "dst").alias("gap")).agg(F.count("*").alias("n")).agg(F.sum(p * F.log2(p)).alias("value"))


def log_cost(g: PropertyGraph) -> DataFrame:
    """value: mean log2 of one plus the distance from a vertex to its neighbour."""
    return g.edges.agg((F.sum(F.log2(F.abs(F.col("dst") - F.col("src")) + 1)) / F.count("*")).alias("value"))


def log_gap_cost(g: PropertyGraph) -> DataFrame:
    """value: mean log2 of one plus the gap; the first neighbour's gap is taken to the vertex."""
    gap = F.abs(F.coalesce("gap", F.col("dst") - F.col("src"))) + 1
    return _gaps(g).agg((F.sum(F.log2(gap)) / F.count("*")).alias("value"))


def locality_score(g: PropertyGraph, w: int = 5) -> DataFrame:
    """value: over pairs of ids at most ``w`` apart, common in-neighbours plus links between them.

    Common in-neighbours are pairs of out-edges of one source whose ends are near: a band join on
    (source, block of w + 1 ids), each edge looking into its own block and the one before.
    """
    e = g.edges.select("src", "dst").distinct().withColumn("block", F.floor(F.col("dst") / (w + 1)))
    a, b = e.alias("a"), e.withColumn("block", F.explode(F.array("block", F.col("block") + 1))).alias("b")
    pairs = a.join(b, ["src", "block"]).filter((F.col("b.dst") < F.col("a.dst")) & (F.col("a.dst") - F.col("b.dst") <= w))
    links = e.filter((F.abs(F.col("src") - F.col("dst")) <= w) & (F.col("src") != F.col("dst")))
    return pairs.agg(F.count("*").alias("x")).join(links.agg(F.count("*").alias("y"))).select((F.col("x") + F.col("y")).alias("value"))


def skew_locality(g: PropertyGraph, size: int) -> DataFrame:
    """share, top, bottom, skew: degree sums of the hottest and coldest partitions (the last one is left out)."""
    n = g.vertices.count()
    parts = (n - 1) // size + 1
    sums = g.degrees().groupBy(F.floor(F.col("id") / size).alias("p")).agg(F.sum("out_deg").alias("s")).filter(F.col("p") < parts - 1)
    ranked = ranks(sums, F.col("s"), F.col("p"), name="lo").withColumn("lo", F.col("lo") + 1)
    ranked = ranked.withColumn("hi", F.lit(ranked.count() + 1) - F.col("lo"))
    shares = [(s, math.ceil(parts * s / 100)) for s in (1, 10, 20, 30, 40, 50)]
    counts = F.broadcast(g.edges.sparkSession.createDataFrame(shares, "share int, c int"))  # six rows
    both = ranked.join(counts, (F.col("lo") <= F.col("c")) | (F.col("hi") <= F.col("c")))
    out = both.groupBy("share").agg(F.sum(F.when(F.col("hi") <= F.col("c"), F.col("s")).otherwise(0)).alias("top"), F.sum(F.when(F.col("lo") <= F.col("c"), F.col("s")).otherwise(0)).alias("bottom"))
    return out.withColumn("skew", F.when(F.col("bottom") > 0, F.col("top") / F.col("bottom")))


def overflow(g: PropertyGraph, size: int) -> DataFrame:
    """part, extra: partitions with more hubs than their even share (the last one is left out)."""
    n = g.vertices.count()
    parts, avg = (n - 1) // size + 1, g.edges.count() // max(1, n)
    hubs = g.degrees().filter(F.col("out_deg") > avg).select(F.floor(F.col("id") / size).alias("part"))
    share = -(-hubs.count() // parts)
    return hubs.filter(F.col("part") < parts - 1).groupBy("part").agg((F.count("*") - share).alias("extra")).filter("extra > 0")


def modularity(g: PropertyGraph, labels: DataFrame) -> DataFrame:
    """value: sum over communities of inner weight over 2m less (total weight over 2m) squared."""
    adj = rabbit_adjacency(g)
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    sums = adj.join(a, "src").join(b, "dst").groupBy("la").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inner"))
    whole = sums.agg(F.sum("total").alias("m2"))
    return sums.join(F.broadcast(whole)).agg(F.sum(F.col("inner") / F.col("m2") - F.pow(F.col("total") / F.col("m2"), 2)).alias("value"))  # one row is broadcast


def degree_histogram(g: PropertyGraph) -> DataFrame:
    """kind, upto, n: vertices by decades of out- and in-degree (at most 1, 10, 100, ...)."""
    decade = F.when(F.col("d") <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(10.0), F.ceil(F.log10(F.col("d").cast("double")) - 1e-12)).cast("long"))
    deg = g.degrees().select(F.explode(F.array(F.struct(F.lit("out").alias("kind"), F.col("out_deg").alias("d")), F.struct(F.lit("in").alias("kind"), F.col("in_deg").alias("d")))).alias("x")).select("x.*")
    return deg.groupBy("kind", decade.alias("upto")).agg(F.count("*").alias("n"))
