"""Converters between edge lists, CSR, hyperedge lists and cliques, and timing summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.exprs import hash32
from graphloom.graph import HyperGraph, PropertyGraph
from graphloom.operators.primitives import ranks, scan


def el2csr(g: PropertyGraph, undirected: bool = False, weights: int | None = None, reverse: bool = False) -> DataFrame:
    """id, offset, nbrs[, ws]: loops dropped, repeats kept, neighbours descending.

    ``weights``: 0 takes column w, 1 all ones, anything else a hashed 1 to 10; ``reverse`` gives in-edges.
    """
    e = g.edges.filter("src <> dst")
    if reverse:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *([F.col("w")] if "w" in e.columns else []))
    if weights is not None:
        place = hash32((F.col("src") * 31 + F.col("dst")).bitwiseAND(F.lit(0xFFFFFFFF)))
        e = e.withColumn("w", F.col("w").cast("long") if weights == 0 else F.lit(1).cast("long") if weights == 1 else place % 10 + 1)
    if undirected:
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *([F.col("w")] if weights is not None else []))
        e = e.select(*back.columns).unionByName(back)
    pair = F.struct("dst", "w") if weights is not None else F.struct("dst")
    rows = e.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(pair), asc=False).alias("p"))
    rows = g.vertices.join(rows, "id", "left").select("id", F.coalesce(F.col("p.dst"), F.array().cast("array<long>")).alias("nbrs"), *([F.coalesce(F.col("p.w"), F.array().cast("array<long>")).alias("ws")] if weights is not None else []))
    sized = scan(rows.withColumn("deg", F.size("nbrs").cast("long")), "id", "deg")
    return sized.select("id", F.col("scan").alias("offset"), "nbrs", *(["ws"] if weights is not None else []))


def gen_el(csr: DataFrame) -> DataFrame:
    """src, dst of CSR rows."""
    return csr.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))


def graph_from_edges(edges: DataFrame, symmetric: bool = False) -> PropertyGraph:
    """Loops and repeats go only when the graph is made symmetric."""
    g = PropertyGraph.of(edges)
    return g.symmetrize() if symmetric else g


def hypergraph_from_pairs(pairs: DataFrame) -> HyperGraph:
    """``pairs``: v, h[, w]."""
    spark = pairs.sparkSession
    top = pairs.agg(F.coalesce(F.max("v"), F.lit(-1)).alias("v"), F.coalesce(F.max("h"), F.lit(-1)).alias("h")).first()
    return HyperGraph.symmetric(pairs, spark.range(top["v"] + 1), spark.range(top["h"] + 1))


def compact(pairs: DataFrame, *columns: str) -> DataFrame:
    """Ids of each column replaced by their places among the ids in use, ascending."""
    for c in columns:
        places = ranks(pairs.select(F.col(c).alias("_id")).distinct(), F.col("_id"), name="_at")
        pairs = pairs.join(places, pairs[c] == places["_id"]).withColumn(c, F.col("_at")).drop("_id", "_at")
    return pairs


def to_mesh(h: HyperGraph) -> DataFrame:
    """value: one line h,v for each incidence."""
    return h.h2v.select(F.concat_ws(",", "h", "v").alias("value"))


def summary(log: DataFrame, base: str = "OG") -> DataFrame:
    """engine, algo, reorder, seconds, speedup, data_sets.

    ``log``: engine, data, algo, reorder, sec. Speed-up is the mean over data sets of the base
    order's latency over this order's; data sets that lack one of them are left out.
    """
    sec = log.groupBy("engine", "algo", "data", "reorder").agg(F.avg("sec").alias("sec"))
    og = sec.filter(F.col("reorder") == base).select("engine", "algo", "data", F.col("sec").alias("og"))
    both = sec.join(og, ["engine", "algo", "data"])
    return both.groupBy("engine", "algo", "reorder").agg(F.avg("sec").alias("seconds"), F.avg(F.col("og") / F.col("sec")).alias("speedup"), F.count("*").alias("data_sets"))
