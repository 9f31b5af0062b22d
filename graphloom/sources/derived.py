"""Graphs and hypergraphs derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import HyperGraph, PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_next(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Part to the part of the next line in each order, distinct, no loops."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("p")).distinct()
    nxt = F.lead("p").over(Window.partitionBy("o").orderBy("ln", "p"))
    edges = lines.select(F.col("p").alias("src"), nxt.alias("dst")).filter("dst is not null and src <> dst").distinct()
    return PropertyGraph(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), edges)


def part_sym(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return part_next(spark, sf_dir).symmetrize()


def part_weighted(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    g = part_sym(spark, sf_dir)
    w = (1 + (7 * F.least("src", "dst") + 13 * F.greatest("src", "dst")) % 10).cast("long")
    return PropertyGraph(g.vertices, g.edges.select("src", "dst", w.alias("w")))


def order_part(spark: SparkSession, sf_dir: str) -> HyperGraph:
    """Parts are vertices, orders hyperedges."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("h")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return HyperGraph.symmetric(pairs, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), orders)


def cust_supp(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers 0..., suppliers after them; w counts order lines between them; both directions."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    shift = customers.agg(F.max("id").alias("m")).first()["m"] + 1
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lines.groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + shift).alias("dst")).agg(F.count("*").alias("w"))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return PropertyGraph(customers.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + shift).alias("id"))), both)


def hub(g: PropertyGraph) -> int:
    """The smallest id of largest out-degree."""
    return g.edges.groupBy("src").count().agg(F.min(F.struct((-F.col("count")).alias("d"), "src")).alias("x")).first()["x"]["src"]
