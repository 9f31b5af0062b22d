"""The operator algebra: maps over edges and vertices, scans, packs, sorts.

Whether a frontier is broadcast or shuffled is left to the optimiser, which knows its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph

COMBINE = {"min": F.min, "max": F.max, "sum": F.sum, "bit_or": F.bit_or, "count": lambda c: F.count(F.lit(1)), "first": F.min}


def edge_map_data(g: PropertyGraph, frontier: DataFrame, msg: Column, combine: str = "min", cond: DataFrame | None = None, dedup: bool = True) -> DataFrame:
    """(id, msg): messages along the out-edges of ``frontier``, combined by target.

    ``msg`` may name src, dst, w and the frontier's columns; ``cond`` holds the ids that may
    receive (others are dropped before the aggregation); without ``dedup`` every message is a row.
    """
    sent = g.edges.join(frontier.withColumnRenamed("id", "src"), "src")
    if cond is not None:
        sent = sent.join(cond.select(F.col("id").alias("dst")), "dst", "left_semi")
    sent = sent.select(F.col("dst").alias("id"), msg.alias("msg"))
    return sent.groupBy("id").agg(COMBINE[combine](F.col("msg")).alias("msg")) if dedup else sent


def edge_map(g: PropertyGraph, frontier: DataFrame, cond: DataFrame | None = None, remove_duplicates: bool = True, no_output: bool = False, pack: Column | None = None):
    """(id): the targets of the frontier's edges that ``cond`` lets in.

    ``no_output`` gives an empty frontier; with ``pack`` (a condition on src and dst) only edges that
    meet it are followed, and the graph in which the frontier's other edges are gone comes second.
    """
    kept = pack_edges(g, frontier, pack) if pack is not None else g
    out = edge_map_data(kept, frontier.select("id"), F.col("src"), cond=cond, dedup=False).select("id")
    out = out.filter(F.lit(False)) if no_output else out.distinct() if remove_duplicates else out
    return (out, kept) if pack is not None else out


def edge_map_induced(g: PropertyGraph, frontier: DataFrame) -> DataFrame:
    """(src, dst): one-hop expansion without dedup."""
    return g.edges.join(frontier.select(F.col("id").alias("src")), "src").select("src", "dst")


def edge_map_reduce(g: PropertyGraph, frontier: DataFrame, value: Column, reduce: str = "sum", apply: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, value): map on each edge, reduce by target, then an optional map or filter of the results."""
    out = edge_map_data(g, frontier, value, reduce).withColumnRenamed("msg", "value")
    return apply(out) if apply else out


def edge_map_count(g: PropertyGraph, frontier: DataFrame) -> DataFrame:
    return edge_map_reduce(g, frontier.select("id"), F.lit(1), "count")


def edge_map_filter(g: PropertyGraph, frontier: DataFrame, pred: Column, pack: bool = False):
    """(id, value): out-edges of each frontier vertex that meet ``pred``, zeros too; with ``pack`` also
    the graph in which the frontier's other edges are gone."""
    mine = g.edges.join(frontier.select(F.col("id").alias("src")), "src")
    counts = frontier.select("id").join(mine.groupBy(F.col("src").alias("id")).agg(F.count_if(pred).alias("n")), "id", "left")
    counts = counts.select("id", F.coalesce("n", F.lit(0)).alias("value"))
    return (counts, pack_edges(g, frontier, pred)) if pack else counts


def pack_edges(g: PropertyGraph, frontier: DataFrame, pred: Column) -> PropertyGraph:
    marks = frontier.select(F.col("id").alias("src"), F.lit(True).alias("_in"))
    edges = g.edges.join(marks, "src", "left").filter(F.col("_in").isNull() | pred).drop("_in")
    return PropertyGraph(g.vertices, edges.select(*g.edges.columns))


def vertex_map(state: DataFrame, subset: DataFrame, **cols: Column) -> DataFrame:
    """New values for the subset's rows of a state; other rows stay."""
    marks = subset.select("id", F.lit(True).alias("_in"))
    out = state.join(marks, "id", "left")
    return out.withColumns({k: F.when(F.col("_in"), c).otherwise(F.col(k)) for k, c in cols.items()}).drop("_in")


def vertex_filter(state: DataFrame, pred: Column) -> DataFrame:
    return state.filter(pred)


def vertex_filter_data(subset: DataFrame, data: DataFrame, pred: Column) -> DataFrame:
    """The subset's rows that meet ``pred``, which may name the subset's own columns and those of ``data`` (by id)."""
    return subset.join(data, "id").filter(pred).select(*subset.columns)


def transpose_matrix(cells: DataFrame, block: int = 1024) -> DataFrame:
    """(row, col, value) with row and column exchanged, laid out by square blocks of the result."""
    out = cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return out.repartitionByRange(F.floor(F.col("row") / block), F.floor(F.col("col") / block)).sortWithinPartitions("row", "col")


def histogram(values: DataFrame, key: str, value: Column | None = None, reduce: str = "count") -> DataFrame:
    return values.groupBy(key).agg(COMBINE[reduce](F.lit(1) if value is None else value).alias("value"))


def reduce_column(values: DataFrame, column: str, how: str = "sum") -> DataFrame:
    return values.agg(COMBINE[how](F.col(column)).alias("value"))


def scan(values: DataFrame, order: str, value: str, inclusive: bool = False, backward: bool = False) -> DataFrame:
    """``values`` with a prefix sum ``scan`` by the integer column ``order``, whose values differ.

    Two levels, as in ``ranks``: sums of the range partitions before, then sums inside each one.
    """
    from graphloom.store import Scratch

    key = F.col(order).desc() if backward else F.col(order).asc()
    fixed = Scratch(values.sparkSession, "scan").table(values.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "rows")
    sums = fixed.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = F.broadcast(sums.select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before")))  # one row a partition
    upto = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = fixed.join(sums, "_p").withColumn("scan", F.col("_before") + F.sum(value).over(upto) - (F.lit(0) if inclusive else F.col(value)))
    return out.drop("_p", "_before")


def ranks(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Dense 0-based row numbers in a total order, without a single-task sort.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the
    sizes of the partitions before: one row a partition goes to the driver's plan.
    """
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id()).alias("_m"))
    # monotonically_increasing_id is partition * 2**33 + row
    return _shifted(parted, name)


def _shifted(parted: DataFrame, name: str) -> DataFrame:
    from graphloom.store import Scratch

    fixed = Scratch(parted.sparkSession, "ranks").table(parted, "rows")
    sizes = fixed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))  # one row a partition
    row = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return fixed.join(starts, "_p").withColumn(name, F.col("_start") + row).drop("_p", "_m", "_start")


def pack(values: DataFrame, pred: Column, order: str) -> DataFrame:
    """The rows that meet ``pred`` with dense places ``at``, in the order of an integer column."""
    kept = scan(values.withColumn("_one", pred.cast("long")), order, "_one").filter("_one = 1")
    return kept.withColumnRenamed("scan", "at").drop("_one")


def remove_duplicates(values: DataFrame, *keys: str) -> DataFrame:
    return values.dropDuplicates(list(keys))


def integer_sort(values: DataFrame, key: str, tie: str, descending: bool = False) -> DataFrame:
    k = F.col(key).desc() if descending else F.col(key)
    return values.orderBy(k, tie)


def counting_sort(values: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows with near keys share a partition."""
    return values.repartitionByRange(parts, key).sortWithinPartitions(key)


def search(values: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """(probe, found): membership of each probe."""
    hit = values.select(F.col(key).alias("probe")).distinct().withColumn("_hit", F.lit(True))
    return probes.join(hit, "probe", "left").select("probe", F.coalesce("_hit", F.lit(False)).alias("found"))
