"""File formats: CSR, edge lists, adjacency text, hypergraph text, permutations, traces, features, logs.

Readers give DataFrames.  Binary arrays are read in ranges of their files, so a large file is
many tasks; whole-file text formats put one number on a line, and lines are numbered by Spark's
own splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import HyperGraph, PropertyGraph
from graphloom.operators.convert import compact
from graphloom.operators.primitives import ranks
from graphloom.sources.binary import adjacency_pieces, open_fs, string_together
from graphloom.store import Scratch

#: Numbers in one range of a binary file.
RANGE = 1 << 20


def read_u32(spark: SparkSession, path: str, start: int, count: int, base: int = 0, **more: int) -> DataFrame:
    """at, value: ``count`` little-endian 32-bit numbers from number ``start`` on, counted from byte ``base``; each range is a row's task.

    ``more`` names columns with the numbers from other starts.  They are read side by side, not joined:
    Spark takes the rows of the ranges for the size of the file and would broadcast it.
    """
    columns = {"value": start, **more}
    pieces = spark.range(max(1, -(-count // RANGE)), numPartitions=max(1, min(10_000, -(-count // RANGE))))

    def run(batches):
        store, where = open_fs(path)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                lo, n = i * RANGE, max(0, min(RANGE, count - i * RANGE))
                with store.open_input_file(where) as file:
                    got = [np.frombuffer(file.read_at(4 * n, base + 4 * (first + lo)), "<u4").astype(np.int64) for first in columns.values()]
                if any(len(x) != n for x in got):
                    raise ValueError(f"{path} is too short")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), *map(pa.array, got)], ["at", *columns])

    return pieces.mapInArrow(run, ", ".join(f"{c} long" for c in ("at", *columns)))


def _edges_of(spark: SparkSession, offsets: DataFrame, targets: DataFrame, m: int) -> DataFrame:
    """src, dst[, w] from offsets (at, value) and targets (at, value[, w]): each row's range, cut into blocks, meets its block."""
    block = 1 << 16
    weight = [c for c in targets.columns if c == "w"]
    nxt = F.lead("value", 1, m).over(Window.partitionBy("_p").orderBy("at"))
    # offsets overlap by one between ranges, so that a window never spans the file
    spread = offsets.withColumn("_p", F.explode(F.array_distinct(F.array(F.floor(F.col("at") / RANGE), F.floor((F.col("at") - 1) / RANGE)))))
    ends = spread.withColumn("end", nxt).filter(F.floor(F.col("at") / RANGE) == F.col("_p")).filter("value < end")
    rows = ends.select(F.col("at").alias("src"), F.col("value").alias("lo"), F.col("end").alias("hi"))
    rows = rows.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    cells = targets.withColumn("b", F.floor(F.col("at") / block))
    # each target lies after exactly one row's start: carry the last start forward inside the block
    starts = rows.select("b", F.greatest("lo", F.col("b") * block).alias("at"), "src", F.lit(None).cast("long").alias("dst"), *[F.lit(None).cast("long").alias(c) for c in weight], F.lit(0).alias("kind"))
    both = starts.unionByName(cells.select("b", "at", F.lit(None).cast("long").alias("src"), F.col("value").alias("dst"), *weight, F.lit(1).alias("kind")))
    w = Window.partitionBy("b").orderBy("at", "kind")
    return both.withColumn("s", F.last("src", ignorenulls=True).over(w)).filter("kind = 1").select(F.col("s").alias("src"), "dst", *weight)


def read_csr(spark: SparkSession, path: str, weighted: bool = False) -> PropertyGraph:
    """n, m, n offsets, m targets[, m weights]; the last row ends at m."""
    store, where = open_fs(path)
    with store.open_input_file(where) as file:
        n, m = (int(x) for x in np.frombuffer(file.read_at(8, 0), "<u4"))
    weights = {"w": 2 + n + m} if weighted else {}
    return PropertyGraph(spark.range(n), _edges_of(spark, read_u32(spark, path, 2, n), read_u32(spark, path, 2 + n, m, **weights), m))


def read_triple(spark: SparkSession, stem: str, weighted: bool = False) -> PropertyGraph:
    """.config holds n, .idx the offsets, .adj the targets[, weights]."""
    n = int(spark.read.text(f"{stem}.config").first()["value"].split()[0])
    store, where = open_fs(f"{stem}.adj")
    m = store.get_file_info(where).size // (8 if weighted else 4)
    weights = {"w": m} if weighted else {}
    return PropertyGraph(spark.range(n), _edges_of(spark, read_u32(spark, f"{stem}.idx", 0, n), read_u32(spark, f"{stem}.adj", 0, m, **weights), m))


def write_csr(g: PropertyGraph, path: str, ascending: bool = False) -> None:
    """One flat file, which is what readers of the format expect: loops go, repeats stay."""
    edges = g.edges.filter("src <> dst")
    offsets, targets, weights = adjacency_pieces(edges, g.vertices, "src", "dst", path, descending=not ascending)
    string_together(path, np.array([g.vertices.count(), edges.count()], "<u4").tobytes(), offsets, targets, weights)


def read_hyper_binary(spark: SparkSession, stem: str) -> HyperGraph:
    """.config holds the four counts; weights follow the members where the files have room for them."""
    store, where = open_fs(f"{stem}.vadj")
    nv, mv, nh, mh = (int(x) for x in spark.read.text(f"{stem}.config").first()["value"].split()[:4])
    weighted = mv > 0 and store.get_file_info(where).size == 8 * mv
    sides = []
    for side, n, m, a, b in (("v", nv, mv, "v", "h"), ("h", nh, mh, "h", "v")):
        weights = {"w": m} if weighted else {}
        edges = _edges_of(spark, read_u32(spark, f"{stem}.{side}idx", 0, n), read_u32(spark, f"{stem}.{side}adj", 0, m, **weights), m)
        sides.append(edges.withColumnRenamed("src", a).withColumnRenamed("dst", b))
    return HyperGraph(sides[0], sides[1], spark.range(nv), spark.range(nh))


def read_edgelist(spark: SparkSession, path: str, drop_loops: bool = True, weighted: bool = False) -> PropertyGraph:
    """Lines ``src dst[ w]``, # comments; n is the largest id plus one."""
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    edges = lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), *([parts[2].cast("long").alias("w")] if weighted else []))
    g = PropertyGraph.of(edges)  # ids of dropped loops count too
    return PropertyGraph(g.vertices, edges.filter("src <> dst")) if drop_loops else g


def read_snap(spark: SparkSession, path: str, weighted: bool = False, symmetric: bool = False) -> PropertyGraph:
    g = read_edgelist(spark, path, drop_loops=False, weighted=weighted)
    return g.symmetrize() if symmetric else g


def write_edgelist(g: PropertyGraph, path: str, sep: str = " ") -> None:
    cols = ["src", "dst", *(["w"] if g.weighted else [])]
    g.edges.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]).alias("value")).write.mode("overwrite").text(path)


def numbered(spark: SparkSession, path: str, name: str = "at") -> DataFrame:
    """value and the line's number over all files of ``path`` in name order, whatever splits Spark makes."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_k"))
    return ranks(lines, F.col("_f"), F.col("_b"), F.col("_k"), name=name).drop("_f", "_b", "_k")


def _numbers(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The tag on the first line, and at, value of all numbers after it (any white space between)."""
    scratch = Scratch(spark, "numbers")
    lines = numbered(spark, path, "line")
    words = lines.select("line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("k", "word")).filter("word <> ''")
    words = scratch.table(ranks(words, F.col("line"), F.col("k"), name="at"), "words")
    tag = words.filter("at = 0").first()["word"]
    return tag, words.filter("at > 0").select((F.col("at") - 1).alias("at"), F.col("word").cast("long").alias("value"))


def _part(numbers: DataFrame, start: int, count: int) -> DataFrame:
    return numbers.filter((F.col("at") >= start) & (F.col("at") < start + count)).select((F.col("at") - start).alias("at"), "value")


def read_adjacency(spark: SparkSession, path: str) -> PropertyGraph:
    """AdjacencyGraph or WeightedAdjacencyGraph text."""
    tag, numbers = _numbers(spark, path)
    head = {r.at: r.value for r in numbers.filter("at < 2").collect()}
    n, m, length = head[0], head[1], numbers.count()
    weighted = tag == "WeightedAdjacencyGraph"
    if tag not in ("AdjacencyGraph", "WeightedAdjacencyGraph") or length != n + (2 * m if weighted else m) + 2:
        raise ValueError(f"{path} isn't an adjacency graph")
    targets = _part(numbers, 2 + n, m)
    if weighted:
        targets = targets.join(_part(numbers, 2 + n + m, m).withColumnRenamed("value", "w"), "at")
    return PropertyGraph(spark.range(n), _edges_of(spark, _part(numbers, 2, n), targets, m))


def _csr_lines(edges: DataFrame, ids: DataFrame, src: str, dst: str, block: int) -> DataFrame:
    """block, at, value: offsets, then targets[, weights] of one side, in file order."""
    weighted = "w" in edges.columns
    g = PropertyGraph(ids, edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *(["w"] if weighted else [])))
    deg = g.degrees().select("id", F.col("out_deg").alias("deg"))
    from graphloom.operators.primitives import scan

    offsets = scan(deg.withColumn("deg", F.col("deg").cast("long")), "id", "deg").select(F.lit(block).alias("block"), F.col("id").alias("at"), F.col("scan").alias("value"))
    placed = ranks(g.edges, F.col("src"), F.col("dst"), *([F.col("w")] if weighted else []), name="at")
    out = offsets.unionByName(placed.select(F.lit(block + 1).alias("block"), "at", F.col("dst").alias("value")))
    return out.unionByName(placed.select(F.lit(block + 2).alias("block"), "at", F.col("w").alias("value"))) if weighted else out


def write_adjacency(g: PropertyGraph, path: str) -> None:
    """One number a line, files in order."""
    tag = "WeightedAdjacencyGraph" if g.weighted else "AdjacencyGraph"
    spark = g.edges.sparkSession
    head = spark.createDataFrame([(0, 0, tag), (0, 1, str(g.vertices.count())), (0, 2, str(g.edges.count()))], "block int, at long, value string")
    body = _csr_lines(g.edges, g.vertices, "src", "dst", 1).select("block", "at", F.col("value").cast("string").alias("value"))
    head.unionByName(body).orderBy("block", "at").select("value").write.mode("overwrite").text(path)


def write_hyper(h: HyperGraph, path: str) -> None:
    weighted = "w" in h.v2h.columns
    spark = h.v2h.sparkSession
    counts = [h.vertices.count(), h.v2h.count(), h.hyperedges.count(), h.h2v.count()]
    tag = "WeightedAdjacencyHypergraph" if weighted else "AdjacencyHypergraph"
    head = spark.createDataFrame([(0, i, str(x)) for i, x in enumerate([tag, *counts])], "block int, at long, value string")
    body = _csr_lines(h.v2h, h.vertices, "v", "h", 1).unionByName(_csr_lines(h.h2v, h.hyperedges, "h", "v", 4))
    head.unionByName(body.select("block", "at", F.col("value").cast("string").alias("value"))).orderBy("block", "at").select("value").write.mode("overwrite").text(path)


def read_hyper(spark: SparkSession, path: str) -> HyperGraph:
    tag, numbers = _numbers(spark, path)
    if tag not in ("AdjacencyHypergraph", "WeightedAdjacencyHypergraph"):
        raise ValueError(f"{path} isn't a hypergraph")
    nv, mv, nh, mh = (r.value for r in numbers.filter("at < 4").orderBy("at").collect())
    weighted, at, sides = tag.startswith("W"), 4, []
    for n, m, a, b in ((nv, mv, "v", "h"), (nh, mh, "h", "v")):
        targets = _part(numbers, at + n, m)
        if weighted:
            targets = targets.join(_part(numbers, at + n + m, m).withColumnRenamed("value", "w"), "at")
        edges = _edges_of(spark, _part(numbers, at, n), targets, m)
        at += n + m + (m if weighted else 0)
        sides.append(edges.withColumnRenamed("src", a).withColumnRenamed("dst", b))
    return HyperGraph(sides[0], sides[1], spark.range(nv), spark.range(nh))


def read_community(spark: SparkSession, path: str) -> HyperGraph:
    """Each line a hyperedge with its members; vertex ids compacted in ascending order."""
    lines = numbered(spark, path, "line").filter(F.trim("value") != "")
    lines = ranks(lines, F.col("line"), name="h")
    pairs = lines.select("h", F.explode(F.split(F.trim("value"), r"\s+")).alias("v")).select(F.col("v").cast("long").alias("v"), "h")
    from graphloom.operators.convert import hypergraph_from_pairs

    return hypergraph_from_pairs(compact(pairs, "v").select("v", "h"))


def read_konect(spark: SparkSession, path: str, weighted: bool = False) -> HyperGraph:
    """Lines ``v h[ w ...]``, % header; both id spaces compacted."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(~F.trim("value").startswith("%") & (F.trim("value") != ""))
    pairs = lines.select(parts[0].cast("long").alias("v"), parts[1].cast("long").alias("h"), *([parts[2].cast("long").alias("w")] if weighted else []))
    from graphloom.operators.convert import hypergraph_from_pairs

    return hypergraph_from_pairs(compact(pairs, "v", "h"))


def read_perm(spark: SparkSession, path: str) -> DataFrame:
    """n, m, then ``old new`` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) == 2).select(parts[0].cast("long").alias("old_id"), parts[1].cast("long").alias("new_id"))


def write_perm(perm: DataFrame, m: int, path: str) -> None:
    spark = perm.sparkSession
    head = spark.createDataFrame([(-2, str(perm.count())), (-1, str(m))], "at long, value string")
    body = perm.select(F.col("old_id").alias("at"), F.concat_ws(" ", "old_id", "new_id").alias("value"))
    head.unionByName(body).orderBy("at").select("value").write.mode("overwrite").text(path)


def write_trace(trace: DataFrame, n: int, path: str) -> None:
    """n, then a separator and the frontier's ids for each level; one folder a sample."""
    levels = trace.select("sample", "level").distinct()
    rows = trace.select("sample", "level", "id", F.col("id").cast("string").alias("value")).unionByName(levels.select("sample", "level", F.lit(-1).cast("long").alias("id"), F.lit("-" * 10).alias("value")))
    head = trace.select("sample").distinct().select("sample", F.lit(-1).alias("level"), F.lit(-1).cast("long").alias("id"), F.lit(str(n)).alias("value"))
    rows.unionByName(head).orderBy("sample", "level", "id").select("sample", "value").write.mode("overwrite").partitionBy("sample").text(path)


def read_trace(spark: SparkSession, path: str, sample: int) -> DataFrame:
    """sample, level, id of one sample's folder or file: levels are running counts of separators."""
    lines = numbered(spark, path).withColumn("sep", F.col("value").startswith("---").cast("long"))
    from graphloom.operators.primitives import scan

    counted = scan(lines, "at", "sep", inclusive=True)
    return counted.filter("at > 0 and sep = 0").select(F.lit(sample).alias("sample"), (F.col("scan") - 1).cast("int").alias("level"), F.col("value").cast("long").alias("id"))


def write_features(features: DataFrame, path: str) -> None:
    text = F.concat_ws(",", F.transform("feat", lambda x: x.cast("string")))
    features.orderBy("id").select(text.alias("value")).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark, path, "id").select("id", F.transform(F.split("value", ","), lambda x: x.cast("int")).alias("feat"))


def write_ecc(ecc: DataFrame, path: str) -> None:
    ecc.orderBy("id").select(F.col("ecc").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_log(spark: SparkSession, path: str, **labels: str) -> DataFrame:
    """sec and the given labels: last word of the lines that report an average or running time."""
    lines = spark.read.text(path).filter(F.col("value").contains("Running") | F.col("value").contains("Avg"))
    sec = F.element_at(F.split(F.trim("value"), r"\s+"), -1).cast("double")
    return lines.select(*[F.lit(v).alias(k) for k, v in labels.items()], sec.alias("sec"))
