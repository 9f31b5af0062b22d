"""Flat binary files and coded graph files.

A flat file is written in pieces, one a task, whose bytes the driver strings together in order: it
never decodes a row.  A task that runs again writes a piece of another name, and only the pieces
whose names came back are used, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import HyperGraph, PropertyGraph
from graphloom.operators.primitives import scan
from graphloom.sources import codec

#: Bytes that one read takes from a file at least.
SPAN = 1 << 22


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def read_bytes(path: str, start: int, count: int) -> bytes:
    store, where = open_fs(path)
    with store.open_input_file(where) as file:
        data = file.read_at(count, start)
    if len(data) != count:
        raise ValueError(f"{path} is too short")
    return data


def pieces(rows: DataFrame, column: str, path: str, *order: Column) -> list[str]:
    """Pieces of a file beside ``path``, in order: numbers below 2**32 (4 bytes, little-endian) or bytes of a column."""
    folder = f"{path}.pieces-{uuid.uuid4().hex}"
    store, where = open_fs(folder)
    store.create_dir(where, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}"
        task_store, place = open_fs(name)
        with task_store.open_output_stream(place) as out:
            for batch in batches:
                values = batch.column(0)
                if pa.types.is_integer(values.type):
                    numbers = values.to_numpy(zero_copy_only=False)
                    if len(numbers) and (numbers.min() < 0 or numbers.max() >> 32):
                        raise ValueError("a number doesn't fit into 32 bits")
                    out.write(numbers.astype("<u4").tobytes())
                else:
                    out.write(b"".join(values.to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name])], ["part", "name"])

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(column)
    return [r["name"] for r in sorted(placed.mapInArrow(run, "part int, name string").collect())]  # a row a piece


def string_together(path: str, *parts: bytes | list[str]) -> None:
    """``path`` from bytes and lists of pieces; the pieces go."""
    store, where = open_fs(path)
    if "/" in where:
        store.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(where) as out:
        for part in parts:
            if isinstance(part, bytes):
                out.write(part)
                continue
            for name in part:
                with store.open_input_stream(open_fs(name)[1]) as piece:
                    while block := piece.read(SPAN):
                        out.write(block)
    for folder in {name.rsplit("/", 1)[0] for part in parts if not isinstance(part, bytes) for name in part}:
        store.delete_dir(open_fs(folder)[1])


def offset_pieces(sizes: DataFrame, path: str) -> list[str]:
    """Pieces of the running sums before each id. ``sizes``: id, size."""
    return pieces(scan(sizes.withColumn("size", F.col("size").cast("long")), "id", "size"), "scan", path, F.col("id"))


def adjacency_pieces(edges: DataFrame, ids: DataFrame, src: str, dst: str, path: str, descending: bool = False) -> tuple[list[str], list[str], list[str]]:
    """Offsets, targets and weights of one side; neighbours in order, repeats kept."""
    degrees = ids.join(edges.groupBy(F.col(src).alias("id")).agg(F.count("*").alias("size")), "id", "left").select("id", F.coalesce("size", F.lit(0)).alias("size"))
    weighted = "w" in edges.columns
    order = [F.col(src), *[F.col(c).desc() if descending else F.col(c) for c in (dst, *(["w"] if weighted else []))]]
    return offset_pieces(degrees, path), pieces(edges, dst, path, *order), pieces(edges, "w", path, *order) if weighted else []


def write_triple(g: PropertyGraph, stem: str) -> None:
    """.config holds n, .idx the offsets, .adj the targets[, weights]."""
    offsets, targets, weights = adjacency_pieces(g.edges, g.vertices, "src", "dst", stem)
    string_together(f"{stem}.config", str(g.vertices.count()).encode())
    string_together(f"{stem}.idx", offsets)
    string_together(f"{stem}.adj", targets, weights)


def write_hyper_binary(h: HyperGraph, stem: str) -> None:
    """.config holds the four counts, .vidx and .vadj the vertices' side, .hidx and .hadj the hyperedges'."""
    counts = [x.count() for x in (h.vertices, h.v2h, h.hyperedges, h.h2v)]
    string_together(f"{stem}.config", " ".join(map(str, counts)).encode())
    for side, pairs, ids, a, b in (("v", h.v2h, h.vertices, "v", "h"), ("h", h.h2v, h.hyperedges, "h", "v")):
        offsets, targets, weights = adjacency_pieces(pairs, ids, a, b, stem)
        string_together(f"{stem}.{side}idx", offsets)
        string_together(f"{stem}.{side}adj", targets, weights)


# coded graphs: n, m and the bytes of the data as 64-bit numbers, n + 1 offsets, n degrees, data


def _coded_rows(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, part, data in file order (part -1: where a row's later chunks begin) and id, size, degree of all rows."""
    if "part" not in coded.columns:
        return coded.select("id", F.lit(0).alias("part"), "data"), coded.select("id", F.length("data").alias("size"), "degree")
    rows = coded.groupBy("id").agg(
        F.sum(F.length("data")).alias("bytes"), F.sum("degree").alias("degree"), F.max("part").alias("last"),
        F.transform(F.sort_array(F.collect_list(F.struct("part", F.length("data").alias("n")))), lambda x: x["n"].cast("long")).alias("lengths"),
    )
    table = F.col("last") * 4

    @F.pandas_udf("binary")
    def begins(lengths: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([(4 * k + np.cumsum(x[:-1])).astype("<u4").tobytes() for x, k in zip(lengths, last, strict=True)])

    heads = rows.filter("last > 0").select("id", F.lit(-1).alias("part"), begins("lengths", "last").alias("data"))
    return coded.select("id", "part", "data").unionByName(heads), rows.select("id", (F.col("bytes") + table).alias("size"), "degree")


def _section(coded: DataFrame, path: str, counts: list[int]) -> list[bytes | list[str]]:
    data, rows = _coded_rows(coded)
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    if total >> 32:
        raise ValueError("offsets of coded files have 32 bits")
    head = np.array([*counts, total], "<i8").tobytes()
    return [head, offset_pieces(rows.select("id", "size"), path), np.array([total], "<u4").tobytes(), pieces(rows, "degree", path, F.col("id")), pieces(data, "data", path, F.col("id"), F.col("part"))]


def write_coded(g: PropertyGraph, path: str, code: str = "byte", chunk: int | None = None, symmetric: bool = True) -> None:
    """Loops and repeats are dropped; a graph that isn't ``symmetric`` gets its in-edges as a second section.

    With ``chunk`` a row is coded in chunks of so many neighbours that can be read apart.
    """
    simple = PropertyGraph(g.vertices, g.edges.select("src", "dst")).simplify()
    counts = [g.vertices.count(), simple.edges.count()]
    parts = _section(codec.encode(simple, code, chunk), path, counts)
    if not symmetric:
        parts += _section(codec.encode(simple.transpose(), code, chunk), path, [])
    string_together(path, *parts)


def write_hyper_coded(h: HyperGraph, path: str, code: str = "byte", chunk: int | None = None) -> None:
    """Both sides, one section each."""
    parts = []
    for coded, ids, pairs in zip(codec.encode_hyper(h, code, chunk), (h.vertices, h.hyperedges), (h.v2h.select("v", "h"), h.h2v.select("v", "h")), strict=True):
        parts += _section(coded, path, [ids.count(), pairs.distinct().count()])
    string_together(path, *parts)


def _spans(rows: DataFrame, path: str, schema: str, cut) -> DataFrame:
    """Rows of id, degree, part, lo, hi with the file's bytes from lo to hi: ``cut(row, bytes)`` yields result tuples."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = open_fs(path)
        with store.open_input_file(where) as file:
            held, start = b"", 0
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if row["lo"] < start or row["hi"] > start + len(held):
                        start = row["lo"]
                        held = file.read_at(max(SPAN, row["hi"] - start), start)
                    data = held[row["lo"] - start : row["hi"] - start]
                    if len(data) != row["hi"] - row["lo"]:
                        raise ValueError(f"{path} is too short")
                    out += cut(row, data)
                columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
                kinds = [pa.binary() if x.endswith(" binary") else pa.int64() for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.repartitionByRange("lo").sortWithinPartitions("lo").mapInArrow(run, schema)


def _read_section(spark: SparkSession, path: str, at: int, n: int, total: int, code: str, chunk: int | None) -> PropertyGraph:
    """One section whose offsets begin at byte ``at``."""
    from graphloom.sources.formats import read_u32

    begin = at + 4 * (2 * n + 1)
    rows = read_u32(spark, path, 0, n, base=at, hi=1, degree=n + 1)
    rows = rows.select(F.col("at").alias("id"), "degree", F.lit(0).cast("long").alias("part"), (F.col("value") + begin).alias("lo"), (F.col("hi") + begin).alias("hi")).filter("degree > 0")
    if chunk:
        later = F.floor((F.col("degree") - 1) / chunk)

        def chunks(row, table):
            cuts = [4 * (row["size"] - 1), *np.frombuffer(table, "<u4").tolist(), row["end"] - row["lo"]]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                yield row["id"], min(chunk, row["degree"] - k * chunk), k, row["lo"] + a, row["lo"] + b

        long = rows.withColumn("size", later + 1).withColumn("end", F.col("hi")).withColumn("hi", F.col("lo") + 4 * later)
        rows = _spans(long, path, "id long, degree long, part long, lo long, hi long", chunks)
    coded = _spans(rows, path, "id long, degree long, part long, data binary", lambda row, data: [(row["id"], row["degree"], row["part"], data)])
    return PropertyGraph(spark.range(n), codec.decode(coded, code).edges)


def read_coded(spark: SparkSession, path: str, code: str = "byte", chunk: int | None = None) -> PropertyGraph:
    """The out-edges of a coded graph; a section of in-edges says the same and isn't read."""
    n, _, total = np.frombuffer(read_bytes(path, 0, 24), "<i8").tolist()
    return _read_section(spark, path, 24, n, total, code, chunk)


def read_hyper_coded(spark: SparkSession, path: str, code: str = "byte", chunk: int | None = None) -> HyperGraph:
    nv, _, total = np.frombuffer(read_bytes(path, 0, 24), "<i8").tolist()
    second = 24 + 4 * (2 * nv + 1) + total
    nh, _, more = np.frombuffer(read_bytes(path, second, 24), "<i8").tolist()
    v = _read_section(spark, path, 24, nv, total, code, chunk).edges
    h = _read_section(spark, path, second + 24, nh, more, code, chunk).edges
    return HyperGraph(v.select(F.col("src").alias("v"), F.col("dst").alias("h")), h.select(F.col("src").alias("h"), F.col("dst").alias("v")), spark.range(nv), spark.range(nh))
