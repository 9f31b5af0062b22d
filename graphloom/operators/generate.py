"""Graph generators and weights, as plans over ``range``: nothing is built on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.exprs import U32, hash32, hash32_int, hash64, let, umod, uniform
from graphloom.graph import HyperGraph, PropertyGraph
from graphloom.operators.primitives import ranks


def mul32(a: Column, b: int) -> Column:
    """Product modulo 2**32 of a value below 2**32 and a constant."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)) * b, F.shiftrightunsigned(a, 16) * b
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(U32))


def rmat(spark: SparkSession, n: int, m: int | None = None, seed: int = 1, a: float = 0.5, b: float = 0.1, c: float | None = None) -> PropertyGraph:
    """Hash-seeded recursive matrix: one bit of each end a level, n rounded up to a power of two."""
    c = b if c is None else c
    m, bits = 10 * n if m is None else m, max(0, math.ceil(math.log2(n)))
    fa, fb, fc = (float(np.float32(x)) for x in (a, b, c))
    h = hash32_int(seed)
    two = (F.col("id") * 2).bitwiseAND(F.lit(U32))
    edges = spark.range(m).select("id", hash32(mul32(two, h)).alias("start"), hash32(mul32((two + 1).bitwiseAND(F.lit(U32)), h)).alias("stride"))
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    draws = F.transform(F.sequence(F.lit(0), F.lit(max(0, bits - 1))), lambda i: hash32((F.col("start") + i.cast("long") * F.col("stride")).bitwiseAND(F.lit(U32))) / float(U32))
    edges = edges.select("id", draws.alias("r"))
    for level in range(bits):
        half, r = 1 << (bits - 1 - level), F.col("r")[level]
        dst = dst + F.when((r >= fa) & (r < fa + fb), half).when(r >= fa + fb + fc, half).otherwise(0)
        src = src + F.when(r >= fa + fb, half).otherwise(0)
    return PropertyGraph(spark.range(1 << bits), edges.select(src.alias("src"), dst.alias("dst")))


def rand_local(spark: SparkSession, n: int, m: int | None = None, dim: int = 0, steps: int = 64) -> PropertyGraph:
    """Uniform ends (dim 0), or ends near the source with a distance that looks ``dim``-dimensional."""
    m = 10 * n if m is None else m
    k = F.col("id")
    i = F.floor(k / (m / n)).cast("long")

    def step(s: Column, _: Column) -> Column:
        h = hash32(s.h)

        def next_(x: Column) -> Column:
            if dim == 0:
                j = x % n
                return F.struct(x.alias("h"), s["pow"].alias("pow"), F.lit(1).alias("phase"), F.when(j == s.i, F.lit(-1).cast("long")).otherwise(j).alias("j"), s.i.alias("i"))
            far = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(s["pow"], F.lit(60)))
            j, grow = (s.i + x % far) % n, (s.phase == 0) & (x % 1000003 < 500001)
            fresh = F.when(s.phase == 0, F.lit(-1).cast("long")).when(j == s.i, F.lit(-1).cast("long")).otherwise(j)
            phase = F.when((s.phase == 0) & ~grow, F.lit(1)).otherwise(F.lit(0))
            return F.struct(x.alias("h"), F.when(grow, s["pow"] + dim).otherwise(s["pow"]).alias("pow"), phase.alias("phase"), fresh.alias("j"), s.i.alias("i"))

        return F.when(s.j >= 0, s).otherwise(let(h, next_))

    init = F.struct(k.alias("h"), F.lit(dim + 2).alias("pow"), F.lit(0).alias("phase"), F.lit(-1).cast("long").alias("j"), i.alias("i"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)
    edges = spark.range(m).select(state.alias("s")).select(F.col("s.i").alias("src"), F.col("s.j").alias("dst"))
    return PropertyGraph(spark.range(n), edges)


def grid(spark: SparkSession, n: int, dim: int = 2) -> PropertyGraph:
    """Torus of ``dim`` dimensions with about n vertices, symmetrised."""
    side = int(round(n ** (1 / dim)))
    ids = spark.range(side**dim)
    steps = []
    for axis in range(dim):
        unit = side ** (dim - 1 - axis)
        place = F.floor(F.col("id") / unit) % side
        steps.append((F.col("id") + F.when(place == side - 1, -(side - 1) * unit).otherwise(unit)).cast("long"))
    return PropertyGraph(ids, ids.select(F.col("id").alias("src"), F.explode(F.array(*steps)).alias("dst"))).symmetrize()


def rand_hyper(spark: SparkSession, nv: int = 100, nh: int | None = None, cardinality: int = 3) -> HyperGraph:
    """``nh`` hyperedges of hashed members, repeats inside a hyperedge dropped."""
    nh = 10 * nv if nh is None else nh
    slots = spark.range(nh * cardinality).select(F.floor(F.col("id") / cardinality).alias("h"), umod(hash64(F.col("id")), nv).alias("v"))
    return HyperGraph.symmetric(slots.distinct().select("v", "h"), spark.range(nv), spark.range(nh))


def parmat(spark: SparkSession, n: int, m: int, a: float = 0.45, b: float = 0.22, c: float = 0.22, seed: int = 42, no_self: bool = False, no_duplicates: bool = False, undirected: bool = False, sort: bool = False) -> DataFrame:
    """src, dst: seeded quadrant walks; edges that a flag rules out are drawn again until m are left."""
    if no_duplicates and m > (n * (n - 1) // (2 if undirected else 1) if no_self else n * n):
        raise ValueError("more edges than pairs")
    bits = max(1, math.ceil(math.log2(max(2, n))))
    out, draws, need = None, 0, m
    from graphloom.store import Scratch

    scratch = Scratch(spark, "parmat")
    for i in range(100):
        size = int(need * 1.3) + 16
        src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
        rows = spark.range(draws, draws + size)
        draws += size
        for level in range(bits):
            half = 1 << (bits - 1 - level)
            rows = rows.withColumn(f"r{level}", uniform("id", F.lit(level), F.lit(seed)))
            r = F.col(f"r{level}")
            dst = dst + F.when((r >= a) & (r < a + b), half).when(r >= a + b + c, half).otherwise(0)
            src = src + F.when(r >= a + b, half).otherwise(0)
        rows = rows.select("id", src.alias("src"), dst.alias("dst")).filter((F.col("src") < n) & (F.col("dst") < n))
        if undirected:
            rows = rows.select("id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        if no_self:
            rows = rows.filter("src <> dst")
        rows = rows if out is None else out.unionByName(rows)
        if no_duplicates:
            rows = rows.groupBy("src", "dst").agg(F.min("id").alias("id")).select("id", "src", "dst")
        out = scratch.table(rows, f"draw{i}")
        need = m - out.count()
        if need <= 0:
            break
    else:
        raise ValueError("the quadrants are too uneven for so many different edges")
    kept = ranks(out, F.col("id"), name="at").filter(F.col("at") < m).select("src", "dst")
    return kept.orderBy("src", "dst") if sort else kept


def add_weights(g: PropertyGraph) -> PropertyGraph:
    """w from 1 to log2 n by the hash of the edge's place; both directions take the one of the larger end."""
    top = max(1, int(math.log2(max(2, g.vertices.count()))))
    placed = ranks(g.edges.select("src", "dst"), F.col("src"), F.col("dst"), name="at")
    placed = placed.select("src", "dst", (F.floor(hash32(F.col("at")) % (2 * top) / 2) + 1).cast("long").alias("w"))
    back = placed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("theirs"))
    both = placed.join(back, ["src", "dst"], "left")
    return PropertyGraph(g.vertices, both.select("src", "dst", F.when(F.col("dst") > F.col("src"), F.coalesce("theirs", "w")).otherwise(F.col("w")).alias("w")))


def add_hyper_weights(h: HyperGraph) -> HyperGraph:
    """One weight into and one out of each hyperedge, by the hash of its id."""
    nh = h.hyperedges.count()
    top = max(1, int(math.log2(max(2, nh, h.vertices.count()))))
    into = (hash32(F.col("h")) % top + 1).cast("long")
    out = (hash32(F.col("h") + nh) % top + 1).cast("long")
    return HyperGraph(h.v2h.select("v", "h", into.alias("w")), h.h2v.select("h", "v", out.alias("w")), h.vertices, h.hyperedges)
