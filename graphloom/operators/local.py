"""Local clustering around a seed, and the sweep cut over its result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.exprs import hash32, hash32_int
from graphloom.graph import PropertyGraph
from graphloom.plans.rounds import Rounds


def _weighted_arcs(g: PropertyGraph) -> DataFrame:
    deg = g.edges.groupBy("src").agg(F.count("*").alias("deg"))
    return g.edges.select("src", "dst").join(deg, "src").repartition("src").persist()


def _degrees(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("src").alias("id"), "deg").distinct()


def _seed(g: PropertyGraph, seed_id: int) -> DataFrame:
    return g.edges.sparkSession.range(1).select(F.lit(seed_id).cast("long").alias("id"))


def pr_nibble(g: PropertyGraph, seed_id: int, alpha: float = 0.15, eps: float = 1e-9, optimised: bool = False, max_iter: int = 10_000) -> DataFrame:
    """id, mass, residual: synchronous pushes of every vertex whose residual is above eps x degree."""
    rounds, arcs = Rounds(g.edges.sparkSession, "nibble-pr"), _weighted_arcs(g)
    deg = rounds.keep(_degrees(arcs), "deg")
    keep, spread = (2 * alpha / (1 + alpha), (1 - alpha) / (1 + alpha)) if optimised else (alpha, (1 - alpha) / 2)
    stay = 0.0 if optimised else (1 - alpha) / 2
    state, seen = rounds.cut(_seed(g, seed_id).join(deg, "id").select("id", "deg", F.lit(0.0).alias("mass"), F.lit(1.0).alias("residual"), F.lit(True).alias("on")), on=F.col("on"))
    for _ in range(max_iter):
        if not seen["on"]:
            break
        front = state.filter("on").select(F.col("id").alias("src"), "residual")
        sent = arcs.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(spread * F.col("residual") / F.col("deg")).alias("s"))
        sent = sent.join(deg.withColumnRenamed("deg", "d2"), "id")
        new = state.join(sent, "id", "full")
        zero, r, on = F.lit(0.0), F.coalesce("residual", F.lit(0.0)), F.coalesce("on", F.lit(False))
        left = F.when(on, stay * r).otherwise(r) + F.coalesce("s", zero)
        d = F.coalesce("deg", "d2")
        new = new.select("id", d.alias("deg"), (F.coalesce("mass", zero) + F.when(on, keep * r).otherwise(zero)).alias("mass"), left.alias("residual"))
        state, seen = rounds.cut(new.withColumn("on", F.col("residual") > eps * F.col("deg")), on=F.col("on"))
    arcs.unpersist()
    return state.select("id", "mass", "residual")


def nibble(g: PropertyGraph, seed_id: int, T: int = 10, eps: float = 1e-9) -> DataFrame:
    """id, mass: T steps of a lazy walk; what falls below eps x degree stops moving and is dropped."""
    rounds, arcs = Rounds(g.edges.sparkSession, "nibble"), _weighted_arcs(g)
    deg = rounds.keep(_degrees(arcs), "deg")
    state, _ = rounds.cut(_seed(g, seed_id).select("id", F.lit(1.0).alias("mass"), F.lit(True).alias("on")))
    for _ in range(T):
        front = state.filter("on")
        moved = arcs.join(front.select(F.col("id").alias("src"), "mass"), "src").select(F.col("dst").alias("id"), (F.col("mass") / (2 * F.col("deg"))).alias("m"))
        stay = front.select("id", (F.col("mass") / 2).alias("m"))
        sums = moved.unionByName(stay).groupBy("id").agg(F.sum("m").alias("mass"))
        state, seen = rounds.cut(sums.join(deg, "id").select("id", "mass", (F.col("mass") >= eps * F.col("deg")).alias("on")), on=F.col("on"))
        if not seen["on"]:
            break
    arcs.unpersist()
    return state.select("id", "mass")


def heat_kernel(g: PropertyGraph, seed_id: int, t: float = 3.0, N: int = 1, eps: float = 1e-9) -> DataFrame:
    """id, mass: Taylor terms of the heat kernel up to degree N with thresholds by psi."""
    rounds, arcs = Rounds(g.edges.sparkSession, "heat"), _weighted_arcs(g)
    deg = rounds.keep(_degrees(arcs), "deg")
    psi = [sum(math.factorial(k) * t**m / math.factorial(m + k) for m in range(N - k)) for k in range(N)]
    limit = math.exp(t) * eps / (2 * N)
    r, _ = rounds.cut(_seed(g, seed_id).select("id", F.lit(1.0).alias("r"), F.lit(True).alias("on")))
    parts = []
    for j in range(N):
        parts.append(rounds.keep(r.filter("on").select("id", F.col("r").alias("x")), f"x{j}"))
        front = r.filter("on").select(F.col("id").alias("src"), "r")
        last = j + 1 == N
        share = (1.0 if last else t / (j + 1)) * F.col("r") / F.col("deg")
        sent = arcs.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(share).alias("r"))
        if last:
            parts.append(rounds.keep(sent.select("id", F.col("r").alias("x")), f"x{j + 1}"))
            break
        r, seen = rounds.cut(sent.join(deg, "id").select("id", "r", (F.col("r") >= limit / psi[j + 1] * F.col("deg")).alias("on")), on=F.col("on"))
        if not seen["on"]:
            break
    arcs.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("x").alias("mass"))


def heat_kernel_walks(g: PropertyGraph, seed_id: int, t: float = 3.0, K: int = 10, N: int = 10, seed: int = 42) -> DataFrame:
    """id, mass: share of N hashed walks, with Poisson lengths capped at K, that end there."""
    rounds = Rounds(g.edges.sparkSession, "walks")
    spark = g.edges.sparkSession
    order = Window.partitionBy("src").orderBy("dst")
    arcs = rounds.keep(g.edges.select("src", "dst").withColumn("k", F.row_number().over(order) - 1).withColumn("deg", F.count("*").over(Window.partitionBy("src"))), "arcs")
    probs = [math.exp(-t) * t**k / math.factorial(k) for k in range(K)]
    lengths = []
    for i in range(N):
        u, mass, n = hash32_int((seed + 2 * i) & 0xFFFFFFFF) / 0xFFFFFFFF, 0.0, 0
        while n < K:
            mass += probs[n]
            if u < mass:
                break
            n += 1
        lengths.append((i, seed_id, n, hash32_int((seed + 2 * i + 1) & 0xFFFFFFFF)))
    state, _ = rounds.cut(spark.createDataFrame(lengths, "walk long, id long, n int, h long"))
    for step in range(max(x[2] for x in lengths)):
        on = state.filter(F.col("n") > step)
        moved = on.join(arcs, (on.id == arcs.src) & (F.pmod(on.h, arcs.deg) == arcs.k)).select("walk", F.col("dst").alias("id"), "n", hash32(F.col("h")).alias("h"))
        state, _ = rounds.cut(state.filter(F.col("n") <= step).unionByName(moved))
    return state.groupBy("id").agg((F.count("*") / F.lit(N)).alias("mass"))


def sweep_cut(g: PropertyGraph, mass: DataFrame) -> DataFrame:
    """conductance, size_s, vol_s, vol, edges_crossing of the best prefix by mass over degree (ties: smaller id).

    Each edge inside the set opens at its first end and closes at its last one, so crossing counts
    are a running sum over ranks.  Ranks come from one window over the support of ``mass``, which
    local methods keep small.
    """
    deg = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    m = g.edges.count()
    order = Window.orderBy((F.col("mass") / F.col("deg")).desc(), "id")
    rounds = Rounds(g.edges.sparkSession, "sweep")
    ranked = rounds.keep(mass.join(deg, "id").withColumn("rank", F.row_number().over(order)), "ranked")
    a = ranked.select(F.col("id").alias("src"), F.col("rank").alias("ra"))
    b = ranked.select(F.col("id").alias("dst"), F.col("rank").alias("rb"))
    inside = g.edges.select("src", "dst").join(a, "src").join(b, "dst").filter("rb < ra").groupBy(F.col("ra").alias("rank")).agg(F.count("*").alias("back"))
    rows = ranked.join(inside, "rank", "left").select("rank", "deg", (F.col("deg") - 2 * F.coalesce("back", F.lit(0))).alias("gain"))
    upto = Window.orderBy("rank")
    rows = rows.select("rank", F.sum("deg").over(upto).alias("vol_s"), F.sum("gain").over(upto).alias("crossing"))
    denom = F.least(F.col("vol_s"), F.lit(m) - F.col("vol_s"))
    rows = rows.withColumn("conductance", F.when((F.col("crossing") == 0) | (denom == 0), F.lit(1.0)).otherwise(F.col("crossing") / denom))
    best = rows.agg(F.min(F.struct("conductance", "rank", "vol_s", "crossing")).alias("b"), F.max("vol_s").alias("vol"))
    return best.select(F.col("b.conductance").alias("conductance"), F.col("b.rank").cast("long").alias("size_s"), F.col("b.vol_s").alias("vol_s"), "vol", F.col("b.crossing").alias("edges_crossing"))
