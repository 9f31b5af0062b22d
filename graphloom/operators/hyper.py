"""Hypergraph operators: every step alternates between vertices and hyperedges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.exprs import umod
from graphloom.graph import HyperGraph, PropertyGraph
from graphloom.operators import traverse
from graphloom.plans.rounds import Rounds


def vertex_prop(h: HyperGraph, frontier: DataFrame, msg: Column, combine=F.min) -> DataFrame:
    """(id, msg) at hyperedges: messages of the frontier's vertices (column v)."""
    return h.v2h.join(frontier.withColumnRenamed("id", "v"), "v").groupBy(F.col("h").alias("id")).agg(combine(msg).alias("msg"))


def hyperedge_prop(h: HyperGraph, frontier: DataFrame, msg: Column, combine=F.min) -> DataFrame:
    """(id, msg) at vertices: messages of the frontier's hyperedges (column h)."""
    return h.h2v.join(frontier.withColumnRenamed("id", "h"), "h").groupBy(F.col("v").alias("id")).agg(combine(msg).alias("msg"))


def _sides(found: DataFrame, **columns: Column) -> DataFrame:
    """From ids of the bipartite form (hyperedge h is -1 - h) to side and id."""
    edge = F.col("id") < 0
    return found.select(F.when(edge, "H").otherwise("V").alias("side"), F.when(edge, -1 - F.col("id")).otherwise(F.col("id")).alias("id"), *[c.alias(k) for k, c in columns.items()])


def hyper_bfs(h: HyperGraph, source: int) -> DataFrame:
    """side, id, level, parent: levels count both kinds of steps; a parent is on the other side."""
    found = traverse.bfs(h.bipartite(), source)
    p = F.col("parent")
    return _sides(found, level=F.col("level"), parent=F.when(F.col("level") == 0, p).when(p < 0, -1 - p).otherwise(p))


def hyper_cc(h: HyperGraph) -> DataFrame:
    """side, id, label: the smallest vertex that reaches it; null for hyperedges that none reaches."""
    rounds, across = Rounds(h.v2h.sparkSession, "hyper-cc"), Rounds(h.v2h.sparkSession, "hyper-cc-edges")
    state, _ = rounds.cut(h.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("moved")))
    edges, _ = across.cut(h.hyperedges.select("id", F.lit(None).cast("long").alias("label"), F.lit(False).alias("moved")))
    while True:
        up = vertex_prop(h, state.filter("moved").select("id", "label"), F.col("label"))
        new = edges.join(up, "id", "left").select("id", F.least("label", "msg").alias("now"), "label")
        edges, _ = across.cut(new.select("id", F.col("now").alias("label"), (F.col("now").isNotNull() & (F.col("label").isNull() | (F.col("now") < F.col("label")))).alias("moved")))
        down = hyperedge_prop(h, edges.filter("moved").select("id", "label"), F.col("label"))
        new = state.join(down, "id", "left").select("id", F.least("label", "msg").alias("now"), "label")
        state, seen = rounds.cut(new.select("id", F.col("now").alias("label"), (F.col("now") < F.col("label")).alias("moved")), moved=F.col("moved"))
        if not seen["moved"]:
            return state.select(F.lit("V").alias("side"), "id", "label").unionByName(edges.select(F.lit("H").alias("side"), "id", "label"))


def hyper_sssp(h: HyperGraph, source: int) -> DataFrame:
    """side, id, dist with the weight of each incidence (1 without weights)."""
    weight = lambda df: F.col("w") if "w" in df.columns else F.lit(1)
    other = -1 - F.col("h")
    edges = h.v2h.select(F.col("v").alias("src"), other.alias("dst"), weight(h.v2h).alias("w")).unionByName(h.h2v.select(other.alias("src"), F.col("v").alias("dst"), weight(h.h2v).alias("w")))
    found = traverse.sssp(PropertyGraph(h.bipartite().vertices, edges), source, "w")
    return _sides(found, dist=F.col("dist"))


def hyper_bpath(h: HyperGraph, source: int) -> DataFrame:
    """side, id, reached: a hyperedge fires once all of its in-members are reached."""
    rounds = Rounds(h.v2h.sparkSession, "bpath")
    spark = h.v2h.sparkSession
    need = rounds.keep(h.v2h.groupBy(F.col("h").alias("id")).agg(F.count("*").alias("need")), "need")
    reached, _ = rounds.cut(spark.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0).alias("round")))
    fired = rounds.keep(spark.range(0).select("id"), "fired0")
    r = 0
    while True:
        r += 1
        seen = h.v2h.join(reached.select(F.col("id").alias("v")), "v", "left_semi").groupBy(F.col("h").alias("id")).agg(F.count("*").alias("got"))
        fired = rounds.keep(seen.join(need, "id").filter("got = need").select("id"), f"fired{r}")
        next_ = h.h2v.join(fired.select(F.col("id").alias("h")), "h", "left_semi").select(F.col("v").alias("id")).distinct()
        next_ = next_.join(reached, "id", "left_anti").select("id", F.lit(r).alias("round"))
        reached, new = rounds.cut(reached.unionByName(next_), new=F.col("round") == r)
        if not new["new"]:
            break
    v = h.vertices.join(reached.select("id", F.lit(True).alias("x")), "id", "left").select(F.lit("V").alias("side"), "id", F.coalesce("x", F.lit(False)).alias("reached"))
    e = h.hyperedges.join(fired.select("id", F.lit(True).alias("x")), "id", "left").select(F.lit("H").alias("side"), "id", F.coalesce("x", F.lit(False)).alias("reached"))
    return v.unionByName(e)


def hyper_pagerank(h: HyperGraph, iters: int = 1, damping: float = 0.85, entropy: bool = False) -> DataFrame:
    """side, id, rank; with ``entropy`` side, id, rank, entropy (hyperedges only)."""
    rounds, n = Rounds(h.v2h.sparkSession, "hyper-rank"), h.vertices.count()
    dv = h.v2h.groupBy("v").agg(F.count("*").alias("deg"))
    dh = h.h2v.groupBy("h").agg(F.count("*").alias("deg"))
    state, _ = rounds.cut(h.vertices.select("id", F.lit(1.0 / max(1, n)).alias("rank")))
    edges = h.hyperedges.select("id", F.lit(0.0).alias("rank"))
    for i in range(iters):
        up = vertex_prop(h, state.join(dv, state.id == dv.v).select("id", "rank", "deg"), F.col("rank") / F.col("deg"), F.sum)
        edges = rounds.keep(h.hyperedges.join(up, "id", "left").select("id", F.coalesce("msg", F.lit(0.0)).alias("rank")), f"h{i}")
        down = hyperedge_prop(h, edges.join(dh, edges.id == dh.h).select("id", "rank", "deg"), F.col("rank") / F.col("deg"), F.sum)
        state, _ = rounds.cut(h.vertices.join(down, "id", "left").select("id", (damping * F.coalesce("msg", F.lit(0.0)) + F.lit((1 - damping) / n)).alias("rank")))
    out = state.select(F.lit("V").alias("side"), "id", "rank").unionByName(edges.select(F.lit("H").alias("side"), "id", "rank"))
    if not entropy:
        return out
    share = F.col("pv") / F.col("ph")
    terms = h.v2h.join(state.select(F.col("id").alias("v"), F.col("rank").alias("pv")), "v").join(edges.select(F.col("id").alias("h"), F.col("rank").alias("ph")), "h")
    sums = terms.groupBy(F.col("h").alias("id")).agg(F.sum(share * -F.log2(share)).alias("entropy")).withColumn("side", F.lit("H"))
    return out.join(sums, ["side", "id"], "left")


def hyper_bc(h: HyperGraph, source: int) -> DataFrame:
    """id, paths, dependency of each vertex; a path counts once for every hyperedge route."""
    spark, rounds = h.v2h.sparkSession, Rounds(h.v2h.sparkSession, "hyper-bc")
    g = h.bipartite()
    levels = rounds.keep(traverse.bfs(g, source).filter("level is not null").select("id", "level"), "levels")
    depth = levels.agg(F.max("level").alias("m")).first()["m"]
    a, b = levels.select(F.col("id").alias("src"), F.col("level").alias("ls")), levels.select(F.col("id").alias("dst"), F.col("level").alias("ld"))
    dag = rounds.keep(g.edges.join(a, "src").join(b, "dst").filter("ld = ls + 1").select("src", "dst", "ls"), "dag")
    paths = spark.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(1.0).alias("paths"), F.lit(0).alias("level"))
    for r in range(depth):
        got = dag.filter(F.col("ls") == r).join(paths.filter(F.col("level") == r).select(F.col("id").alias("src"), "paths"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        paths, _ = rounds.cut(paths.unionByName(got.withColumn("level", F.lit(r + 1))))
    paths = rounds.keep(paths, "paths")
    # vertices hold 1 + their own sum at the time they pass it on; hyperedges hold sums only
    top = depth - depth % 2
    dep = paths.filter(F.col("level") == top).select("id", F.lit(1.0).alias("dependency"), "level")
    for r in range(top - 1, -1, -1):
        into_edges = bool(r % 2)
        got = dep.filter(F.col("level") == r + 1).join(paths.select("id", "paths"), "id")
        got = got.select(F.col("id").alias("dst"), (F.col("dependency") / F.col("paths") if into_edges else F.col("dependency")).alias("x"))
        sums = dag.filter(F.col("ls") == r).join(got, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("x"))
        mine = paths.filter(F.col("level") == r).join(sums, "id", "left")
        x = F.coalesce("x", F.lit(0.0))
        mine = mine.select("id", (x if into_edges else x * F.col("paths") + (0.0 if r == 0 else 1.0)).alias("dependency"), "level")
        dep, _ = rounds.cut(dep.unionByName(mine))
    found = paths.filter("id >= 0").join(dep.select("id", "dependency"), "id")
    return h.vertices.join(found, "id", "left").select("id", "paths", "dependency")


def hyper_kcore(h: HyperGraph) -> DataFrame:
    """id, core: with a vertex all its hyperedges go, and their other members lose them."""
    rounds = Rounds(h.v2h.sparkSession, "hyper-core")
    inc = rounds.keep(h.v2h.select("v", "h").distinct(), "inc0")
    state, _ = rounds.cut(h.vertices.select("id", F.lit(None).cast("long").alias("core")))
    k, i = 1, 0
    while True:
        deg = inc.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("d"))
        open_ = state.filter("core is null").join(deg, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
        low = open_.agg(F.min("d").alias("m")).first()["m"]
        if low is None:
            return state
        k = max(k, low + 1)  # empty levels in between change nothing
        gone = rounds.keep(open_.filter(F.col("d") < k).select("id"), f"gone{i}")
        dead = inc.join(gone.select(F.col("id").alias("v")), "v", "left_semi").select("h").distinct()
        i += 1
        inc = rounds.keep(inc.join(dead, "h", "left_anti").select("v", "h"), f"inc{i}")
        state, _ = rounds.cut(state.join(gone.withColumn("_c", F.lit(k - 1).cast("long")), "id", "left").select("id", F.coalesce("core", "_c").alias("core")))


def hyper_mis(h: HyperGraph, seed: int = 0, inverse_prob: int = 3) -> DataFrame:
    """id, in_set: no hyperedge of two or more members lies wholly inside, and no vertex can be added.

    Each round samples undecided vertices by hash, takes back those of hyperedges that would be
    filled, and drops chosen members from the hyperedges; a hyperedge left with one undecided
    member rules that member out.
    """
    rounds = Rounds(h.v2h.sparkSession, "hyper-mis")
    inc = rounds.keep(h.h2v.select("h", "v").distinct(), "inc0")
    lone = inc.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    inc = rounds.keep(inc.join(lone.select("h"), "h", "left_semi"), "inc1")  # one member never fills a pair
    state, seen = rounds.cut(h.vertices.select("id", F.lit(None).cast("boolean").alias("in_set")), open=F.lit(True))
    r, offset = 1, seed
    while seen["open"]:
        open_ = state.filter("in_set is null").select("id")
        picked = rounds.keep(open_.filter(umod(F.xxhash64("id", F.lit(offset)), inverse_prob) == 0), f"picked{r}")
        offset += seen["open"]
        mine = inc.join(picked.select(F.col("id").alias("v"), F.lit(1).alias("p")), "v", "left")
        full = mine.groupBy("h").agg(F.count("*").alias("n"), F.count("p").alias("m")).filter("n = m").select("h")
        back = inc.join(full, "h", "left_semi").select(F.col("v").alias("id")).distinct()
        # who is in no open hyperedge can't fill one
        free = open_.join(inc.select(F.col("v").alias("id")), "id", "left_anti")
        chosen = rounds.keep(picked.join(back, "id", "left_anti").unionByName(free).distinct().withColumn("_in", F.lit(True)), f"chosen{r}")
        left = inc.join(chosen.select(F.col("id").alias("v")), "v", "left_anti")
        left = rounds.keep(left.select("h", "v"), f"left{r}")
        sizes = left.groupBy("h").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        out = sizes.filter("n = 1").select(F.col("v").alias("id")).distinct().withColumn("_out", F.lit(False))
        # a hyperedge with a vertex that is out can't be filled any more
        gone = left.join(out.select(F.col("id").alias("v")), "v", "left_semi").select("h").distinct()
        r += 1
        inc = rounds.keep(left.join(gone, "h", "left_anti").select("h", "v"), f"inc{r}")
        state, seen = rounds.cut(state.join(chosen, "id", "left").join(out, "id", "left").select("id", F.coalesce("in_set", "_in", "_out").alias("in_set")), open=F.col("in_set").isNull())
    return state


def hyper_degrees(h: HyperGraph) -> DataFrame:
    """side, id, deg: what the adjacency dumps show."""
    v = h.vertices.join(h.v2h.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("d")), "id", "left").select(F.lit("V").alias("side"), "id", F.coalesce("d", F.lit(0)).alias("deg"))
    e = h.hyperedges.join(h.h2v.groupBy(F.col("h").alias("id")).agg(F.count("*").alias("d")), "id", "left").select(F.lit("H").alias("side"), "id", F.coalesce("d", F.lit(0)).alias("deg"))
    return v.unionByName(e)


def hyper_dump(h: HyperGraph) -> DataFrame:
    """side, id, members: adjacency of both sides as text, sorted; ``member:weight`` where there are weights."""

    def side(pairs: DataFrame, name: str, own: str, other: str) -> DataFrame:
        weighted = "w" in pairs.columns
        member = F.struct(other, *(["w"] if weighted else []))
        text = lambda x: F.concat_ws(":", x[other], *([x["w"]] if weighted else []))
        rows = pairs.groupBy(F.col(own).alias("id")).agg(F.sort_array(F.collect_list(member)).alias("m"))
        return rows.select(F.lit(name).alias("side"), "id", F.array_join(F.transform("m", text), " ").alias("members"))

    return side(h.v2h, "V", "v", "h").unionByName(side(h.h2v, "H", "h", "v"))
