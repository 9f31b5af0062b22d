"""Vertex reordering: every function returns a permutation (old_id, new_id)."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.primitives import ranks
from graphloom.plans.inside import in_components, labelled, starts
from graphloom.store import Scratch


def partition_size(n: int, part_kb: int = 512, threads: int = 4) -> tuple[int, int]:
    """Vertices in a partition, a power of two, and the number of partitions."""
    size = min(part_kb * 1024 // 4, n // (4 * threads))
    size = 1 << (size.bit_length() - 1) if size else 4
    return size, (n - 1) // size + 1


def _hubs(g: PropertyGraph) -> tuple[DataFrame, int]:
    """id, deg, hub: more out-edges than the whole-number average; and that average."""
    avg = g.edges.count() // max(1, g.vertices.count())
    deg = g.degrees().select("id", F.col("out_deg").alias("deg"))
    return deg.withColumn("hub", F.col("deg") > avg), avg


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    return ranks(df, *order, name="new_id").select(F.col("id").alias("old_id"), "new_id")


def order_sort(g: PropertyGraph) -> DataFrame:
    """By out-degree, then id, both descending."""
    return _numbered(_hubs(g)[0], F.col("deg").desc(), F.col("id").desc())


def order_hc(g: PropertyGraph) -> DataFrame:
    """Hubs first, both groups in id order."""
    return _numbered(_hubs(g)[0], F.col("hub").desc(), F.col("id"))


def dbg_level(deg: Column, avg: int, levels: int = 8) -> Column:
    level = F.lit(levels - 1)
    for j in range(levels - 2, -1, -1):
        level = F.when(deg <= int(avg * 2.0 ** (j - 1)), F.lit(j)).otherwise(level)
    return level


def order_dbg(g: PropertyGraph) -> DataFrame:
    """Eight degree groups, doubling from half the average; high groups first, id order inside."""
    deg, avg = _hubs(g)
    return _numbered(deg.withColumn("level", dbg_level(F.col("deg"), avg)), F.col("level").desc(), F.col("id"))


def order_fbc(g: PropertyGraph) -> DataFrame:
    """Hubs by degree and id, descending; the others in id order after them."""
    deg, _ = _hubs(g)
    return _numbered(deg, F.col("hub").desc(), F.when(F.col("hub"), -F.col("deg")).otherwise(F.lit(0)), F.when(F.col("hub"), -F.col("id")).otherwise(F.col("id")))


def order_corder(g: PropertyGraph, part_kb: int = 512, threads: int = 4) -> DataFrame:
    """Every partition but the last ones gets the same number of hubs, then of cold vertices."""
    size, parts = partition_size(g.vertices.count(), part_kb, threads)
    deg, _ = _hubs(g)
    placed = ranks(deg, F.col("hub").desc(), F.col("id"), name="r")
    total = placed.agg(F.count("*").alias("n"), F.count_if("hub").alias("h")).first()
    hubs, cold = total["h"], total["n"] - total["h"]
    per_hub = -(-hubs // parts)
    per_cold = size - per_hub
    last = parts - 1
    while per_hub * last > hubs or per_cold * last > cold:
        last -= 1
    i, tail = F.when(F.col("hub"), F.col("r")).otherwise(F.col("r") - hubs), last * size
    hub_new = F.when(i < per_hub * last, F.floor(i / max(1, per_hub)) * size + i % max(1, per_hub)).otherwise(tail + i - per_hub * last)
    cold_new = F.when(i < per_cold * last, F.floor(i / max(1, per_cold)) * size + per_hub + i % max(1, per_cold)).otherwise(tail + (hubs - per_hub * last) + i - per_cold * last)
    return placed.select(F.col("id").alias("old_id"), F.when(F.col("hub"), hub_new).otherwise(cold_new).cast("long").alias("new_id"))


def order_clusters(g: PropertyGraph, clusters: DataFrame) -> DataFrame:
    """Clusters one after the other, id order inside. ``clusters``: id, cluster."""
    return _numbered(clusters.select("id", "cluster"), F.col("cluster"), F.col("id"))


def order_balanced(g: PropertyGraph, clusters: DataFrame, part_kb: int = 512, threads: int = 4) -> DataFrame:
    """Clusters dealt over partitions: hubs and left-over cold vertices round robin, cold vertices in
    equal runs, what doesn't fit into the last partition.

    A partition is full once as many vertices as it holds were offered to it, and the number of offers
    before a vertex follows from its rank and from the sizes of the clusters before: no task deals.
    """
    size, parts = partition_size(g.vertices.count(), part_kb, threads)
    if parts < 2:
        raise ValueError("needs two partitions or more")
    ring = parts - 1
    deg, _ = _hubs(g)
    rows = ranks(clusters.select("id", "cluster").join(deg, "id").select("id", "cluster", "hub"), F.col("cluster"), F.col("hub").desc(), F.col("id"), name="r")
    sizes = rows.groupBy("cluster").agg(F.count_if("hub").alias("hubs"), F.count_if(~F.col("hub")).alias("cold")).withColumn("run", F.floor(F.col("cold") / ring))
    w = Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)  # one row a cluster
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    turns = F.col("hubs") + F.col("cold") % ring
    sizes = sizes.select("cluster", "hubs", "run", turns.alias("turns"), before(F.col("hubs") + F.col("cold")).alias("start"), before(turns).alias("turn"), before(F.col("run")).alias("runs"))
    end = sizes.agg(F.sum("turns").alias("turns"), F.sum("run").alias("runs")).first()
    turn, runs, run = F.col("turn"), F.col("runs"), F.col("run")
    i = F.col("r") - F.col("start") - F.when(F.col("hub"), 0).otherwise(F.col("hubs"))
    t = F.when(F.col("hub"), turn + i).otherwise(turn + F.col("hubs") + i - run * ring)
    in_run = ~F.col("hub") & (i < run * ring)
    run_bin = F.floor(i / F.greatest(run, F.lit(1)))
    offers = F.floor((turn + F.col("hubs") + ring - 1 - run_bin) / ring) + runs + i % F.greatest(run, F.lit(1))
    placed = rows.join(sizes, "cluster").select(
        "id", "r",
        F.when(in_run, run_bin).otherwise(t % ring).alias("bin"),
        F.when(in_run, offers).otherwise(F.floor(t / ring) + runs + F.when(F.col("hub"), 0).otherwise(run)).alias("at"),
    )
    turns, runs = int(end["turns"] or 0), int(end["runs"] or 0)
    few, extra = min(size, turns // ring + runs), turns % ring
    more = min(size, turns // ring + runs + 1) - few
    first = F.col("bin") * few + F.least("bin", F.lit(extra)) * more
    fits = placed.filter(F.col("at") < size).select(F.col("id").alias("old_id"), (first + F.col("at")).cast("long").alias("new_id"))
    rest = ranks(placed.filter(F.col("at") >= size).select("id", "r"), F.col("r"), name="k")
    return fits.unionByName(rest.select(F.col("id").alias("old_id"), (F.col("k") + ring * few + extra * more).cast("long").alias("new_id")))


def order_map(perm: DataFrame) -> DataFrame:
    """A permutation from elsewhere, checked to be a bijection on 0 to n - 1."""
    seen = perm.agg(F.count("*").alias("n"), F.countDistinct("old_id").alias("o"), F.countDistinct("new_id").alias("w"), F.min(F.least("old_id", "new_id")).alias("lo"), F.max(F.greatest("old_id", "new_id")).alias("hi")).first()
    if seen["n"] and not (seen["n"] == seen["o"] == seen["w"] and seen["lo"] == 0 and seen["hi"] == seen["n"] - 1):
        raise ValueError("not a permutation")
    return perm.select("old_id", "new_id")


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """The permutation that applies ``first``, then ``second``."""
    b = second.select(F.col("old_id").alias("mid"), F.col("new_id").alias("end"))
    return first.join(b, first.new_id == b.mid).select("old_id", F.col("end").alias("new_id"))


def _finished(g: PropertyGraph, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with old_id) as a table, and the vertices that aren't among them."""
    rows = Scratch(g.edges.sparkSession, "order").table(rows, "rows")
    return rows, g.vertices.join(rows.select(F.col("old_id").alias("id")), "id", "left_anti")


#: Vertices of a component up to which the greedy order looks for the best one by a scan of all scores.
SCAN = 1 << 20


def order_gorder(g: PropertyGraph, window: int = 5, labels: DataFrame | None = None, scan: int = SCAN) -> DataFrame:
    """Greedy locality order: next comes the vertex with most common in-neighbours and links to the
    last ``window`` ones; ties go to the smaller id.  Vertices of more than sqrt(n) out-edges
    don't spread their scores; isolated vertices go before the last one.

    Where no vertex has a score, the order begins anew from the open vertex of most in-edges.  Such a
    run never leaves its component and depends on no other one, so components are ordered in
    tasks of their own, and all runs follow one another by their first vertices.  ``labels``: id, label
    of the ends of edges, where they are known.
    """
    limit = g.vertices.count() ** 0.5

    def run(ids, src, dst, w, label):
        n, by = len(ids), np.argsort(dst, kind="stable")
        out_at, in_at, into = starts(src, n), starts(dst, n), src[by]
        outdeg, indeg = np.diff(out_at), np.diff(in_at)
        if n <= scan:
            return scanned(ids, dst, out_at, in_at, into, outdeg, indeg)
        score, placed = np.zeros(n, np.int64), np.zeros(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}  # by score: vertices that came to it, checked when it is the highest
        held: dict[int, int] = {}
        heaps: dict[int, list[int]] = {}
        top, recent = 0, deque()
        rest = iter(np.lexsort((np.arange(n), -indeg)).tolist())
        order, firsts, first = [], [], -1

        def now(s: int) -> np.ndarray:
            found = np.concatenate(waiting.pop(s))
            return np.unique(found[(score[found] == s) & ~placed[found]])

        def push(us: np.ndarray) -> int:
            us = us[~placed[us] & (score[us] > 0)]
            if not len(us):
                return 0
            us = us[np.argsort(score[us], kind="stable")]
            s = score[us]
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                k = int(s[a])
                waiting.setdefault(k, []).append(us[a:b])
                held[k] = held.get(k, 0) + b - a
                if held[k] > 4 * n + 4096:
                    waiting[k] = [now(k)]
                    held[k] = len(waiting[k][0])
            return int(s[-1])

        for _ in range(n):
            v = -1
            while top > 0 and v < 0:
                heap = heaps.setdefault(top, [])
                if top in waiting:
                    fresh = now(top).tolist()
                    held[top] = 0
                    if heap:
                        for u in fresh:
                            heapq.heappush(heap, u)
                    else:
                        heap.extend(fresh)
                while heap and v < 0:
                    u = heapq.heappop(heap)
                    if not placed[u] and score[u] == top:
                        v = u
                if v < 0:
                    del heaps[top]
                    top -= 1
            if v < 0:
                v = first = next(u for u in rest if not placed[u])
            placed[v] = True
            order.append(v)
            firsts.append(first)
            back = into[in_at[v] : in_at[v + 1]]
            fan = back[outdeg[back] <= limit]
            size = outdeg[fan]
            cells = np.repeat(out_at[fan] - np.cumsum(size) + size, size) + np.arange(size.sum())
            us, by_ = np.unique(np.concatenate([dst[out_at[v] : out_at[v + 1]], back, dst[cells]]), return_counts=True)
            score[us] += by_
            top = max(top, push(us))
            recent.append((us, by_))
            if len(recent) > window:
                us, by_ = recent.popleft()
                score[us] -= by_
                push(us)
        firsts = np.array(firsts)
        return [ids[order], -indeg[firsts], ids[firsts], np.arange(n)]

    def scanned(ids, dst, out_at, in_at, into, outdeg, indeg):
        """The same order: scores in one array, placed vertices far below all others."""
        n = len(ids)
        score, recent, order, firsts, first = np.zeros(n, np.int32), deque(), [], [], -1
        rest = iter(np.lexsort((np.arange(n), -indeg)).tolist())
        spreads = outdeg <= limit
        for _ in range(n):
            v = int(score.argmax())  # of equals the first
            if score[v] <= 0:
                v = first = next(u for u in rest if score[u] >= 0)
            score[v] -= 1 << 30
            order.append(v)
            firsts.append(first)
            back = into[in_at[v] : in_at[v + 1]]
            fan = back[spreads[back]]
            size = outdeg[fan]
            ends = size.cumsum()
            cells = np.arange(ends[-1] if len(ends) else 0) + np.repeat(out_at[fan] - ends + size, size)
            us = np.concatenate([dst[out_at[v] : out_at[v + 1]], back, dst[cells]])
            np.add.at(score, us, 1)
            recent.append(us)
            if len(recent) > window:
                np.add.at(score, recent.popleft(), -1)
        firsts = np.array(firsts)
        return [ids[order], -indeg[firsts], ids[firsts], np.arange(n)]

    rows, lone = _finished(g, in_components(labelled(g.edges.select("src", "dst"), labels), run, "old_id long, key long, first long, k long"))
    placed = rows.count()
    lone = Scratch(g.edges.sparkSession, "lone").table(lone, "lone")
    end = max(0, placed - 1)
    at = F.when(F.col("r") == end, F.col("r") + lone.count()).otherwise(F.col("r"))
    out = ranks(rows, F.col("key"), F.col("first"), F.col("k"), name="r").select("old_id", at.alias("new_id"))
    return out.unionByName(ranks(lone, F.col("id"), name="r").select(F.col("id").alias("old_id"), (F.col("r") + end).alias("new_id")))


def order_rcm(g: PropertyGraph, labels: DataFrame | None = None) -> DataFrame:
    """Reverse Cuthill-McKee by total degree; ties go to the smaller id.

    The searches from one start after the other never leave a component, so components are searched
    in tasks of their own, and all searches follow one another by their starts.
    """

    def run(ids, src, dst, w, label):
        n = len(ids)
        at = starts(src, n)
        deg = np.bincount(src, minlength=n) + np.bincount(dst, minlength=n)
        seen, order, firsts = np.zeros(n, bool), [], []
        for first in np.lexsort((np.arange(n), deg)).tolist():
            if seen[first]:
                continue
            seen[first] = True
            queue = deque([first])
            while queue:
                v = queue.popleft()
                order.append(v)
                firsts.append(first)
                fresh = dst[at[v] : at[v + 1]]
                fresh = np.unique(fresh[~seen[fresh]])
                seen[fresh] = True
                queue.extend(fresh[np.argsort(deg[fresh], kind="stable")].tolist())
        return [ids[order], deg[firsts], ids[firsts], np.arange(n)]

    rows, lone = _finished(g, in_components(labelled(g.edges.select("src", "dst"), labels), run, "old_id long, key long, first long, k long"))
    zero = F.lit(0).cast("long")
    rows = Scratch(g.edges.sparkSession, "rcm").table(rows.unionByName(lone.select(F.col("id").alias("old_id"), zero.alias("key"), F.col("id").alias("first"), zero.alias("k"))), "all")
    last = g.vertices.count() - 1
    return ranks(rows, F.col("key"), F.col("first"), F.col("k"), name="r").select("old_id", (F.lit(last) - F.col("r")).alias("new_id"))


def order_rcm_gorder(g: PropertyGraph, window: int = 5) -> DataFrame:
    """RCM first, then the greedy order on its result; both permutations are composed."""
    first = Scratch(g.edges.sparkSession, "rcm").table(order_rcm(g), "perm")
    return compose(first, order_gorder(g.relabel(first), window))


def rabbit_adjacency(g: PropertyGraph) -> DataFrame:
    """src, dst, w: both directions, no loops, weights of parallel edges added up."""
    w = F.col("w") if g.weighted else F.lit(1)
    both = g.edges.select("src", "dst", w.cast("double").alias("w")).filter("src <> dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def rabbit(g: PropertyGraph, labels: DataFrame | None = None) -> DataFrame:
    """id, community, new_id: vertices in ascending degree join the neighbour that gains most
    modularity, w(v, u) - str(v) str(u) / W, if that is positive; communities are numbered by a
    walk down their merge trees.

    Vertices only join inside their component; components are worked on in tasks of their own."""
    edges = Scratch(g.edges.sparkSession, "rabbit").table(rabbit_adjacency(g), "edges")
    total = edges.agg(F.sum("w").alias("w")).first()["w"] or 0.0

    def run(ids, src, dst, w, label):
        n = len(ids)
        at, strength = starts(src, n).tolist(), np.bincount(src, w, n).tolist()
        near: dict[int, dict[int, float]] = {}  # of open vertices that others joined; those of the rest are read as they come
        top, children, done = list(range(n)), [[] for _ in range(n)], [False] * n

        def own(v: int) -> dict[int, float]:
            return dict(zip(dst[at[v] : at[v + 1]].tolist(), w[at[v] : at[v + 1]].tolist(), strict=True))

        def root(v: int) -> int:
            while top[v] != v:
                top[v] = top[top[v]]
                v = top[v]
            return v

        for v in np.lexsort((np.arange(n), np.diff(at))).tolist():
            merged: dict[int, float] = {}
            for u, x in (near.pop(v) if v in near else own(v)).items():
                if (r := root(u)) != v:
                    merged[r] = merged.get(r, 0.0) + x
            done[v] = True
            best = max(((x - strength[v] * strength[u] / total, -u) for u, x in merged.items()), default=(0.0, 0))
            if best[0] > 0:
                u = -best[1]
                top[v] = u
                strength[u] += strength[v]
                children[u].append(v)
                if not done[u]:
                    theirs = near.setdefault(u, None) or own(u)
                    for y, x in merged.items():
                        theirs[y] = theirs.get(y, 0.0) + x
                    near[u] = theirs
        order, roots = [], []
        for c in (v for v in range(n) if top[v] == v):
            todo = [c]
            while todo:
                v = todo.pop()
                order.append(v)
                roots.append(c)
                todo.extend(children[v])
        return [ids[order], ids[roots], np.arange(n)]

    rows, lone = _finished(g, in_components(labelled(edges, labels), run, "old_id long, community long, k long"))
    rows = rows.unionByName(lone.select(F.col("id").alias("old_id"), F.col("id").alias("community"), F.lit(0).cast("long").alias("k")))
    rows = Scratch(g.edges.sparkSession, "rabbit").table(rows, "all")
    return ranks(rows, F.col("community"), F.col("k"), name="new_id").select(F.col("old_id").alias("id"), "community", "new_id")


def order_rabbit(g: PropertyGraph, labels: DataFrame | None = None) -> DataFrame:
    return rabbit(g, labels).select(F.col("id").alias("old_id"), "new_id")
