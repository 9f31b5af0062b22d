"""Toy graphs with known answers, invariants, and properties under relabelling."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.exprs import hash32, hash32_int, hash64, hash64_int, umod
from graphloom.graph import HyperGraph, PropertyGraph
from graphloom.operators import cluster, convert, decompose, eccentricity, gas, generate, hyper, local, metrics, primitives, ranking, reorder, traverse


def graph(spark, n, pairs, symmetric=True, w=None):
    rows = [(a, b, *([w[i]] if w else [])) for i, (a, b) in enumerate(pairs)]
    edges = spark.createDataFrame(rows, "src long, dst long" + (", w long" if w else ""))
    g = PropertyGraph(spark.range(n), edges)
    return g.symmetrize() if symmetric else g


def column(df, value, key="id"):
    return [r[value] for r in df.orderBy(key).collect()]


@pytest.fixture(scope="module")
def path4(spark):
    return graph(spark, 4, [(0, 1), (1, 2), (2, 3)])


@pytest.fixture(scope="module")
def tailed(spark):
    return graph(spark, 4, [(0, 1), (1, 2), (0, 2), (2, 3)])


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(7)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(60)})
    return graph(spark, 42, pairs), pairs


def near(pairs, n):
    out = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def levels(adj, source):
    seen, front, d = {source: 0}, [source], 0
    while front:
        d += 1
        front = sorted({b for a in front for b in adj[a] if b not in seen})
        seen |= dict.fromkeys(front, d)
    return seen


def test_path(path4):
    assert column(eccentricity.ecc_exact(path4), "ecc") == [3, 2, 2, 3]
    assert column(eccentricity.ecc_tk(path4), "ecc") == [3, 2, 2, 3]
    assert column(decompose.kcore(path4), "core") == [1, 1, 1, 1]
    assert column(decompose.mis(path4), "in_set") == [True, False, True, False]
    assert column(decompose.triangles(path4), "count") == [0, 0, 0, 0]


def test_triangle_with_tail(tailed):
    assert sum(column(decompose.triangles(tailed), "count")) == 1
    assert column(decompose.kcore(tailed), "core") == [2, 2, 2, 1]
    assert column(decompose.mis(tailed), "in_set") == [True, False, False, True]


def test_components_and_direction(spark):
    g = graph(spark, 5, [(0, 1), (2, 3)])
    for f in (traverse.components, gas.gas_cc, traverse.bfs_cc, lambda g: traverse.components(g, shortcut=True)):
        assert column(f(g), "label") == [0, 0, 2, 2, 4]
    assert column(traverse.components(graph(spark, 3, [(0, 1), (1, 2)], symmetric=False)), "label") == [0, 0, 0]
    assert column(traverse.components(graph(spark, 3, [(2, 1), (1, 0)], symmetric=False)), "label") == [0, 1, 2]


def test_star_orders(spark):
    g = graph(spark, 5, [(0, i) for i in range(1, 5)])
    assert [r.old_id for r in reorder.order_sort(g).orderBy("new_id").collect()] == [0, 4, 3, 2, 1]
    assert [r.old_id for r in reorder.order_hc(g).orderBy("new_id").collect()] == [0, 1, 2, 3, 4]


def test_traversal_against_plain_python(random_graph):
    g, pairs = random_graph
    adj = near(pairs, 42)
    want = levels(adj, 3)
    got = {r.id: (r.level, r.parent) for r in traverse.bfs(g, 3).collect()}
    assert {v: x[0] for v, x in got.items() if x[0] is not None} == want
    assert all(x[1] == min(u for u in adj[v] if want.get(u) == x[0] - 1) for v, x in got.items() if x[0])
    assert got == {r.id: (r.level, r.parent) for r in gas.gas_bfs(g, 3).collect()}
    exact = {v: max(levels(adj, v).values()) for v in range(42)}
    assert {r.id: r.ecc for r in eccentricity.ecc_exact(g).collect()} == exact
    for estimate in (eccentricity.ecc_kbfs(g, least=5), eccentricity.ecc_fm(g), eccentricity.ecc_loglog(g), eccentricity.ecc_clrstv(g)):
        assert all(r.ecc <= exact[r.id] for r in estimate.collect())
    assert all(r.ecc <= 2 * exact[r.id] and exact[r.id] <= 2 * r.ecc for r in eccentricity.ecc_simple(g).collect())


def test_weighted_paths(spark):
    g = graph(spark, 5, [(0, 1), (1, 2), (0, 2), (2, 3)], w=[4, 1, 7, 2])
    for f in (lambda: traverse.sssp(g, 0, "w"), lambda: traverse.delta_stepping(g, 0, 3, "w"), lambda: gas.gas_sssp(g, 0)):
        assert column(f(), "dist") == [0, 4, 5, 7, None]
    with pytest.raises(ValueError):
        traverse.sssp(graph(spark, 2, [(0, 1), (1, 0)], symmetric=False, w=[-1, -1]), 0, "w")


def test_any_result_moves_with_its_labels(random_graph, spark):
    g, _ = random_graph
    perm = reorder.order_map(g.vertices.select(F.col("id").alias("old_id"), ((F.col("id") * 11 + 5) % 42).alias("new_id")))
    moved = g.relabel(perm)
    a = decompose.kcore(g).join(perm, F.col("id") == F.col("old_id")).select("new_id", "core")
    assert sorted(a.collect()) == sorted(decompose.kcore(moved).select("id", "core").collect())
    with pytest.raises(ValueError):
        reorder.order_map(spark.createDataFrame([(0, 0), (1, 0)], "old_id long, new_id long"))


def test_rank_mass(random_graph):
    g, _ = random_graph
    p = ranking.pagerank(g, 5)
    assert p.agg(F.sum("rank")).first()[0] <= 1 + 1e-9
    assert p.count() == 42
    mass = local.pr_nibble(g, 3, eps=1e-3)
    assert math.isclose(mass.agg(F.sum(F.col("mass") + F.col("residual"))).first()[0], 1, abs_tol=1e-9)
    cut = local.sweep_cut(g, mass.filter("mass > 0").select("id", "mass")).first()
    assert 0 <= cut.conductance <= 1 and cut.size_s >= 1


def test_orders_are_permutations(random_graph):
    g, _ = random_graph
    clusters = g.vertices.select("id", (F.col("id") % 3).cast("int").alias("cluster"))
    orders = [reorder.order_gorder(g), reorder.order_rcm(g), reorder.order_rabbit(g), reorder.order_corder(g, threads=1), reorder.order_dbg(g), reorder.order_fbc(g)]
    orders += [reorder.order_clusters(g, clusters), reorder.order_balanced(g, clusters, threads=1)]
    for perm in orders:
        rows = perm.collect()
        assert sorted(r.old_id for r in rows) == sorted(r.new_id for r in rows) == list(range(42))


def test_rabbit_gains_modularity(random_graph):
    g, _ = random_graph
    found = reorder.rabbit(g)
    assert metrics.modularity(g, found.select("id", F.col("community").alias("label"))).first().value > 0.2


def test_balanced_dealing_in_plain_python(spark):
    g = graph(spark, 64, [(i % 64, (i * 7 + 3) % 64) for i in range(200)] + [(0, i) for i in range(1, 30)])
    clusters = g.vertices.select("id", (F.col("id") % 5).cast("int").alias("cluster"))
    size, parts = reorder.partition_size(64, 512, 4)
    assert (size, parts) == (4, 16)
    deg = {r.id: r.out_deg for r in g.degrees().collect()}
    avg = g.edges.count() // 64
    bins, turn = [[] for _ in range(parts)], 0
    for c in range(5):
        hubs = [v for v in range(64) if v % 5 == c and deg[v] > avg]
        cold = [v for v in range(64) if v % 5 == c and deg[v] <= avg]
        run = len(cold) // (parts - 1)
        queue = [(None, v) for v in hubs] + [(p, cold[p * run + i]) for p in range(parts - 1) for i in range(run)] + [(None, v) for v in cold[run * (parts - 1) :]]
        for p, v in queue:
            to = turn if p is None else p
            bins[to if len(bins[to]) < size else parts - 1].append(v)
            if p is None:
                turn = (turn + 1) % (parts - 1)
    got = reorder.order_balanced(g, clusters).orderBy("new_id").collect()
    assert [r.old_id for r in got] == [v for b in bins for v in b]


def test_hypergraph(spark):
    pairs = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (2, 1), (3, 1)], "v long, h long")
    h = HyperGraph.symmetric(pairs, spark.range(4), spark.range(2))
    reached = {(r.side, r.id): r.level for r in hyper.hyper_bfs(h, 0).collect()}
    assert reached["V", 3] == 4
    assert sorted(r.id for r in hyper.hyper_bpath(h, 0).filter("reached").collect()) == [0]
    assert {r.label for r in hyper.hyper_cc(h).collect()} == {0}
    assert h.expand().edges.count() == 8
    rank = hyper.hyper_pagerank(h)
    assert math.isclose(rank.filter("side = 'V'").agg(F.sum("rank")).first()[0], 1, abs_tol=1e-9)
    assert {r.id: r.dist for r in hyper.hyper_sssp(h, 0).filter("side = 'V'").collect()} == {0: 0, 1: 2, 2: 2, 3: 4}
    bc = {r.id: (r.paths, r.dependency) for r in hyper.hyper_bc(h, 0).collect()}
    assert bc[3][0] == 1.0 and bc[2][1] == 2.0
    assert column(hyper.hyper_kcore(h), "core") == [1, 1, 1, 1]


def test_betweenness_and_cover(tailed):
    got = {r.id: (r.paths, r.dependency) for r in decompose.betweenness(tailed, 0).collect()}
    assert got[3] == (1.0, 0.0) and got[2] == (1.0, 1.0)
    cover = decompose.set_cover(tailed).collect()
    assert all(r.covered for r in cover)


def test_hashes_match_plain_integers(spark):
    ids = [0, 1, 2, 77, 2**31, 2**32 - 1]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", hash32("id" and F.col("id")).alias("a"), hash64(F.col("id")).alias("b"), umod(hash64(F.col("id")), 97).alias("c")).collect()
    for r in got:
        assert r.a == hash32_int(r.id)
        assert r.b % 2**64 == hash64_int(r.id)
        assert r.c == hash64_int(r.id) % 97


def test_scan_ranks_pack(spark):
    values = spark.createDataFrame([(i, (i * 37) % 11) for i in range(100)], "id long, x long")
    got = column(primitives.scan(values, "id", "x"), "scan")
    assert got == [sum((j * 37) % 11 for j in range(i)) for i in range(100)]
    back = column(primitives.scan(values, "id", "x", inclusive=True, backward=True), "scan")
    assert back == [sum((j * 37) % 11 for j in range(i, 100)) for i in range(100)]
    ranked = primitives.ranks(values, F.col("x"), F.col("id").desc(), name="at").orderBy("at").collect()
    assert [(r.x, r.id) for r in ranked] == sorted([((i * 37) % 11, i) for i in range(100)], key=lambda t: (t[0], -t[1]))
    assert column(primitives.pack(values, F.col("x") > 5, "id"), "at") == list(range(sum((i * 37) % 11 > 5 for i in range(100))))
    assert primitives.scan(values.limit(0), "id", "x").count() == 0


def test_rmat_in_plain_python(spark):
    import numpy as np

    n, bits, m, h = 100, 7, 50, hash32_int(1)
    fa, fb, fc = (float(np.float32(x)) for x in (0.5, 0.1, 0.1))
    want = []
    for i in range(m):
        start, stride = hash32_int((2 * i) * h % 2**32), hash32_int((2 * i + 1) * h % 2**32)
        u = v = 0
        for level in range(bits):
            r, half = hash32_int((start + level * stride) % 2**32) / (2**32 - 1), 1 << (bits - 1 - level)
            u += half * (r >= fa + fb)
            v += half * (fa <= r < fa + fb or r >= fa + fb + fc)
        want.append((u, v))
    assert sorted((r.src, r.dst) for r in generate.rmat(spark, n, m).edges.collect()) == sorted(want)


def test_generators(spark):
    assert generate.grid(spark, 25, 2).edges.count() == 100
    e = generate.parmat(spark, 64, 300, no_self=True, no_duplicates=True).collect()
    assert len({(r.src, r.dst) for r in e}) == 300 and all(r.src != r.dst for r in e)
    assert [tuple(r) for r in e] and sorted(map(tuple, e)) == sorted(map(tuple, generate.parmat(spark, 64, 300, no_self=True, no_duplicates=True).collect()))
    local_edges = generate.rand_local(spark, 50, 200, 2).edges.collect()
    assert len(local_edges) == 200 and all(r.src != r.dst and 0 <= r.dst < 50 for r in local_edges)
    w = generate.add_weights(graph(spark, 8, [(0, 1), (1, 2), (5, 7)])).edges.collect()
    by = {(r.src, r.dst): r.w for r in w}
    assert all(by[a, b] == by[b, a] and 1 <= x <= 3 for (a, b), x in by.items())
    assert generate.rand_hyper(spark, 20, 30).v2h.distinct().count() <= 90


def test_clusters(spark, path4):
    trace = cluster.bfs_trace(path4, [0, 3])
    feats = cluster.embed(trace, path4.vertices, 2)
    assert {r.id: list(r.feat) for r in feats.collect()} == {0: [0, 3], 1: [1, 2], 2: [2, 1], 3: [3, 0]}
    assert cluster.duplicates(trace).isEmpty()
    got = cluster.kmeans_l1(feats, 2, start=[[0, 3], [3, 0]])
    assert column(got, "cluster") == [0, 0, 1, 1]
    assert cluster.chain([[0], [9], [1]]) == [[0.0], [1.0], [9.0]]
    assert cluster.kmeans_l1(feats, 2).count() == 4


def test_empty_graph(spark):
    g = PropertyGraph(spark.range(3), spark.createDataFrame([], "src long, dst long"))
    assert column(traverse.components(g), "label") == [0, 1, 2]
    assert column(decompose.kcore(g), "core") == [0, 0, 0]
    assert column(decompose.mis(g), "in_set") == [True] * 3
    assert column(eccentricity.ecc_exact(g), "ecc") == [0, 0, 0]
    assert column(traverse.bfs(g, 1), "level") == [None, 0, None]


def test_el2csr(spark):
    g = graph(spark, 3, [(0, 1), (0, 2), (1, 1), (0, 1)], symmetric=False)
    assert [(r.id, r.offset, list(r.nbrs)) for r in convert.el2csr(g).orderBy("id").collect()] == [(0, 0, [2, 1, 1]), (1, 3, []), (2, 3, [])]


def plain_deal(rows, size, parts):
    """Vertices dealt one by one. ``rows``: (cluster, id, hub)."""
    bins, turn = [[] for _ in range(parts)], 0

    def offer(b, v):
        bins[b if len(bins[b]) < size else parts - 1].append(v)

    for cluster in sorted({c for c, _, _ in rows}):
        hubs = sorted(v for c, v, hub in rows if c == cluster and hub)
        cold = sorted(v for c, v, hub in rows if c == cluster and not hub)
        run = len(cold) // (parts - 1)
        for v in hubs:
            offer(turn, v)
            turn = (turn + 1) % (parts - 1)
        for i, v in enumerate(cold):
            if i < run * (parts - 1):
                offer(i // run, v)
            else:
                offer(turn, v)
                turn = (turn + 1) % (parts - 1)
    return {v: i for i, v in enumerate(v for b in bins for v in b)}


def test_balanced_order_deals_one_by_one(spark):
    rng = random.Random(2)
    for n, threads, clusters in ((60, 2, 3), (97, 1, 5), (40, 3, 1), (130, 2, 40)):
        edges = [(min(int(rng.paretovariate(0.7)), n) - 1, rng.randrange(n)) for _ in range(3 * n)]
        g = PropertyGraph(spark.range(n), spark.createDataFrame(edges, "src long, dst long"))
        own = {v: rng.randrange(clusters) for v in range(n)}
        size, parts = reorder.partition_size(n, 512, threads)
        deg = collections.Counter(a for a, _ in edges)
        want = plain_deal([(own[v], v, deg[v] > len(edges) // n) for v in range(n)], size, parts)
        got = reorder.order_balanced(g, spark.createDataFrame(list(own.items()), "id long, cluster long"), 512, threads)
        assert {r.old_id: r.new_id for r in got.collect()} == want


def plain_cover(sets, epsilon=0.01):
    """Rounds of the highest bucket, a set at a time."""
    bucket = lambda d: math.floor(math.log(d) / math.log1p(epsilon)) if d else None
    own, covered, cover = {s: bucket(len(e)) for s, e in sets.items()}, set(), set()
    while any(b is not None for b in own.values()):
        top = max(b for b in own.values() if b is not None)
        active = [s for s, b in own.items() if b == top]
        left = {s: sets[s] - covered for s in active}
        own.update({s: bucket(len(left[s])) for s in active})
        wins = collections.defaultdict(set)
        for s in sorted(active, reverse=True):
            if own[s] == top:
                for x in left[s]:
                    wins[min(c for c in active if own[c] == top and x in left[c])].add(x)
        for s, xs in wins.items():
            if len(xs) >= max(1, math.ceil((1 + epsilon) ** (top - 1) - 1e-9)):
                cover.add(s)
                covered |= xs
                own[s] = None
    return cover, covered


def test_set_cover_takes_the_sets_of_the_plain_version(spark):
    rng = random.Random(4)
    for n, m in ((25, 60), (40, 300)):
        pairs = sorted({(min(int(rng.paretovariate(0.8)), n) - 1, rng.randrange(n)) for _ in range(m)})
        sets = collections.defaultdict(set)
        for a, b in pairs:
            sets[a].add(b)
        cover, covered = plain_cover(dict(sets))
        rows = decompose.set_cover(PropertyGraph(spark.range(n), spark.createDataFrame(pairs, "src long, dst long"))).collect()
        assert {r.id for r in rows if r.in_cover} == cover and {r.id for r in rows if r.covered} == covered == {b for _, b in pairs}
