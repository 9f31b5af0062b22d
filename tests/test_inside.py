"""Orders, covers and eccentricities that are worked out inside tasks, against plain versions over whole graphs."""

import heapq
import random
from collections import deque

import pytest

from graphloom.graph import PropertyGraph
from graphloom.operators import reorder


def several(seed, n=60, m=90, directed=True):
    """Components of many sizes, loops, isolated vertices."""
    rng = random.Random(seed)
    pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a % 4 == b % 4 and a % 7 and b % 7}
    return sorted(pairs if directed else {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b})


def plain_gorder(n, pairs, window=5):
    out, into = [[b for a, b in pairs if a == v] for v in range(n)], [[a for a, b in pairs if b == v] for v in range(n)]
    lone = [v for v in range(n) if not out[v] and not into[v]]
    score, placed, heap = [0] * n, [v in set(lone) for v in range(n)], []
    rest = iter(sorted((v for v in range(n) if not placed[v]), key=lambda v: (-len(into[v]), v)))
    recent, order = deque(), []

    def spread(v, by):
        for u in out[v] + into[v] + [x for u in into[v] if len(out[u]) <= n**0.5 for x in out[u]]:
            score[u] += by
            if by > 0 and not placed[u]:
                heapq.heappush(heap, (-score[u], u))

    for _ in range(n - len(lone)):
        v = -1
        while heap:
            s, u = heapq.heappop(heap)
            if placed[u]:
                continue
            if -s != score[u]:
                if score[u] > 0:
                    heapq.heappush(heap, (-score[u], u))
                continue
            v = u
            break
        if v < 0:
            v = next(u for u in rest if not placed[u])
        placed[v] = True
        order.append(v)
        recent.append(v)
        spread(v, 1)
        if len(recent) > window:
            spread(recent.popleft(), -1)
    return order[:-1] + lone + order[-1:] if order else lone


def plain_rcm(n, pairs):
    deg = [sum((a == v) + (b == v) for a, b in pairs) for v in range(n)]
    seen, order = set(), []
    for start in sorted(range(n), key=lambda v: (deg[v], v)):
        queue = deque([start] if start not in seen else [])
        seen.add(start)
        while queue:
            v = queue.popleft()
            order.append(v)
            for u in sorted({b for a, b in pairs if a == v} - seen, key=lambda u: (deg[u], u)):
                seen.add(u)
                queue.append(u)
    return order[::-1]


def plain_rabbit(n, pairs):
    near = [{b: 1.0 for a, b in pairs if a == v} for v in range(n)]
    strength = [float(len(x)) for x in near]
    total, top, children = sum(strength), list(range(n)), [[] for _ in range(n)]

    def root(v):
        return v if top[v] == v else root(top[v])

    for v in sorted(range(n), key=lambda v: (len(near[v]), v)):
        merged = {}
        for u, w in near[v].items():
            if root(u) != v:
                merged[root(u)] = merged.get(root(u), 0.0) + w
        best = max(((w - strength[v] * strength[u] / total, -u) for u, w in merged.items()), default=(0.0, 0))
        if best[0] > 0:
            u = -best[1]
            top[v] = u
            strength[u] += strength[v]
            children[u].append(v)
            for x, w in merged.items():
                near[u][x] = near[u].get(x, 0.0) + w
    order = []
    for c in (v for v in range(n) if top[v] == v):
        todo = [c]
        while todo:
            order.append(v := todo.pop())
            todo.extend(children[v])
    return order


@pytest.mark.parametrize("name, directed", [("gorder", True), ("rcm", True), ("rabbit", False)])
def test_orders_are_those_of_the_plain_versions(spark, name, directed):
    for seed in (1, 2):
        pairs = several(seed, m=300 * seed, directed=directed)
        g = PropertyGraph(spark.range(60), spark.createDataFrame(pairs, "src long, dst long"))
        want = {"gorder": plain_gorder, "rcm": plain_rcm, "rabbit": plain_rabbit}[name](60, pairs)
        rows = getattr(reorder, f"order_{name}")(g).orderBy("new_id").collect()
        assert [r.new_id for r in rows] == list(range(60)) and [r.old_id for r in rows] == want


def test_sequential_orders_deal_components_over_tasks(spark):
    """No refusal above a number of edges, and no group of the whole graph."""
    g = PropertyGraph(spark.range(60), spark.createDataFrame(several(3, m=300), "src long, dst long"))
    assert not hasattr(reorder, "SEQUENTIAL_EDGES")
    assert reorder.order_rcm_gorder(g).distinct().count() == 60


def test_covers_and_eccentricities_inside_tasks_equal_the_rounds(spark):
    from graphloom.operators import decompose, eccentricity

    pairs = several(5, m=260, directed=False)
    g = PropertyGraph(spark.range(60), spark.createDataFrame(pairs, "src long, dst long"))
    for f in (decompose.set_cover, eccentricity.ecc_exact, eccentricity.ecc_tk, eccentricity.ecc_clrstv, eccentricity.ecc_rv):
        assert sorted(map(tuple, f(g, inside=0).collect())) == sorted(map(tuple, f(g, inside=30).collect()))


def test_all_estimates_at_once_equal_the_operators(spark):
    from graphloom.operators import eccentricity as e

    pairs = several(6, n=90, m=300, directed=False)
    pairs += [(100, 101), (101, 100)] + [(110 + a, 110 + b) for a in range(6) for b in (a - 1, a + 1) if 0 <= b < 6]  # a pair, a path
    g = PropertyGraph(spark.range(151), spark.createDataFrame(pairs, "src long, dst long"))
    apart = {
        "exact": e.ecc_exact(g, inside=0), "kbfs": e.ecc_kbfs(g, least=20), "kbfs1": e.ecc_kbfs(g, phases=1), "fm": e.ecc_fm(g), "loglog": e.ecc_loglog(g),
        "simple": e.ecc_simple(g), "clrstv": e.ecc_clrstv(g, inside=0), "rv": e.ecc_rv(g, inside=0),
    }
    want = {name: {r.id: r.ecc for r in df.collect()} for name, df in apart.items()}
    for inside in (30, 1000):
        rows = e.ecc_estimates(g, least=20, inside=inside).collect()
        assert len(rows) == 151
        for name in apart:
            assert {r.id: r[name] for r in rows} == want[name], (name, inside)


def test_shares_of_a_component_and_hubs(spark):
    """A component's sources are dealt over tasks; a hub has more neighbours than are taken column by column."""
    from graphloom.operators import eccentricity as e

    ends = [(0, i) for i in range(1, 400)] + [(i, i + 400) for i in range(1, 300)] + [(700, 800), (800, 801)]
    pairs = sorted({(a, b) for a, b in ends} | {(b, a) for a, b in ends})
    g = PropertyGraph(spark.range(810), spark.createDataFrame(pairs, "src long, dst long"))
    near = {v: [] for v in range(810)}
    for a, b in pairs:
        near[a].append(b)

    def ecc(v):
        seen, front, d = {v}, [v], 0
        while front := [u for u in {u for x in front for u in near[x]} if u not in seen]:
            seen.update(front)
            d += 1
        return d

    want = {v: ecc(v) for v in range(810)}
    for f in (e.ecc_exact, e.ecc_tk):
        assert {r.id: r.ecc for r in f(g, work=100_000).collect()} == want


def test_stars_keep_components(spark):
    from graphloom.operators.components import contracted, min_labels

    g = spark.createDataFrame([(i + 1, i) for i in range(500)] + [(600, 601), (602, 602)], "src long, dst long").repartition(7)
    labels = {r.id: r.label for r in min_labels(contracted(g)).collect()}
    assert labels == {**{i: 0 for i in range(501)}, 600: 600, 601: 600, 602: 602}


def test_components_of_six_million_arcs_are_covered_inside_tasks(spark, monkeypatch):
    """6 x sf0.1 can be one component of more than 5 million arcs, for which rounds over tables take too long."""
    from graphloom.operators import decompose

    g = PropertyGraph(spark.range(60), spark.createDataFrame(several(5, m=260, directed=False), "src long, dst long"))
    monkeypatch.setattr(decompose, "_cover_rounds", None)
    assert decompose.INSIDE_ARCS >= 10_000_000
    assert decompose.set_cover(g).filter("in_cover").count()


def test_greedy_order_by_scan_and_by_buckets(spark):
    pairs = several(4, m=500)
    g = PropertyGraph(spark.range(60), spark.createDataFrame(pairs, "src long, dst long"))
    for scan in (0, 1000):
        assert [r.old_id for r in reorder.order_gorder(g, scan=scan).orderBy("new_id").collect()] == plain_gorder(60, pairs)
