"""One query per operator over graphs derived from the order tables; ``sql`` holds their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.exprs import hash32, hash64, l1, mismatches
from graphloom.graph import PropertyGraph
from graphloom.operators import cluster, convert, decompose, eccentricity, gas, generate, hyper, local, metrics, primitives, ranking, reorder, traverse
from graphloom.plans.inside import component_labels
from graphloom.plans.rounds import bucket_loop
from graphloom.sources import binary, codec, formats
from graphloom.sources.derived import cust_supp, hub, order_part, part_next, part_sym, part_weighted, table
from graphloom.store import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
THREADS, PART_KB = 4, 512
CENTROIDS = [[0, 0, 0], [1, 2, 3], [2, 2, 2], [3, 3, 4]]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 9) for n in names})


def _kept(g: PropertyGraph) -> PropertyGraph:
    """The graph's edges as a table: loops read it many times."""
    return PropertyGraph(g.vertices, Scratch(g.edges.sparkSession, "graph").table(g.edges, "edges"))


def _front(g: PropertyGraph) -> DataFrame:
    return g.vertices.filter(F.col("id") % 10 == 0)


# degrees and graph forms


@query
def degree_hist(s, d):
    return part_next(s, d).degrees().groupBy("out_deg").agg(F.count("*").alias("n"))


@query
def in_out_degree(s, d):
    return part_next(s, d).degrees()


@query
def degree_decades(s, d):
    return metrics.degree_histogram(part_next(s, d))


@query
def graph_transpose(s, d):
    return part_next(s, d).transpose().edges


@query
def graph_symmetrize(s, d):
    return part_sym(s, d).edges


@query
def graph_adjacency(s, d):
    return part_sym(s, d).adjacency().select("id", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


@query
def weighted_simplify(s, d):
    g = part_weighted(s, d)
    twice = g.edges.unionByName(g.edges.withColumn("w", F.col("w") + 1))
    return PropertyGraph(g.vertices, twice).simplify().edges


# operator algebra


@query
def edge_map(s, d):
    g = part_next(s, d)
    return primitives.edge_map(g, _front(g), cond=g.vertices.filter("id % 3 = 0"))


@query
def edge_map_data(s, d):
    g = part_next(s, d)
    return primitives.edge_map_data(g, _front(g), F.col("src") * 2 + F.col("dst"), "max")


@query
def edge_map_induced(s, d):
    g = part_next(s, d)
    return primitives.edge_map_induced(g, _front(g)).groupBy("dst").agg(F.count("*").alias("n"))


@query
def edge_map_reduce(s, d):
    g = part_next(s, d)
    return primitives.edge_map_reduce(g, _front(g), F.col("src"), "sum", lambda x: x.filter("value % 2 = 0"))


@query
def edge_map_count(s, d):
    g = part_next(s, d)
    return primitives.edge_map_count(g, _front(g))


@query
def edge_map_filter(s, d):
    g = part_next(s, d)
    return primitives.edge_map_filter(g, _front(g), F.col("dst") % 2 == 0)


@query
def pack_edges(s, d):
    g = part_next(s, d)
    return primitives.pack_edges(g, _front(g), F.col("dst") % 2 == 0).edges


@query
def vertex_map(s, d):
    g = part_next(s, d)
    return primitives.vertex_map(g.degrees().select("id", "out_deg"), _front(g), out_deg=-F.col("out_deg"))


@query
def vertex_filter(s, d):
    return primitives.vertex_filter(part_next(s, d).degrees().select("id", "in_deg"), F.col("in_deg") > 20)


@query
def histogram(s, d):
    return primitives.histogram(part_next(s, d).edges, "dst", F.col("src"), "max")


@query
def reduce_column(s, d):
    return primitives.reduce_column(part_next(s, d).degrees(), "out_deg", "sum")


@query
def prefix_scan(s, d):
    return primitives.scan(part_next(s, d).degrees().select("id", "out_deg"), "id", "out_deg")


@query
def prefix_scan_back(s, d):
    return primitives.scan(part_next(s, d).degrees().select("id", "out_deg"), "id", "out_deg", inclusive=True, backward=True)


@query
def pack_index(s, d):
    return primitives.pack(part_next(s, d).degrees().select("id", "out_deg"), F.col("out_deg") > 22, "id")


@query
def integer_sort(s, d):
    return primitives.ranks(part_next(s, d).degrees().select("id", "in_deg"), F.col("in_deg"), F.col("id"), name="place")


@query
def counting_sort(s, d):
    return primitives.counting_sort(part_next(s, d).degrees().select("id", "in_deg"), "in_deg", 8).groupBy("in_deg").agg(F.count("*").alias("n"))


@query
def remove_duplicates(s, d):
    return primitives.remove_duplicates(part_next(s, d).edges.select("dst"), "dst")


@query
def search(s, d):
    g = part_next(s, d)
    return primitives.search(g.edges, g.vertices.select(F.col("id").alias("probe")), "src")


@query
def hash_int32(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), hash32(F.col("p_partkey")).alias("h"))


@query
def hash_int64(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), hash64(F.col("p_partkey")).alias("h"))


@query
def vector_distances(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 5).alias("a"), F.array(F.col("p_partkey") % 3, F.col("p_partkey") % 5).alias("b"))
    return p.select("id", l1(F.col("a"), F.col("b")).alias("l1"), mismatches(F.col("a"), F.col("b")).alias("mismatches"))


# orders


def _order(name: str, f) -> None:
    def run(s, d):
        return f(part_next(s, d))

    run.__name__ = name
    query(run)


_order("order_so", reorder.order_sort)
_order("order_hc", reorder.order_hc)
_order("order_dbg", reorder.order_dbg)
_order("order_fbc", reorder.order_fbc)
_order("order_co", lambda g: reorder.order_corder(g, PART_KB, THREADS))


@query
def order_map(s, d):
    n = F.lit(table(s, d, "part").count())
    return reorder.order_map(table(s, d, "part").select(F.col("p_partkey").alias("old_id"), (n - 1 - F.col("p_partkey")).alias("new_id")))


@query
def relabel_so(s, d):
    g = part_next(s, d)
    return g.relabel(reorder.order_sort(g)).edges


@query
def relabel_weighted(s, d):
    g = part_weighted(s, d)
    return g.relabel(reorder.order_sort(g)).edges


@query
def gap_cost_so(s, d):
    g = part_next(s, d)
    return _r(metrics.gap_cost(g.relabel(reorder.order_sort(g))), "value")


@query
def gap_entropy(s, d):
    return _r(metrics.gap_entropy(part_next(s, d)), "value")


@query
def log_cost(s, d):
    return _r(metrics.log_cost(part_next(s, d)), "value")


@query
def log_gap_cost(s, d):
    return _r(metrics.log_gap_cost(part_next(s, d)), "value")


@query
def locality_w5(s, d):
    return metrics.locality_score(part_next(s, d))


@query
def skew_locality(s, d):
    return _r(metrics.skew_locality(part_next(s, d), 64), "skew")


@query
def overflow(s, d):
    return metrics.overflow(part_next(s, d), 64)


@query
def modularity(s, d):
    g = part_next(s, d)
    return _r(metrics.modularity(g, g.vertices.select("id", F.floor(F.col("id") / 50).alias("label"))), "value")


@query
def rabbit_adjacency(s, d):
    return reorder.rabbit_adjacency(part_next(s, d))


@query
def order_gorder(s, d):
    return reorder.order_gorder(part_next(s, d))


@query
def order_rcm(s, d):
    return reorder.order_rcm(part_sym(s, d))


@query
def order_rcm_gorder(s, d):
    return reorder.order_rcm_gorder(_kept(part_next(s, d)))


@query
def order_rabbit(s, d):
    return reorder.order_rabbit(part_sym(s, d))


@query
def order_checks(s, d):
    """Sequential and clustered orders are permutations: rows out of place, by order."""
    g = _kept(part_next(s, d))
    sym = _kept(g.symmetrize())
    clusters = g.vertices.select("id", (F.col("id") % 7).cast("int").alias("cluster"))
    labels = component_labels(g.edges)
    found = {"gorder": reorder.order_gorder(g, labels=labels), "rcm": reorder.order_rcm(sym, labels), "rabbit": reorder.order_rabbit(sym, labels), "fon": reorder.order_clusters(g, clusters), "fo": reorder.order_balanced(g, clusters, PART_KB, THREADS)}
    out = None
    for name, perm in found.items():
        n = g.vertices.count()
        one = perm.agg(F.lit(name).alias("name"), (F.lit(n) - F.countDistinct("old_id")).alias("lost"), (F.lit(n) - F.countDistinct("new_id")).alias("clashes"), F.count_if((F.col("new_id") < 0) | (F.col("new_id") >= n)).alias("outside"))
        out = one if out is None else out.unionByName(one)
    return out


# traversal


@query
def bfs_levels(s, d):
    g = _kept(part_sym(s, d))
    return traverse.bfs(g, hub(g)).filter("level is not null").groupBy("level").agg(F.count("*").alias("n"))


@query
def bfs_parents(s, d):
    g = _kept(part_sym(s, d))
    return traverse.bfs(g, hub(g))


@query
def bfs_bitvector(s, d):
    g = _kept(part_next(s, d))
    return traverse.bfs_bitvector(g, hub(g)).select("id", "level")


@query
def components(s, d):
    return traverse.components(part_sym(s, d))


@query
def components_shortcut(s, d):
    return traverse.components(part_sym(s, d), shortcut=True)


@query
def components_directed(s, d):
    return traverse.components(part_next(s, d))


@query
def bfs_cc(s, d):
    return traverse.bfs_cc(part_next(s, d))


@query
def sssp(s, d):
    g = _kept(part_weighted(s, d))
    return traverse.sssp(g, hub(g), "w")


@query
def sssp_unit(s, d):
    g = _kept(part_sym(s, d))
    return traverse.sssp(g, hub(g))


@query
def delta_stepping(s, d):
    g = _kept(part_weighted(s, d))
    return traverse.delta_stepping(g, hub(g), 4, "w")


@query
def gas_bfs(s, d):
    g = _kept(part_sym(s, d))
    return gas.gas_bfs(g, hub(g))


@query
def gas_sssp(s, d):
    g = _kept(part_weighted(s, d))
    return gas.gas_sssp(g, hub(g))


@query
def gas_cc(s, d):
    return gas.gas_cc(part_next(s, d))


# ranking


@query
def pagerank10(s, d):
    return _r(ranking.pagerank(part_sym(s, d)), "rank")


@query
def pagerank_delta(s, d):
    return _r(ranking.pagerank_delta(part_sym(s, d), max_iter=5), "rank")


@query
def pagerank_raw(s, d):
    return _r(ranking.pagerank_unnormalised(part_sym(s, d), 5), "rank")


@query
def collaborative_filter(s, d):
    g = cust_supp(s, d)
    return ranking.cf(g, k=4, iters=2, step=1e-3).select("id", F.posexplode("latent").alias("k", "x")).select("id", "k", F.round("x", 9).alias("x"))


# decomposition


@query
def triangles(s, d):
    return decompose.triangles(part_sym(s, d)).agg(F.sum("count").alias("triangles"))


@query
def triangles_per_vertex(s, d):
    return decompose.triangles(part_sym(s, d)).withColumnRenamed("count", "n")


@query
def kcore(s, d):
    return decompose.kcore(part_sym(s, d))


@query
def mis(s, d):
    return decompose.mis(part_sym(s, d))


@query
def bc(s, d):
    g = _kept(part_sym(s, d))
    return _r(decompose.betweenness(g, hub(g)), "paths", "dependency")


@query
def radii(s, d):
    return decompose.radii(_kept(part_sym(s, d)))


@query
def set_cover(s, d):
    return decompose.set_cover(_kept(part_sym(s, d)))


@query
def set_cover_check(s, d):
    """Elements that some set holds and the cover misses."""
    g = _kept(part_sym(s, d))
    found = Scratch(s, "cover-check").table(decompose.set_cover(g), "cover")
    inside = g.edges.join(found.filter("in_cover").select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
    return g.edges.select(F.col("dst").alias("id")).distinct().join(inside, "id", "left_anti").agg(F.count("*").alias("missed"))


# hypergraphs


@query
def hyper_bfs(s, d):
    h = order_part(s, d)
    return hyper.hyper_bfs(h, 0).select("side", "id", "level")


@query
def hyper_cc(s, d):
    return hyper.hyper_cc(order_part(s, d))


@query
def hyper_sssp(s, d):
    return hyper.hyper_sssp(generate.add_hyper_weights(order_part(s, d)), 0)


@query
def hyper_bpath(s, d):
    return hyper.hyper_bpath(order_part(s, d), 0)


@query
def hyper_pagerank1(s, d):
    return hyper.hyper_pagerank(order_part(s, d)).withColumn("rank", F.round("rank", 12))


@query
def hyper_entropy(s, d):
    return _r(hyper.hyper_pagerank(order_part(s, d), entropy=True).filter("side = 'H'").select("id", "entropy"), "entropy")


@query
def hyper_bc(s, d):
    return _r(hyper.hyper_bc(order_part(s, d), 0), "paths", "dependency")


@query
def hyper_mis(s, d):
    return hyper.hyper_mis(order_part(s, d))


@query
def hyper_mis_check(s, d):
    """Hyperedges of two or more members that lie wholly inside, and vertices left out that could be added."""
    h = order_part(s, d)
    found = Scratch(s, "mis-check").table(hyper.hyper_mis(h), "mis")
    marks = h.v2h.join(found.select(F.col("id").alias("v"), F.col("in_set").cast("int").alias("i")), "v")
    sizes = marks.groupBy("h").agg(F.count("*").alias("n"), F.sum("i").alias("m")).filter("n > 1")
    blocked = marks.filter("i = 0").join(sizes.filter("m = n - 1"), "h").select("v").distinct()
    free = found.filter("not in_set").select(F.col("id").alias("v")).join(blocked, "v", "left_anti")
    return sizes.filter("m = n").agg(F.count("*").alias("filled")).join(free.agg(F.count("*").alias("addable")))


@query
def hyper_kcore(s, d):
    return hyper.hyper_kcore(order_part(s, d))


@query
def hyper_degrees(s, d):
    return hyper.hyper_degrees(order_part(s, d))


@query
def hyper_reader(s, d):
    return hyper.hyper_dump(order_part(s, d))


@query
def clique_expand(s, d):
    return order_part(s, d).expand().edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


# eccentricities


@query
def ecc_exact(s, d):
    return eccentricity.ecc_exact(_kept(part_sym(s, d)))


@query
def ecc_tk(s, d):
    return eccentricity.ecc_tk(_kept(part_sym(s, d)))


@query
def ecc_estimates(s, d):
    """How each estimate sits towards the exact value: vertices below, equal, above, and out of its bounds."""
    found, sums = eccentricity.ecc_estimates(_kept(part_sym(s, d))), []
    for name in eccentricity.ESTIMATES:
        ecc, exact = F.col(name), F.col("exact")
        bad = (ecc > 2 * exact) | (exact > 2 * ecc) if name == "simple" else ecc > exact if name != "rv" else ecc > 2 * exact
        sums.append(F.struct(F.lit(name).alias("name"), F.count_if(ecc < exact).alias("below"), F.count_if(ecc == exact).alias("equal"), F.count_if(ecc > exact).alias("above"), F.count_if(bad).alias("out_of_bounds")))
    return found.agg(F.array(*sums).alias("sums")).select(F.inline("sums"))


@query
def ecc_bounds_check(s, d):
    return ecc_estimates(s, d).select("name", "out_of_bounds")


# local clustering


@query
def nibble_t3(s, d):
    g = _kept(part_sym(s, d))
    return _r(local.nibble(g, hub(g), T=3, eps=1e-9), "mass")


@query
def nibble_truncated(s, d):
    g = _kept(part_sym(s, d))
    return _r(local.nibble(g, hub(g), T=3, eps=1e-5), "mass")


@query
def sweep(s, d):
    g = _kept(part_sym(s, d))
    return _r(local.sweep_cut(g, local.nibble(g, hub(g), T=3, eps=1e-9)), "conductance")


@query
def heat_kernel(s, d):
    g = _kept(part_sym(s, d))
    return _r(local.heat_kernel(g, hub(g), N=3, eps=1e-9), "mass")


@query
def heat_kernel_walks(s, d):
    g = _kept(part_sym(s, d))
    return _r(local.heat_kernel_walks(g, hub(g), N=200), "mass")


@query
def pr_nibble_check(s, d):
    """Both push rules: mass that isn't kept, and residuals above the limit."""
    g = _kept(part_sym(s, d))
    deg, out = g.degrees(), None
    for name, opt in (("plain", False), ("optimised", True)):
        one = local.pr_nibble(g, hub(g), eps=1e-3, optimised=opt).join(deg, "id")
        one = one.agg(F.lit(name).alias("name"), F.round(F.sum(F.col("mass") + F.col("residual")), 9).alias("total"), F.count_if(F.col("residual") > 1e-3 * F.col("out_deg")).alias("high"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def pr_nibble(s, d):
    g = _kept(part_sym(s, d))
    return _r(local.pr_nibble(g, hub(g), eps=1e-3), "mass", "residual")


# features and clusters


def _features(s, d) -> DataFrame:
    g = _kept(part_sym(s, d))
    trace = cluster.bfs_trace(g, [0, 1, 2])
    return Scratch(s, "features").table(cluster.embed(trace, g.vertices, 3), "features")


@query
def bfs_trace(s, d):
    return cluster.bfs_trace(_kept(part_sym(s, d)), [0, 1, 2])


@query
def bfs_feature(s, d):
    return _features(s, d).select("id", *[F.col("feat")[i].alias(f"f{i}") for i in range(3)])


@query
def bfs_blocks(s, d):
    return cluster.block_count(cluster.bfs_trace(_kept(part_sym(s, d)), [0]))


@query
def kmeans_assign(s, d):
    return cluster.assign(_features(s, d), CENTROIDS).select("id", "cluster", "dist")


@query
def kmeans_step(s, d):
    step = cluster.recentre(cluster.assign(_features(s, d), CENTROIDS), 3)
    return step.select("cluster", *[F.col("centre")[i].alias(f"c{i}") for i in range(3)], "n")


@query
def order_fon(s, d):
    return reorder.order_clusters(part_sym(s, d), cluster.kmeans_l1(_features(s, d), k=4))


@query
def order_fo(s, d):
    return reorder.order_balanced(part_sym(s, d), cluster.kmeans_l1(_features(s, d), k=4), PART_KB, THREADS)


@query
def order_fo_fixed(s, d):
    """Balanced dealing of clusters given by id: exact once the clusters are."""
    g = part_next(s, d)
    return reorder.order_balanced(g, g.vertices.select("id", (F.col("id") % 7).cast("int").alias("cluster")), PART_KB, THREADS)


@query
def elbow(s, d):
    return cluster.elbow(_features(s, d), [2, 4, 8])


# generators, converters, codecs


@query
def rmat(s, d):
    return generate.rmat(s, 1000).edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def rand_local(s, d):
    return generate.rand_local(s, 500, dim=2).edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def rand_uniform(s, d):
    return generate.rand_local(s, 500).edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def grid_2d(s, d):
    return generate.grid(s, 400, 2).edges


@query
def grid_3d(s, d):
    return generate.grid(s, 343, 3).edges


@query
def rand_hyper(s, d):
    return generate.rand_hyper(s, 200).v2h


@query
def parmat(s, d):
    return generate.parmat(s, 512, 3000, no_self=True, no_duplicates=True)


@query
def add_weights(s, d):
    return generate.add_weights(part_sym(s, d)).edges


@query
def add_hyper_weights(s, d):
    return generate.add_hyper_weights(order_part(s, d)).v2h


@query
def el2csr(s, d):
    return convert.el2csr(part_next(s, d), undirected=True, weights=1).select("id", "offset", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"), F.size("ws").alias("n_weights"))


@query
def gen_el(s, d):
    return convert.gen_el(convert.el2csr(part_next(s, d)))


@query
def to_mesh(s, d):
    return convert.to_mesh(order_part(s, d))


@query
def compact_ids(s, d):
    return convert.compact(order_part(s, d).v2h, "v", "h")


@query
def log_summary(s, d):
    log = table(s, d, "orders").groupBy(F.lit("e").alias("engine"), (F.col("o_custkey") % 5).cast("string").alias("data"), F.lit("BFS").alias("algo"), F.element_at(F.array(F.lit("OG"), F.lit("SO"), F.lit("HC")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("reorder")).agg(F.avg("o_totalprice").alias("sec"))
    return _r(convert.summary(log), "seconds", "speedup")


def _codec(name: str, code: str) -> None:
    def run(s, d):
        return codec.decode(codec.encode(part_next(s, d), code), code).edges

    run.__name__ = name
    query(run)


_codec("codec_byte", "byte")
_codec("codec_rle", "rle")
_codec("codec_nibble", "nibble")


@query
def codec_bytes(s, d):
    return codec.encode(part_next(s, d)).agg(F.sum(F.length("data")).alias("bytes"), F.sum("degree").alias("m"))


@query
def codec_hyper(s, d):
    return codec.decode_hyper(codec.encode_hyper(order_part(s, d)))[0]


# sources and sinks: each query writes a graph in a format and reads it back


def _path(s, name: str) -> str:
    return Scratch(s, "files").path(name)


def _files(name: str, graph, write, read) -> None:
    def run(s, d):
        path = _path(s, name)
        write(graph(s, d), path)
        return read(s, path).edges

    run.__name__ = name
    query(run)


_files("io_csr", part_next, formats.write_csr, formats.read_csr)
_files("io_csr_weighted", part_weighted, formats.write_csr, lambda s, p: formats.read_csr(s, p, weighted=True))
_files("io_edgelist", part_next, formats.write_edgelist, formats.read_edgelist)
_files("io_snap", part_next, lambda g, p: formats.write_edgelist(g, p, sep="\t"), lambda s, p: formats.read_snap(s, p, symmetric=True))
_files("io_snap_weighted", part_weighted, formats.write_edgelist, lambda s, p: formats.read_snap(s, p, weighted=True))
_files("io_adjacency", part_sym, formats.write_adjacency, formats.read_adjacency)
_files("io_adjacency_weighted", part_weighted, formats.write_adjacency, formats.read_adjacency)
_files("io_triple", part_next, binary.write_triple, formats.read_triple)
_files("io_triple_weighted", part_weighted, binary.write_triple, lambda s, p: formats.read_triple(s, p, weighted=True))
_files("io_coded_byte", part_next, lambda g, p: binary.write_coded(g, p, "byte", symmetric=False), lambda s, p: binary.read_coded(s, p, "byte"))
_files("io_coded_rle", part_sym, lambda g, p: binary.write_coded(g, p, "rle"), lambda s, p: binary.read_coded(s, p, "rle"))
_files("io_coded_nibble", part_sym, lambda g, p: binary.write_coded(g, p, "nibble"), lambda s, p: binary.read_coded(s, p, "nibble"))
_files("io_coded_chunks", part_sym, lambda g, p: binary.write_coded(g, p, "byte", 16), lambda s, p: binary.read_coded(s, p, "byte", 16))


def _hyper_files(name: str, graph, write, read) -> None:
    def run(s, d):
        path = _path(s, name)
        write(graph(s, d), path)
        return read(s, path).v2h

    run.__name__ = name
    query(run)


def _order_part_weighted(s, d):
    return generate.add_hyper_weights(order_part(s, d))


_hyper_files("io_hyper", order_part, formats.write_hyper, formats.read_hyper)
_hyper_files("io_hyper_weighted", _order_part_weighted, formats.write_hyper, formats.read_hyper)
_hyper_files("io_hyper_binary", order_part, binary.write_hyper_binary, formats.read_hyper_binary)
_hyper_files("io_hyper_binary_weighted", _order_part_weighted, binary.write_hyper_binary, formats.read_hyper_binary)
_hyper_files("io_hyper_coded", order_part, binary.write_hyper_coded, binary.read_hyper_coded)


def _members(h, path: str) -> None:
    """A line a hyperedge, in the order of their ids."""
    lines = h.v2h.groupBy("h").agg(F.sort_array(F.collect_list("v")).alias("v")).orderBy("h")
    lines.select(F.array_join(F.transform("v", lambda x: x.cast("string")), " ").alias("value")).write.text(path)


_hyper_files("io_community", order_part, _members, formats.read_community)
_hyper_files("io_konect", order_part, lambda h, p: h.v2h.select(F.concat_ws(" ", "v", "h").alias("value")).write.text(p), lambda s, p: formats.read_konect(s, p))


@query
def community_to_clique(s, d):
    path = _path(s, "members")
    _members(order_part(s, d), path)
    return formats.read_community(s, path).expand().edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def konect_to_hyper(s, d):
    """From pairs to a hypergraph file, as it is read again."""
    pairs, path = _path(s, "pairs"), _path(s, "hyper")
    order_part(s, d).v2h.select(F.concat_ws(" ", "v", "h").alias("value")).write.text(pairs)
    formats.write_hyper(formats.read_konect(s, pairs), path)
    return formats.read_hyper(s, path).h2v


@query
def snap_to_adjacency(s, d):
    """From an edge list to adjacency text, as it is read again."""
    lines, path = _path(s, "lines"), _path(s, "adjacency")
    formats.write_edgelist(part_next(s, d), lines)
    formats.write_adjacency(formats.read_snap(s, lines, symmetric=True), path)
    return formats.read_adjacency(s, path).edges


@query
def adjacency_to_binary(s, d):
    text, stem = _path(s, "text"), _path(s, "binary")
    formats.write_adjacency(part_weighted(s, d), text)
    binary.write_triple(formats.read_adjacency(s, text), stem)
    return formats.read_triple(s, stem, weighted=True).edges


@query
def io_permutation(s, d):
    g, path = part_next(s, d), _path(s, "map")
    formats.write_perm(reorder.order_sort(g), 0, path)
    return formats.read_perm(s, path)


@query
def io_trace(s, d):
    g, path = _kept(part_sym(s, d)), _path(s, "trace")
    formats.write_trace(cluster.bfs_trace(g, [0]), 0, path)
    return formats.read_trace(s, f"{path}/sample=0", 0)


@query
def io_features(s, d):
    path = _path(s, "features")
    formats.write_features(_features(s, d), path)
    return formats.read_features(s, path).select("id", *[F.col("feat")[i].alias(f"f{i}") for i in range(3)])


@query
def io_log(s, d):
    path = _path(s, "log")
    times = table(s, d, "orders").groupBy((F.col("o_custkey") % 5).alias("run")).agg(F.max("o_orderkey").alias("sec"))
    times.select(F.concat(F.lit("Avg time of run "), F.col("run"), F.lit(" is "), F.col("sec")).alias("value")).write.text(path)
    return formats.read_log(s, path, engine="e", algo="BFS")


# further parts of the operator algebra


@query
def edge_map_pack(s, d):
    """Targets over the edges that stay, and how many edges the packed graph has."""
    g = part_next(s, d)
    out, packed = primitives.edge_map(g, _front(g), pack=F.col("dst") % 2 == 0)
    return out.join(packed.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query
def edge_map_no_output(s, d):
    g = part_next(s, d)
    return primitives.edge_map(g, _front(g), no_output=True).agg(F.count("*").alias("n"))


@query
def vertex_filter_data(s, d):
    g = part_next(s, d)
    return primitives.vertex_filter_data(_front(g).select("id", (F.col("id") % 7).alias("datum")), g.degrees(), F.col("out_deg") + F.col("datum") > 24)


@query
def transpose_matrix(s, d):
    cells = table(s, d, "part").select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.col("p_partkey").alias("value"))
    return primitives.transpose_matrix(cells).withColumnsRenamed({"row": "r", "col": "c", "value": "x"})


@query
def sorted_order(s, d):
    """Places in a sort by a key with many ties."""
    return primitives.ranks(part_next(s, d).edges, F.col("dst").desc(), F.col("src"), name="place")


@query
def bucket_rounds(s, d):
    """Vertices in buckets of out-degree, lowest first; odd ones move on by two buckets once: the bucket in which each is done."""
    start = part_next(s, d).degrees().select("id", F.floor(F.col("out_deg") / 8).alias("bucket"), F.lit(None).cast("long").alias("done"), (F.col("id") % 2 == 1).alias("waits"))

    def step(state, active, bucket):
        mine = F.coalesce(F.col("bucket") == bucket, F.lit(False))
        goes = mine & F.col("waits")
        return state.select("id", F.when(goes, F.col("bucket") + 2).when(mine, F.lit(None)).otherwise(F.col("bucket")).alias("bucket"), F.when(mine & ~F.col("waits"), F.lit(bucket)).otherwise(F.col("done")).cast("long").alias("done"), (F.col("waits") & ~mine).alias("waits"))

    return bucket_loop(start, step).select("id", "done")


@query
def frontier(s, d):
    """A loaded frontier, its rows filtered, with the messages that each would repeat."""
    g = part_next(s, d)
    front = gas.load_frontier(g, list(range(0, 100, 3))).filter("id % 2 = 0").withColumn("times", F.col("id") % 4)
    return gas.repeat_messages(front, "times").select("id", "nth")


@query
def hyper_reader_weighted(s, d):
    return hyper.hyper_dump(_order_part_weighted(s, d))


@query
def hyper_bipartite(s, d):
    return order_part(s, d).bipartite().edges


@query
def bfs_attributes(s, d):
    """Levels from three sources on the directed graph; null where a source doesn't reach."""
    g = _kept(part_next(s, d))
    return cluster.attributes(cluster.bfs_trace(g, [0, 1, 2]), g.vertices, 3).select("id", *[F.col("feat")[i].alias(f"f{i}") for i in range(3)])


@query
def bfs_starters(s, d):
    """The first ten vertices with out-edges in the order of a hash."""
    ids = cluster.starters(part_next(s, d), 10)
    return table(s, d, "part").filter(F.col("p_partkey").isin(ids)).select(F.col("p_partkey").alias("id"))
