"""Readers undo writers; codecs undo themselves."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import HyperGraph, PropertyGraph
from graphloom.operators import cluster, generate
from graphloom.operators.traverse import bfs
from graphloom.sources import binary, codec, formats


@pytest.fixture(scope="module")
def g(spark):
    rng = random.Random(3)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(80)) if a != b})
    return PropertyGraph(spark.range(33), spark.createDataFrame(pairs, "src long, dst long"))


@pytest.fixture(scope="module")
def gw(g):
    return generate.add_weights(g)


def same(a, b):
    cols = sorted(a.edges.columns)
    assert sorted(a.edges.select(cols).collect()) == sorted(b.edges.select(cols).collect())
    assert a.vertices.count() == b.vertices.count()


def test_csr(spark, g, gw, tmp_path):
    formats.write_csr(g, f"{tmp_path}/a.csr")
    same(g, formats.read_csr(spark, f"{tmp_path}/a.csr"))
    formats.write_csr(gw, f"{tmp_path}/b.csr", ascending=True)
    same(gw, formats.read_csr(spark, f"{tmp_path}/b.csr", weighted=True))
    np.array([3, 9, 0, 1, 2], "<u4").tofile(f"{tmp_path}/short.csr")
    with pytest.raises(Exception):
        formats.read_csr(spark, f"{tmp_path}/short.csr").edges.count()


def test_triple(spark, g, tmp_path):
    formats.write_csr(g, f"{tmp_path}/a.csr")
    raw = np.fromfile(f"{tmp_path}/a.csr", "<u4")
    (tmp_path / "t.config").write_text("33\n")
    raw[2 : 2 + 33].tofile(f"{tmp_path}/t.idx")
    raw[2 + 33 :].tofile(f"{tmp_path}/t.adj")
    same(g, formats.read_triple(spark, f"{tmp_path}/t"))


def test_edge_lists(spark, tmp_path):
    (tmp_path / "x.el").write_text("# head\n0 1\n2 2\n1 3\n")
    got = formats.read_edgelist(spark, f"{tmp_path}/x.el")
    assert sorted(map(tuple, got.edges.collect())) == [(0, 1), (1, 3)] and got.vertices.count() == 4
    assert formats.read_snap(spark, f"{tmp_path}/x.el", symmetric=True).edges.count() == 4
    formats.write_edgelist(got, f"{tmp_path}/y", sep="\t")
    same(got, formats.read_edgelist(spark, f"{tmp_path}/y"))


def test_adjacency(spark, g, gw, tmp_path):
    for i, x in enumerate((g, gw)):
        formats.write_adjacency(x, f"{tmp_path}/adj{i}")
        same(x, formats.read_adjacency(spark, f"{tmp_path}/adj{i}"))
    (tmp_path / "bad").write_text("AdjacencyGraph\n2\n2\n0\n1\n0\n")
    with pytest.raises(ValueError):
        formats.read_adjacency(spark, f"{tmp_path}/bad")


def test_hypergraphs(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (0, 2)], "v long, h long")
    h = HyperGraph.symmetric(pairs, spark.range(5), spark.range(3))
    for i, x in enumerate((h, generate.add_hyper_weights(h))):
        formats.write_hyper(x, f"{tmp_path}/h{i}")
        y = formats.read_hyper(spark, f"{tmp_path}/h{i}")
        cols = sorted(x.v2h.columns)
        assert sorted(y.v2h.select(cols).collect()) == sorted(x.v2h.select(cols).collect())
        assert sorted(y.h2v.select(cols).collect()) == sorted(x.h2v.select(cols).collect())
    (tmp_path / "c.txt").write_text("10 30\n30 20\n")
    c = formats.read_community(spark, f"{tmp_path}/c.txt")
    assert sorted(map(tuple, c.v2h.collect())) == [(0, 0), (1, 1), (2, 0), (2, 1)]
    (tmp_path / "k.txt").write_text("% head\n5 100 3 9\n7 100 4 9\n7 200 5 9\n")
    k = formats.read_konect(spark, f"{tmp_path}/k.txt", weighted=True)
    assert sorted(map(tuple, k.v2h.select("v", "h", "w").collect())) == [(0, 0, 3), (1, 0, 4), (1, 1, 5)]
    v2h, h2v = codec.decode_hyper(codec.encode_hyper(h))
    assert sorted(v2h.collect()) == sorted(h.v2h.select("v", "h").collect()) and h2v.count() == 5


def test_perm_trace_features_log(spark, g, tmp_path):
    perm = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "old_id long, new_id long")
    formats.write_perm(perm, 5, f"{tmp_path}/p")
    assert sorted(formats.read_perm(spark, f"{tmp_path}/p").collect()) == sorted(perm.collect())
    sym = g.symmetrize()
    trace = cluster.bfs_trace(sym, [0])
    formats.write_trace(trace, 33, f"{tmp_path}/t")
    assert sorted(formats.read_trace(spark, f"{tmp_path}/t/sample=0", 0).collect()) == sorted(trace.collect())
    feats = cluster.embed(trace, sym.vertices, 1)
    formats.write_features(feats, f"{tmp_path}/f")
    assert sorted(formats.read_features(spark, f"{tmp_path}/f").collect()) == sorted(feats.collect())
    (tmp_path / "log").write_text("Running time: 2.5\nother 7\nAvg : 1.5\n")
    assert sorted(r.sec for r in formats.read_log(spark, f"{tmp_path}/log", algo="BFS").collect()) == [1.5, 2.5]
    formats.write_ecc(bfs(sym, 0).select("id", F.coalesce("level", F.lit(0)).alias("ecc")), f"{tmp_path}/e")
    assert spark.read.text(f"{tmp_path}/e").count() == 33


def plain_code(vertex, nbrs, code):
    """A value at a time: what the coded rows must be."""
    bits = 3 if code == "nibble" else 7

    def groups(value, first=False, minus=False):
        width, out = bits - first, []
        while True:
            part, value = value % (1 << width), value >> width
            out.append(part + (minus << width) * (first and not out) + (bool(value) << bits))
            width = bits
            if not value:
                return out

    if not nbrs:
        return b""
    gaps = [b - a for a, b in zip(nbrs, nbrs[1:])]
    out = groups(abs(nbrs[0] - vertex), True, nbrs[0] < vertex)
    if code == "rle":
        while gaps:
            size = max(1, (gaps[0].bit_length() + 7) // 8)
            run = [x for _, x in zip(range(64), itertools.takewhile(lambda x: max(1, (x.bit_length() + 7) // 8) == size, gaps))]
            out += groups((size - 1) * 64 + len(run) - 1) + [b for x in run for b in x.to_bytes(size, "little")]
            gaps = gaps[len(run) :]
        return bytes(out)
    out += [x for g in gaps for x in groups(g)]
    return bytes(out) if code == "byte" else bytes(a + b * 16 for a, b in itertools.zip_longest(out[::2], out[1::2], fillvalue=0))


def test_codecs(spark, g):
    rng = random.Random(5)
    for code in ("byte", "rle", "nibble"):
        for _ in range(200):
            ids = [rng.randrange(10**6) for _ in range(rng.randrange(1, 5))]
            rows = [sorted(rng.sample(range(10 ** rng.choice([3, 7])), rng.choice([0, 1, 2, 30, 150]))) for _ in ids]
            coded = codec.encode_rows(ids, rows, code)
            assert coded == [plain_code(v, r, code) for v, r in zip(ids, rows, strict=True)]
            assert [x.tolist() for x in codec.decode_rows(ids, [len(r) for r in rows], coded, code)] == rows
        for chunk in (None, 2):
            got = codec.decode(codec.encode(g, code, chunk), code)
            assert sorted(got.edges.collect()) == sorted(g.edges.collect())


@pytest.mark.parametrize("code,chunk", [("byte", None), ("rle", None), ("nibble", 2), ("byte", 2)])
def test_coded_files(spark, g, tmp_path, code, chunk):
    for i, symmetric in enumerate((True, False)):
        binary.write_coded(g, f"{tmp_path}/c{i}", code, chunk, symmetric)
        same(g, binary.read_coded(spark, f"{tmp_path}/c{i}", code, chunk))
    assert not [x for x in tmp_path.iterdir() if "pieces" in x.name]
    pairs = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (2, 1), (3, 1), (0, 2)], "v long, h long")
    h = HyperGraph.symmetric(pairs, spark.range(5), spark.range(3))
    binary.write_hyper_coded(h, f"{tmp_path}/h", code, chunk)
    got = binary.read_hyper_coded(spark, f"{tmp_path}/h", code, chunk)
    assert sorted(got.v2h.collect()) == sorted(pairs.collect()) == sorted(got.h2v.select("v", "h").collect())
    with open(f"{tmp_path}/c0", "r+b") as file:
        file.truncate(300)
    with pytest.raises(Exception):
        binary.read_coded(spark, f"{tmp_path}/c0", code, chunk).edges.count()


def test_coded_layout(spark, tmp_path):
    """Bytes by hand: n, m, bytes; offsets; degrees; a row in chunks begins with the place of its second chunk."""
    g = PropertyGraph(spark.range(4), spark.createDataFrame([(0, 1), (0, 2), (0, 3), (2, 1)], "src long, dst long"))
    binary.write_coded(g, f"{tmp_path}/a", chunk=2)
    raw = (tmp_path / "a").read_bytes()
    assert np.frombuffer(raw, "<i8", 3).tolist() == [4, 4, 8]
    assert np.frombuffer(raw, "<u4", 9, 24).tolist() == [0, 7, 7, 8, 8, 3, 0, 1, 0]
    assert raw[60:] == bytes([6, 0, 0, 0, 1, 1, 3, 65])


def test_binary_writers(spark, g, gw, tmp_path):
    for i, x in enumerate((g, gw)):
        binary.write_triple(x, f"{tmp_path}/t{i}")
        same(x, formats.read_triple(spark, f"{tmp_path}/t{i}", weighted=x.weighted))
    pairs = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (0, 2)], "v long, h long")
    h = HyperGraph.symmetric(pairs, spark.range(5), spark.range(3))
    for i, x in enumerate((h, generate.add_hyper_weights(h))):
        binary.write_hyper_binary(x, f"{tmp_path}/h{i}")
        y = formats.read_hyper_binary(spark, f"{tmp_path}/h{i}")
        for side in ("v2h", "h2v"):
            cols = sorted(getattr(x, side).columns)
            assert sorted(getattr(y, side).select(cols).collect()) == sorted(getattr(x, side).select(cols).collect())
    with pytest.raises(Exception):
        binary.write_triple(PropertyGraph(g.vertices, g.edges.select("src", (F.col("dst") - 100).alias("dst"))), f"{tmp_path}/bad")


def test_flat_files_are_never_broadcast(spark, gw, tmp_path):
    """Spark takes a file's ranges for a handful of rows: a join would send a whole weight array through the driver."""
    formats.write_csr(gw, f"{tmp_path}/w.csr")
    binary.write_triple(gw, f"{tmp_path}/w")
    h = HyperGraph.symmetric(gw.edges.select(F.col("src").alias("v"), F.col("dst").alias("h"), "w"), gw.vertices, gw.vertices)
    binary.write_hyper_binary(h, f"{tmp_path}/h")
    binary.write_coded(gw, f"{tmp_path}/c")
    hyper = formats.read_hyper_binary(spark, f"{tmp_path}/h")
    read = [formats.read_csr(spark, f"{tmp_path}/w.csr", weighted=True).edges, formats.read_triple(spark, f"{tmp_path}/w", weighted=True).edges, hyper.v2h, hyper.h2v, binary.read_coded(spark, f"{tmp_path}/c").edges]
    assert all("BroadcastHashJoin" not in x._jdf.queryExecution().executedPlan().toString() for x in read)
    for x in read[:3]:
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, gw.edges.collect()))
