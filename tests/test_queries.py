"""Queries against their SQL twins on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

QUICK = [
    "degree_hist", "in_out_degree", "edge_map_data", "edge_map_filter", "prefix_scan", "pack_index", "hash_int32", "order_so", "order_dbg", "order_co", "relabel_weighted", "locality_w5", "modularity",
    "bfs_levels", "components_shortcut", "sssp", "pagerank10", "triangles_per_vertex", "kcore", "mis", "bc", "radii", "hyper_pagerank1", "clique_expand", "nibble_t3", "sweep", "kmeans_step", "el2csr", "codec_bytes", "log_summary",
    "io_csr_weighted", "io_triple", "io_coded_chunks", "io_hyper_binary_weighted", "io_community", "io_trace", "edge_map_pack", "bucket_rounds", "hyper_sssp", "rmat", "rand_uniform", "rand_hyper", "add_weights",
]


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 100


@pytest.mark.parametrize("name", QUICK)
def test_twin(spark, data, name):
    got = entry.queries()[name](spark, data)
    rows = got.collect()
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(r[names.index(c)] for c in got.columns) for r in cur.fetchall()) if rows and all(x is not None for r in rows for x in r) else sorted((tuple(r[names.index(c)] for c in got.columns) for r in cur.fetchall()), key=repr)
    mine = sorted(map(tuple, rows)) if rows and all(x is not None for r in rows for x in r) else sorted(map(tuple, rows), key=repr)
    assert len(want) == len(mine)
    for a, b in zip(want, mine, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-8)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
