"""Queries read all orders: no keys are filtered, and counts over whole tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def test_no_query_reads_some_orders_only():
    assert not [n for n, sql in entry.oracle_sql().items() if re.search(r"(l_orderkey|o_orderkey) % \d+ = ", sql)]
    assert not [n for n in entry.queries() if n.endswith(("_whole", "_sparse"))]


@pytest.mark.parametrize("name", ["components", "hyper_degrees", "codec_byte", "ecc_tk"])
def test_whole(spark, data, con, name):
    got = entry.queries()[name](spark, data)
    for t in ("part", "lineitem", "orders"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in got.columns) for r in cur.fetchall()), key=repr)


def test_whole_without_twin(spark, data, con):
    queries = entry.queries()
    incidences = con.execute("SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)").fetchone()[0]
    assert queries["add_hyper_weights"](spark, data).count() == incidences
    assert queries["add_weights"](spark, data).count() == 8130  # FIXTURES.md, symmetric edges of sf0.001
