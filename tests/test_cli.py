"""The command line on small files."""

import pytest

from graphloom.__main__ import main, parser
from graphloom.graph import PropertyGraph
from graphloom.sources import formats


def test_convert_and_reorder(spark, tmp_path):
    (tmp_path / "a.el").write_text("0 1\n0 2\n0 3\n2 1\n")
    main(["convert", f"{tmp_path}/a.el", f"{tmp_path}/a.csr", "--from", "edgelist", "--symmetric"])
    assert formats.read_csr(spark, f"{tmp_path}/a.csr").edges.count() == 8
    main(["reorder", f"{tmp_path}/a.csr", f"{tmp_path}/b", "--order", "so", "--to", "coded", "--map", f"{tmp_path}/map"])
    perm = {r.old_id: r.new_id for r in formats.read_perm(spark, f"{tmp_path}/map").collect()}
    assert perm == {0: 0, 2: 1, 1: 2, 3: 3}
    main(["convert", f"{tmp_path}/b", f"{tmp_path}/c", "--from", "coded", "--to", "adjacency"])
    assert sorted(map(tuple, formats.read_adjacency(spark, f"{tmp_path}/c").edges.collect())) == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0)]


def test_query(spark, data, tmp_path):
    main(["query", "degree_hist", "--data", data, "--out", f"{tmp_path}/q"])
    assert spark.read.parquet(f"{tmp_path}/q").columns == ["out_deg", "n"]
    with pytest.raises(SystemExit):
        parser().parse_args(["reorder", "a", "b", "--order", "none"])
    assert PropertyGraph.of(spark.createDataFrame([(0, 2)], "src long, dst long")).vertices.count() == 3
