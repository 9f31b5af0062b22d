"""The pipeline against a brute-force version on the smallest tables."""

import re

import corpus_pipeline
from test_operators import brute_components, sets, squeeze, targets


def test_pipeline(spark, data):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    bench = [sets(r.text, 5) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = [d for d in docs if re.search(r"[A-Za-zÀ-ÿ]", d[1] or "")]
    first = {}
    for d in sorted(docs, key=lambda d: d[0]):
        first.setdefault(squeeze(d[1]), d)
    docs = list(first.values())
    _, label = brute_components(docs, 5, 80)
    docs = [d for d in docs if label[d[0]] == d[0]]
    docs = [d for d in docs if not any(q and 100 * len(q & sets(d[1], 5)) >= 80 * len(q) for q in bench)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    assert set(got) == {d[0] for d in docs}
    size = {}
    for _, t, _, s in docs:
        size[s] = size.get(s, 0) + len(t.split())
    order = sorted(size)
    want = dict(zip(order, targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2.0), strict=True))
    for i, t, _, s in docs:
        assert (got[i].size, got[i].source_size) == (len(t.split()), size[s]) and abs(got[i].target - want[s]) < 1e-6
    for s in order:
        mine = [got[i] for i, _, _, x in docs if x == s]
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine)


def test_stages_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
        assert stage(spark, docs.limit(0), data).count() == 0
