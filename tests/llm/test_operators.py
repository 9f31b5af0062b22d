"""Each operator against a brute-force version on small tables, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, exact_dedup, html_text, language, license_scan, mixing, ngram_join, pii, token_files, url_filter

DOCS = "doc_id long, text string, lang string, source string, n long, label string, sha string, kept boolean, tokens string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 1, "x", "y", True, "z") for i, t, lang, src in rows], DOCS)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = [words(rng, rng.randrange(30, 80), 5000) for _ in range(12)]
    out = []
    for i, t in enumerate(base):
        out.append((i, t, "en", f"s{i % 3}"))
        edited = t.split()
        edited[rng.randrange(len(edited))] = "edit"
        out.append((100 + i, " ".join(edited), "en", "s0"))
    out += [(200, base[0], "en", None), (201, base[0].replace(" ", "\n\t "), "fr", "s1"), (202, base[0].upper(), None, "s1")]
    out += [(300, None, None, None), (301, "", "en", "s0"), (302, "  \n ", "en", "s0"), (303, "one", "en", "s0"), (304, "one", "en", "s0"), (305, "two words", "de", "s2")]
    out += [(400, words(rng, 20000, 9000), "en", "s2"), (401, "w1 " * 5000, "en", "s2")]
    out += [(None, base[1], "en", "s1"), (None, "lonely text here", "en", None), (500, "same row", "en", "s1"), (500, "same row", "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs, rows, none):
    got = exact_dedup.exact_dedup(docs, fan_in=2).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(squeeze(t), []).append(i)
    want = sorted(
        (str(i), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest())
        for t, g in groups.items()
        for i in g
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(squeeze(r.text) for r in kept.collect()) == sorted(groups)


def sets(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    own = {}
    for i, t, *_ in rows:
        if i is not None and (i not in own or (t is not None and (own[i] is None or t < own[i]))):
            own[i] = t
    shingled = {i: sets(t, k) for i, t in own.items()}
    label = {i: i for i in own}
    ids = sorted(own)
    links = [(a, b) for a in ids for b in ids if a < b and shingled[a] and 100 * len(shingled[a] & shingled[b]) >= percent * len(shingled[a] | shingled[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return shingled, label


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, docs, rows, none, k, percent):
    shingled, label = brute_components(rows, k, percent)
    got = ngram_join.jaccard_components(docs, words=k, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(shingled[r.doc_id]), label[r.doc_id])
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.keep_one(docs, words=k, percent=percent)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted(i for i, c in label.items() if i == c)


def test_jaccard_join_of_a_dense_group(spark):
    """A large group of near copies: chains of links, and pairs on both sides of the limit."""
    rng = random.Random(4)
    text = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(text)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(120)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(t), "en", "s"))
    _, label = brute_components(rows, 3, 90)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs_of(spark, rows), words=3, percent=90).collect()}
    assert got == label and 1 < len(set(label.values())) < 150


def test_jaccard_join_in_slices(spark, monkeypatch):
    """Documents that share passages without being similar: many postings, few links, and little disk at a time."""
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(120)]
    rows = [(i, " ".join(rng.sample(pool, 10)), "en", "s") for i in range(400)]
    rows += [(400 + i, rows[i][1] + f" and{i}", "en", "s") for i in range(0, 60, 3)] + [(500, rows[7][1], "en", "s")]
    _, label = brute_components(rows, 5, 80)
    monkeypatch.setattr(ngram_join, "SLICE_ROWS", 2000, raising=False)
    monkeypatch.setattr(ngram_join, "SLICE_PAIRS", 4, raising=False)
    block = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    write, sizes = ngram_join.Scratch.table, []

    def shuffle_bytes():
        files = block.getAllFiles()
        return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))

    def table(self, df, name):
        out = write(self, df, name)
        sizes.append(shuffle_bytes())
        return out

    docs = docs_of(spark, rows)
    docs.count()
    ngram_join.free_shuffles(spark)
    time.sleep(2)  # files of earlier tests go
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffle_bytes()
        monkeypatch.setattr(ngram_join.Scratch, "table", table)
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, words=5, percent=80).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == label and len(set(label.values())) == 400
    most = (max(sizes) - before) / sum(len(t) for _, t, *_ in rows)
    print(f"shuffle files: {most:.2f} x text")
    assert most < 1.5


def test_similar():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.8, 1)], rng.integers(0, 2**63, rng.integers(0, 15), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert ngram_join.similar(a, b, 90) == (100 * both >= 90 * (len(a) + len(b) - both))


def test_decontamination(spark, none):
    rng = random.Random(3)
    items = [(i, words(rng, n, 3000)) for i, n in enumerate([4, 5, 8, 20, 40, 60])] + [(6, None), (7, ""), (8, "Upper CASE item here now ok")]
    rows = [(i, words(rng, 300, 3000), "en", "s") for i in range(8)]
    for i, (_, t) in enumerate(items):
        if t:
            w = t.split()
            rows.append((100 + i, f"{words(rng, 50)} {t} {words(rng, 50)}", "en", "s"))
            rows.append((200 + i, " ".join(w[: int(len(w) * 0.85) + 1]) + " tail of text", "en", "s"))
            rows.append((300 + i, " ".join(w[: len(w) // 2]), "en", "s"))
    rows += [(400, None, None, None), (None, items[3][1], "en", None), (401, items[3][1].upper() + "\n", "en", "s"), (402, "upper case", "en", "s")]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t, *_ in rows:
        for j, b in items:
            if q := sets(b, 5):
                width = len(next(iter(q)))
                w = [x.lower() for x in (t or "").split()]
                there = {tuple(w[a : a + width]) for a in range(len(w) - width + 1)}
                if 100 * len(q & there) >= 80 * len(q):
                    want.append((str(i), j, len(q & there), len(q)))
    got = decontaminate.contained_items(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.shared, r.item_shingles) for r in got) == sorted(want)
    assert decontaminate.contained_items(none, bench).count() == 0
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0
    clean = decontaminate.clean_rows(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, *_ in rows if str(i) not in {w[0] for w in want})


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    bench = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i}") for i in range(5)], "item_id long, text string")
    docs = docs_of(spark, [(i, f"x alpha{i} beta{i} gamma{i} delta{i} eps{i} y", "en", "s") for i in range(5)])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, bench).collect()) == [(i, i) for i in range(5)]


def test_url_filter(spark):
    rng = random.Random(6)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "badexample.org", "com", "x.com", "EXAMPLE.org", "example.org:80", ""]
    paths = ["", "/", "/es/", "/es/a", "/en/1", "/en/12/x", "/e", "/fr/", "/de/q"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/es/', '#top'])}" for _ in range(300)] + [None, "", "no-scheme.org/es/", "http://a.example.org/es/"] * 2
    urls += ["http://example.org/es/" + "ab" * 100_000] * 3 + ["http://" + "a." * 5_000 + "example.org/x", "http://example.org/e" + "?" * 50_000]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "/e", "block")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_filter.apply_rules(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[2], best[3] if best else "allow")
    assert url_filter.apply_rules(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_filter.apply_rules(pages, spark.createDataFrame([], "host string, path string, verdict string")).filter("rule is null").count() == len(urls)


def test_language(spark, data, none):
    table = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language.fit(table.filter("doc_id % 2 = 0"))
    held = table.filter("doc_id % 2 = 1 and length(text) > 60")
    blind = language.identify(held, model, "doc_id", "text").join(held.select(F.col("doc_id").alias("id"), F.col("lang").alias("truth")), "id")
    assert blind.filter("lang = truth").count() >= 0.98 * held.count()
    fused = language.identify_documents(table, model)
    short = fused.join(table.select("doc_id", "text"), "doc_id").filter("rejected and length(text) > 60")
    assert short.count() == 0 and fused.count() == table.count()
    junk = ["".join(random.Random(j).choice("bcdfghjklmnpqrstvwxzqj") for _ in range(300)) for j in range(3)] + ["Съешь же ещё этих мягких французских булок да выпей чаю. " * 4, "這是一個測試" * 20]
    foreign = docs_of(spark, [(j, t, "en", "s") for j, t in enumerate(junk)])
    assert [r.rejected for r in language.identify_documents(foreign, model).collect()] == [True] * len(junk)
    odd = docs_of(spark, [(1, None, "en", None), (2, "", "de", "s"), (3, "12 %% !!", "fr", "s"), (None, "der und die das nicht", "xx", "s"), (4, "the of and", None, None)])
    got = {r.doc_id: r for r in language.identify_documents(odd, model).collect()}
    assert [got[i].rejected for i in (1, 2, 3)] == [True] * 3 and not got[None].rejected and got[None].lang == "de"
    assert language.identify_documents(none, model).count() == 0
    kept = language.accepted_rows(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 4}


def test_language_evidence(spark):
    flat = np.zeros((language.TABLE, 4), np.float32)
    rows = [(i, "abc", "de-AT" if i < 3 else None, "h1" if i < 5 else "h2", "fr" if i >= 5 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r.id: r for r in language.identify(df, flat, "id", "text", F.col("declared"), F.col("host"), F.col("suffix")).collect()}
    assert got[0].lang == "de" and abs(got[0].posterior - 0.9) < 1e-4  # text of no known language keeps a little
    assert got[6].lang == "fr" and abs(got[6].posterior - 0.8) < 1e-4
    html = spark.createDataFrame([('<!doctype html><HTML class=x LANG="pt-BR"><p>',), ("<p lang=de>",), (None,)], "h string")
    assert [r[0] for r in html.select(language.markup_language(F.col("h"))).collect()] == ["pt-BR", None, None]


def test_markup_language_of_a_late_tag(spark):
    late = spark.createDataFrame([(f"<!-- {'licence ' * 2000}--><html {'data-x=1 ' * 600}lang=fr><p>",)], "h string")
    assert late.select(language.markup_language(F.col("h"))).first()[0] == "fr"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies</div><div id="main-7" class="layout has-sidebar"><div class="sidebar">Side <p>links</p></div>
<div class="post-body-33"><h2>Head &amp; line</h2><p>First   para<b>graph</b> &eacute;&excl; with text.<p>Second<br>line, of the main text.</p>
<script>var a = "<p>no</p>";</script><form><input><p>Sign up</p></form><ul><li>one<li>two</ul><!-- <p>hidden</p> --></div>
<section class="comments"><p>Nice post, dear author, thank you very much indeed.</p></section></div><footer>(c)</footer></body></html>"""


def test_html(spark):
    want = "Head & line\nFirst paragraph é! with text.\nSecond line, of the main text.\none\ntwo"
    rows = [(i, "http://a.org/1", PAGE.replace("33", str(i))) for i in range(4)]
    rows += [(10, None, None), (11, "http://b.org", ""), (12, "http://c.org", "plain &lt;text&gt;"), (13, None, "<article><h1>A</h1><p>B<p>C</article><footer>F</footer>"), (14, "http://d.org", "<p>" + "x " * 200000), (15, "http://d.org", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, path long")
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert len(got) == len(rows)
    for i in range(4):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert [got[i].text for i in (10, 11, 12, 13)] == ["", "", "plain <text>", "A\nB\nC"]
    assert got[14].n_chars == 399999 and got[15].text == "deep"
    assert html_text.extract_text(pages.limit(0)).count() == 0
    assert {r.host: r.path for r in html_text.host_paths(pages).collect()}["a.org"].endswith("/div.post-body")


def test_html_by_the_path_of_the_host(spark):
    """A page whose own best box isn't the article gets the article by the other pages' votes."""
    body, extra = '<div class="post-body-{}"><p>{}</p></div>', '<div class="extra"><p>{}</p></div>'
    usual = [(i, "http://h.org/x", f"<body>{body.format(i, 'Text of the article, with a clause. ' * 9)}{extra.format('Something else, short.')}</body>") for i in range(6)]
    odd = f"<body>{body.format(77, 'Short article, this one.')}{extra.format('A longer box, with more words than it.')}</body>"
    pages = spark.createDataFrame([*usual, (9, "http://h.org/y", odd), (10, "http://other.org/", odd)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got[9] == "Short article, this one." and got[10] != got[9]
    assert html_text.extract(odd, None) == got[10]


def test_html_headers_and_formulas(spark):
    page = "<body><header><h1>Site</h1></header><article><header><h2>Headline</h2></header><p>Words, then <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here.</p></article></body>"
    assert html_text.extract(page, None) == "Headline\nWords, then x=1 here."


@pytest.mark.parametrize(
    "page",
    ['<a "' * 250000, "<b>" * 150000 + "</x>" * 150000, "<b>" * 100000 + "<h1>" * 100000, "<p><table>" + "<b>" * 80000 + "<h1></h1>" * 80000, "<div>t, u." * 100000, "<ul>" + "<li>x<b>" * 100000, "<!" * 500000, '<a class="x ' * 80000, "<a '\"x>" * 100000],
)
def test_html_of_hostile_pages(page):
    start = time.time()
    html_text.vote(page)
    html_text.extract(page, None)
    assert time.time() - start < 30


def test_html_of_nested_articles(spark):
    def long(w):
        return f"{w} text goes on, and on. " * 60

    nested = f"<body><article><h1>Head</h1><p>Lead of it.</p><div class=body><p>{long('Body')}</p></div></article><footer>F</footer></body>"
    parts = f"<body><main><article><section class=a><p>{long('First')}</p></section><section class=b><p>Second part.</p></section><nav>Menu</nav></article></main></body>"
    inner = f"<body><article><p>Outer words.</p><article class=part><p>{long('Inner')}</p></article></article></body>"
    pages = spark.createDataFrame([(i, f"http://{h}.org", p) for i, (h, p) in enumerate([("n", nested), ("p", parts), ("i", inner)])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got == {0: f"Head\nLead of it.\n{long('Body').strip()}", 1: f"{long('First').strip()}\nSecond part.", 2: f"Outer words.\n{long('Inner').strip()}"}
    six = "<body>" + "".join(f"<div class=c{w}><p>{'x, ' * n}</p></div>" for w, n in zip("abcdef", range(60, 0, -10), strict=True)) + "</body>"
    assert len(html_text.vote(six)) == 7


def test_html_of_the_tables(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r in html_text.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        import html

        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


def targets(sizes, weights, budget, most):
    """Shares of the budget by weight, by repeated capping."""
    capped = [False] * len(sizes)
    while True:
        left = budget - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        total = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        share = [most * s if c else left * w / total for s, w, c in zip(sizes, weights, capped, strict=True)]
        over = [not c and t > most * s for s, c, t in zip(sizes, capped, share, strict=True)]
        if not any(over):
            return share
        capped = [c or o for c, o in zip(capped, over, strict=True)]


def brute_mix(rows, share=1.5, most=2):
    """doc_id to taken, by a plain sort of each source's documents by Pareto rank."""
    by = {}
    for i, t, _, s in rows:
        by.setdefault(s, []).append((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    order, out = sorted(by, key=lambda s: (s is None, s or "")), {}
    sizes = [sum(n for _, n in by[s]) for s in order]
    for s, size, target in zip(order, sizes, targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], share * sum(sizes), most), strict=True):
        whole = min(most, int(target / size)) if size else 0
        lacks, certain = target - whole * size, set()
        while True:  # those whose odds reach one are certain
            rest = [(i, n) for i, n in by[s] if i not in certain and n]
            rate = (lacks - sum(n for i, n in by[s] if i in certain)) / max(1, sum(n * n for _, n in rest))
            more = {i for i, n in rest if rate * n >= 1}
            if not more:
                break
            certain |= more
        lacks -= sum(n for i, n in by[s] if i in certain)

        def rank(doc):
            u = (int(hashlib.md5(f"mix{doc[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = rate * doc[1]
            return u / (1 - u) / (p / (1 - p)) if p > 0 else 1e300

        upto = 0
        for i, n in sorted((d for d in by[s] if d[0] not in certain), key=lambda d: (rank(d), d[0])):
            upto += n
            out[i] = n * (whole + (lacks > 0 and upto - n / 2 <= lacks))
        out |= {i: n * (whole + 1) for i, n in by[s] if i in certain}
    return out


def test_mixing_against_a_plain_sort(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 5)), "en", rng.choice(["a", "b", "c", "c", None])) for i in range(400)]
    got = {r.doc_id: r.taken for r in mixing.mix_sources(docs_of(spark, rows)).collect()}
    want = brute_mix(rows)
    assert got == want
    # longer documents are taken more often than others of their source: odds go by size
    size = {i: len(t.split()) for i, t, _, _ in rows}
    some = [i for i, _, _, s in rows if s == "c"]
    once = min(got[i] // size[i] for i in some)
    taken = [size[i] for i in some if got[i] > once * size[i]]
    assert 0 < len(taken) < len(some) and sum(taken) / len(taken) > 1.2 * sum(size[i] for i in some) / len(some)


def test_mixing(spark, docs, rows, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2.0), strict=True))
    assert abs(sum(want.values()) - 1.5 * sum(size.values())) < 1e-6
    by = {(r.source_size, round(r.target, 6)) for r in got}
    assert by == {(size[s], round(want[s], 6)) for s in order}
    for s in order:
        mine = [r for r in got if r.source_size == size[s]]
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine) / 2 + 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(docs.filter("doc_id in (300, 301, 302)")).agg(F.sum("taken")).first()[0] == 0


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1], 450, 2) == [200, 250 * 2 / 3, 250 / 3]
    assert targets([10, 1000], [5, 2], 1515, 2) == [20, 1495]


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(9)
    pieces = ["a.b@c.de", "@", "x@y", "..", ".com", "é", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (386) 555-3733", "+49", "12", " ", "-", "+", "(", "00", "300.001.2.3", "@a.b@c.d"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == brute_spans(text), text
    for long in ("9" * 200000, "a" * 200000 + "@", "a@" * 50000, "1." * 100000, "+1" * 50000):
        pii.base_spans(long)


def test_pii(spark, docs, rows, none):
    rng = random.Random(5)
    more = [(1000 + i, f"{words(rng, 20, 40)} Zorblax wrote from zed@mail.example.com and {words(rng, 20, 40)} n{i}", "en", "s") for i in range(6)]
    more += [(2000 + i, words(rng, 30, 40), "en", "s") for i in range(60)] + [(3000, more[0][1], "en", "s"), (None, more[1][1], None, None), (3001, "call +1 (386) 555-3733 or 1.2.3.4 é a@b.co", "en", "s")]
    table = docs.unionByName(docs_of(spark, more))
    got = pii.digest(pii.find_spans(table)).collect()
    every = rows + more
    assert len(got) == len(every)
    texts = {}
    for i, t, *_ in every:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        ok = False
        for t in texts[r.doc_id]:
            base = brute_spans(t)
            spans = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            counts = [sum(k == kind for k, *_ in base) for kind in pii.KINDS]
            ok |= r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and set(filter(None, spans.split(","))) <= set(r.spans.split(","))
        assert ok, r
    one = next(r for r in got if r.doc_id == 1000)
    at = more[0][1].index("Zorblax")
    assert f"remove:{at}:{at + 7}" in one.spans and next(r for r in got if r.doc_id == 3000).spans == one.spans
    assert next(r for r in got if r.doc_id == 2000).spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert "Zorblax" not in clean[1000] and "[email]" in clean[1000] and clean[300] is None and clean[2000] == texts[2000][0]
    assert clean[3001] == "call [phone] or [ip] é [email]"
    assert pii.digest(pii.find_spans(none)).count() == 0


def test_pii_of_rare_entities(spark):
    rng = random.Random(6)
    texts = [f"{words(rng, 20, 40)} t{i}" for i in range(1200)]
    texts[7] = f"w1 w2 Quibblix wrote from one@mail.example.com t7 {words(rng, 10, 40)}"
    texts[8] = f"w3 Brandlum called, two@mail.example.com {words(rng, 10, 40)}"
    texts[9] = f"w3 Brandlum called, two@mail.example.com {words(rng, 10, 40)} again"
    table = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert "Quibblix" not in clean[7] and "[name]" in clean[7] and clean[7].startswith("w1 w2 ") and clean[6] == texts[6]
    assert "Brandlum" not in clean[8] + clean[9] and clean[8].startswith("w3 ")


def test_pii_of_short_terms(spark):
    rng = random.Random(7)
    texts = [f"{words(rng, 20, 40)} t{i}" for i in range(150)]
    for i in range(6):
        texts[i] = f"w1 w2 Qi X wrote from qi@mail.example.com {words(rng, 20, 40)} t{i}"
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i in range(6):
        assert {"Qi", "X"}.isdisjoint(clean[i].split()) and clean[i].startswith("w1 w2 ")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_patience_alignment():
    rng = random.Random(8)
    for _ in range(200):
        b = [b"%d" % rng.randrange(30) for _ in range(20)]
        a = [w for w in b if rng.random() < 0.8] + [b"%d" % rng.randrange(30) for _ in range(5)]
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= lcs(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    unique = [b"u%d" % i for i in range(30)]
    a = unique[:10] + [b"x"] + unique[12:]
    assert len(license_scan.align(a, unique)) == lcs(a, unique) == 28


def plain_align(a, b):
    """Matched places by the definition, or None where two choices of anchors are equally long."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        rest = plain_align(a[1:], b[1:])
        return None if rest is None else [(0, 0)] + [(i + 1, j + 1) for i, j in rest]
    if a[-1] == b[-1]:
        rest = plain_align(a[:-1], b[:-1])
        return None if rest is None else rest + [(len(a) - 1, len(b) - 1)]
    shared = set(a) & set(b)
    anchors = {w for w in shared if a.count(w) == b.count(w) == 1} or {w for w in shared if b.count(w) == 1} or shared
    places = sorted((a.index(w), b.index(w)) for w in anchors)
    if not places:
        return []
    for size in range(len(places), 0, -1):
        rising = [c for c in itertools.combinations(places, size) if all(p[1] < q[1] for p, q in zip(c, c[1:]))]
        if len(rising) > 1:
            return None
        if rising:
            break
    out, edges = list(rising[0]), [(-1, -1), *rising[0], (len(a), len(b))]
    for (p, r), (q, s) in zip(edges, edges[1:]):
        rest = plain_align(a[p + 1 : q], b[r + 1 : s])
        if rest is None:
            return None
        out += [(i + p + 1, j + r + 1) for i, j in rest]
    return sorted(out)


def test_alignment_equals_the_definition():
    rng, seen = random.Random(11), 0
    for _ in range(1500):
        b = [b"%d" % rng.randrange(14) for _ in range(rng.randrange(12))]
        a = [w for w in b if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            a.insert(rng.randrange(len(a) + 1), b"%d" % rng.randrange(14))
        want = plain_align(a, b)
        seen += want is not None and len(want) > 1
        assert want is None or license_scan.align(a, b) == want, (a, b)
    assert seen > 500


def test_licences_of_near_wording():
    """Of templates that nearly agree the right one is found; ties go to the first place, then by name; repeated copies are all found."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "BSL-1.0", "Zlib", "CC0-1.0"):
        text = f"some words before {license_scan.TEMPLATES[name]} and after".encode()
        assert [m[0] for m in scanner.scan(text)] == [name]
        assert [m[0] for m in scanner.scan(text + b"\n" + text)] == [name] * 2
    same = license_scan.Scanner({"b": "one two three four five", "a": "one two three four five"})
    assert [m[:3] for m in same.scan(b"x one two three four five")] == [("a", 1, 6)]


def test_license_scan(spark, none):
    rng = random.Random(2)
    mit, isc = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["ISC"]
    edited = mit.split()
    edited[20:24] = ["changed"]
    texts = [
        (1, words(rng, 500) + " " + mit + " " + words(rng, 500)), (2, " ".join(edited).upper()), (3, f"{isc}\n{isc}\n{mit}"), (4, words(rng, 300)), (5, None), (6, ""),
        (7, "Licensed under CC BY-NC 4.0. " + words(rng, 30)), (8, "Licensed under CC BY 4.0."), (9, "the of and to in software license"), (10, words(rng, 20000) + " Released under the MIT License."), (None, isc),
    ]
    got = {}
    for r in license_scan.license_matches(docs_of(spark, [(i, t, "en", "s") for i, t in texts])).collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.coverage, 2)))
    assert got[1] == [("MIT", 1.0)] and got[2][0][0] == "MIT" and 0.9 < got[2][0][1] < 1
    assert sorted(got[3]) == [("ISC", 1.0), ("ISC", 1.0), ("MIT", 1.0)]
    assert got[7] == [("CC-BY-NC-4.0-notice", 1.0)] and got[8] == [("CC-BY-4.0-notice", 1.0)] and got[10] == [("MIT-notice", 1.0)] and got[None] == [("ISC", 1.0)]
    assert set(got) == {1, 2, 3, 7, 8, 10, None}
    assert license_scan.license_matches(none).count() == 0


needs_tokenizers = pytest.mark.skipif(not os.path.isdir(token_files.TOKENIZERS), reason="no vocabulary files here")


@needs_tokenizers
def test_vocabulary_must_leave_room_for_the_end(monkeypatch):
    monkeypatch.setattr(token_files, "END", 1000)
    with pytest.raises(ValueError):
        token_files.encoding()


@needs_tokenizers
@pytest.mark.parametrize("block", [3, 1000, 1 << 20])
def test_token_counts(docs, rows, none, block):
    coder = token_files.encoding()
    want = sorted((str(i), len(coder.encode_ordinary(t or ""))) for i, t, *_ in rows)
    got = token_files.token_counts(docs.filter("doc_id is null or doc_id <> 400") if block == 3 else docs, block_tokens=block).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [w for w in want if block != 3 or w[0] != "400"]
    assert token_files.token_counts(none).count() == 0


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_separator_scan(spark, tmp_path, block):
    rng = random.Random(block)
    files, want = [], []
    for k in range(5):
        ids = [9 if rng.random() < 0.3 else rng.randrange(8) for _ in range(rng.randrange(40))]
        np.array(ids, "<u2").tofile(f"{tmp_path}/f{k}")
        files.append((f"f{k}", len(ids)))
        parts = "".join("|" if x == 9 else "." for x in ids).split("|")
        want += [(f"f{k}", i, len(p), True) for i, p in enumerate(parts[:-1])] + ([(f"f{k}", len(parts) - 1, len(parts[-1]), False)] if parts[-1] else [])
    got = token_files.scan_tokens(spark, str(tmp_path), spark.createDataFrame(files, "file string, tokens long"), 9, block)
    assert sorted(map(tuple, got.collect())) == sorted(want)
