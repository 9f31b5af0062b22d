"""SQL, for DuckDB, of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

_WORDS = r"""[^\x20\x09-\x0D]+"""

ORACLES["op2_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)"""

ORACLES["op4_url_filter"] = r"""
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT u.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM u JOIN r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND prefix(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1"""

_SETS = r"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= {k} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' ')) END) AS sh FROM w))"""

ORACLES["op6_decontamination"] = (
    "WITH "
    + _SETS.format(k=5)
    + r""",
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM bw WHERE len(ws) >= 5),
q AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
c AS (SELECT s.doc_id, b.item_id, count(*) AS shared FROM s JOIN b USING (sh) GROUP BY ALL)
SELECT c.doc_id, c.item_id, c.shared, q.n AS item_shingles, c.shared / q.n AS containment FROM c JOIN q USING (item_id) WHERE 100 * c.shared >= 80 * q.n"""
)

ORACLES["op8_ngram_jaccard"] = (
    "WITH RECURSIVE "
    + _SETS.format(k=3)
    + r""",
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM (SELECT * FROM s SEMI JOIN f USING (sh)) a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN z x ON x.doc_id = p.a JOIN z y ON y.doc_id = p.b WHERE 100 * p.i >= 90 * (x.n + y.n - p.i)),
c(v, c) USING KEY (v) AS (SELECT doc_id, doc_id FROM documents UNION
  SELECT e.b, min(c.c) FROM c JOIN e ON e.a = c.v JOIN recurring.c r ON r.v = e.b WHERE c.c < r.c GROUP BY e.b)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.c AS component_id FROM documents d LEFT JOIN z USING (doc_id) JOIN c ON c.v = d.doc_id"""
)

ORACLES["op9_mixing"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0 * source_size / w AS r, row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS k FROM s),
-- the first k sources are capped: the smallest k for which the next one isn't above its cap
l AS (SELECT a.k, (1.5 * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(2.0 * b.source_size) FROM o b WHERE b.k < a.k), 0)) / (SELECT sum(b.w) FROM o b WHERE b.k >= a.k) AS rate, a.r FROM o a),
c AS (SELECT rate, r FROM l WHERE rate <= r ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.r < (SELECT r FROM c) THEN 2.0 * o.source_size ELSE o.w * (SELECT rate FROM c) END::DOUBLE AS target FROM o),
q AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END::BIGINT AS whole FROM t),
-- documents above some size are certain; the others are sampled in proportion to size
g AS (SELECT q.source, d.size, (q.target - q.whole * q.source_size) - coalesce(sum(d.size * count(*)) OVER (PARTITION BY q.source ORDER BY d.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
    sum(d.size::DOUBLE * d.size * count(*)) OVER (PARTITION BY q.source ORDER BY d.size) AS square
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE d.size > 0 GROUP BY q.source, q.target, q.whole, q.source_size, d.size),
m AS (SELECT source, max(size) AS largest, arg_max(rest, size) AS lacks, arg_max(rest / square, size) AS rate FROM g WHERE rest * size < square GROUP BY source),
v AS (SELECT d.doc_id, d.size, q.*, coalesce(m.largest, 0) AS largest, coalesce(m.lacks, 0) AS lacks, greatest(coalesce(m.rate, 0), 0) * d.size AS part,
    (('0x' || substr(md5('mix' || d.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN m ON m.source IS NOT DISTINCT FROM q.source),
x AS (SELECT *, sum(CASE WHEN size > largest THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY CASE WHEN size <= largest AND part > 0 THEN (u / (1 - u)) / (part / (1 - part)) ELSE 1e300 END, doc_id) AS upto FROM v)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN size > largest OR (lacks > 0 AND upto - size / 2.0 <= lacks) THEN 1 ELSE 0 END)::BIGINT AS taken FROM x"""
