"""SQL, for DuckDB, of the graph queries that SQL can express: independent formulations of the same results."""

from __future__ import annotations

from graphloom.functions.exprs import MIX32, MIX64, hash32_int, hash64_int
from graphloom.queries import CENTROIDS

SQL: dict[str, str] = {}


def base() -> str:
    return f"""e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT p AS src, lead(p) OVER (PARTITION BY o ORDER BY ln, p) AS dst
  FROM (SELECT DISTINCT l_orderkey o, l_linenumber ln, l_partkey p FROM lineitem)) WHERE dst IS NOT NULL AND src <> dst),
u AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
wu AS (SELECT src, dst, (1 + (7 * least(src, dst) + 13 * greatest(src, dst)) % 10)::BIGINT AS w FROM u),
v AS (SELECT p_partkey AS id FROM part),
n AS (SELECT count(*) AS n FROM part),
od AS (SELECT v.id, count(e.src) AS d FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id),
idg AS (SELECT v.id, count(e.dst) AS d FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id),
ud AS (SELECT v.id, count(u.src) AS d FROM v LEFT JOIN u ON u.src = v.id GROUP BY v.id),
a AS (SELECT ((SELECT count(*) FROM e) // (SELECT n FROM n)) AS avg)"""


def s(name: str, body: str, recursive: bool = False) -> None:
    SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{base()}{',' if body[0] != '|' else ''}\n{body.lstrip('|')}"


HUB = "s0 AS (SELECT min(id) AS id FROM ud WHERE d = (SELECT max(d) FROM ud))"
HUB_OUT = "s0 AS (SELECT min(id) AS id FROM od WHERE d = (SELECT max(d) FROM od))"

# degrees and graph forms
s("degree_hist", "|SELECT d AS out_deg, count(*) AS n FROM od GROUP BY d")
s("in_out_degree", "|SELECT od.id, od.d AS out_deg, idg.d AS in_deg FROM od JOIN idg USING (id)")
s("degree_decades", "|SELECT kind, CASE WHEN d <= 1 THEN 1 WHEN d <= 10 THEN 10 WHEN d <= 100 THEN 100 WHEN d <= 1000 THEN 1000 ELSE 10000 END::BIGINT AS upto, count(*) AS n FROM (SELECT 'out' AS kind, d FROM od UNION ALL SELECT 'in', d FROM idg) GROUP BY ALL")
s("graph_transpose", "|SELECT dst AS src, src AS dst FROM e")
s("graph_symmetrize", "|SELECT src, dst FROM u")
s("graph_adjacency", "|SELECT src AS id, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS nbrs FROM u GROUP BY src")
s("weighted_simplify", "|SELECT src, dst, w FROM wu")

# operator algebra
F = "src % 10 = 0"
s("edge_map", f"|SELECT DISTINCT dst AS id FROM e WHERE {F} AND dst % 3 = 0")
s("edge_map_data", f"|SELECT dst AS id, max(2 * src + dst) AS msg FROM e WHERE {F} GROUP BY dst")
s("edge_map_induced", f"|SELECT dst, count(*) AS n FROM e WHERE {F} GROUP BY dst")
s("edge_map_reduce", f"|SELECT dst AS id, sum(src)::BIGINT AS value FROM e WHERE {F} GROUP BY dst HAVING sum(src) % 2 = 0")
s("edge_map_count", f"|SELECT dst AS id, count(*) AS value FROM e WHERE {F} GROUP BY dst")
s("edge_map_filter", "|SELECT v.id, count(e.src) FILTER (e.dst % 2 = 0) AS value FROM v LEFT JOIN e ON e.src = v.id WHERE v.id % 10 = 0 GROUP BY v.id")
s("pack_edges", f"|SELECT src, dst FROM e WHERE NOT ({F}) OR dst % 2 = 0")
s("vertex_map", "|SELECT id, CASE WHEN id % 10 = 0 THEN -d ELSE d END AS out_deg FROM od")
s("vertex_filter", "|SELECT id, d AS in_deg FROM idg WHERE d > 20")
s("histogram", "|SELECT dst, max(src) AS value FROM e GROUP BY dst")
s("reduce_column", "|SELECT sum(d)::BIGINT AS value FROM od")
s("prefix_scan", "|SELECT id, d AS out_deg, (sum(d) OVER (ORDER BY id) - d)::BIGINT AS scan FROM od")
s("prefix_scan_back", "|SELECT id, d AS out_deg, (sum(d) OVER (ORDER BY id DESC))::BIGINT AS scan FROM od")
s("pack_index", '|SELECT id, d AS out_deg, row_number() OVER (ORDER BY id) - 1 AS "at" FROM od WHERE d > 22')
s("integer_sort", "|SELECT id, d AS in_deg, row_number() OVER (ORDER BY d, id) - 1 AS place FROM idg")
s("counting_sort", "|SELECT d AS in_deg, count(*) AS n FROM idg GROUP BY d")
s("remove_duplicates", "|SELECT DISTINCT dst FROM e")
s("search", "|SELECT id AS probe, id IN (SELECT src FROM e) AS found FROM v")


def _mix(steps, bits: int, rows: str = "SELECT p_partkey AS id, p_partkey::UHUGEINT AS a FROM part", keep: str = "id") -> str:
    """The mix of column ``a`` as a chain of subqueries over unsigned 128-bit numbers; ``keep`` names the other columns."""
    sql, mask = rows, (1 << bits) - 1
    for constant, op, shift, join, way in steps:
        left = f"((a + {constant}::UHUGEINT) & {mask}::UHUGEINT)" if op == "+" else f"xor(a, {constant}::UHUGEINT)"
        right = f"((a * {1 << shift}::UHUGEINT) & {mask}::UHUGEINT)" if way == "<" else f"(a // {1 << shift}::UHUGEINT)"
        if way == "<" and bits == 64 and shift > 8:  # keep below 2**128
            right = f"((a & {(1 << (64 - shift)) - 1}::UHUGEINT) * {1 << shift}::UHUGEINT)"
        a = f"(({left} + {right}) & {mask}::UHUGEINT)" if join == "+" else f"xor({left}, {right})"
        sql = f"SELECT {keep}, {a} AS a FROM ({sql})"
    return sql


SQL["hash_int32"] = f"SELECT id, a::BIGINT AS h FROM ({_mix(MIX32, 32)})"
SQL["hash_int64"] = f"SELECT id, (CASE WHEN a >= 9223372036854775808::UHUGEINT THEN a::HUGEINT - 18446744073709551616::HUGEINT ELSE a::HUGEINT END)::BIGINT AS h FROM ({_mix(MIX64, 64)})"
SQL["vector_distances"] = "SELECT p_partkey AS id, abs(p_partkey % 7 - p_partkey % 3)::DOUBLE AS l1, (p_partkey % 7 <> p_partkey % 3)::INT::DOUBLE AS mismatches FROM part"

# orders
_NEW = "|SELECT id AS old_id, row_number() OVER (ORDER BY {}) - 1 AS new_id FROM (SELECT id, d, d > avg AS hub, avg FROM od, a)"
s("order_so", _NEW.format("d DESC, id DESC"))
s("order_hc", _NEW.format("hub DESC, id"))
s("order_dbg", _NEW.format("CASE WHEN d <= avg // 2 THEN 0 " + " ".join(f"WHEN d <= avg * {1 << (j - 1)} THEN {j}" for j in range(1, 7)) + " ELSE 7 END DESC, id"))
s("order_fbc", _NEW.format("hub DESC, CASE WHEN hub THEN -d ELSE 0 END, CASE WHEN hub THEN -id ELSE id END"))
_SIZES = """z AS (SELECT n, CASE WHEN least(131072, n // 16) = 0 THEN 4 ELSE (1 << floor(log2(least(131072, n // 16)))::INT) END AS size FROM n),
y AS (SELECT size, (n - 1) // size + 1 AS parts FROM z)"""
s(
    "order_co",
    _SIZES
    + """,
h AS (SELECT id, d > avg AS hub, row_number() OVER (PARTITION BY d > avg ORDER BY id) - 1 AS i FROM od, a),
c AS (SELECT count(*) FILTER (hub) AS hubs, count(*) FILTER (NOT hub) AS cold FROM h),
k AS (SELECT size, parts, hubs, cold, ceil(hubs / parts)::BIGINT AS lp, size - ceil(hubs / parts)::BIGINT AS sp FROM y, c),
l AS (SELECT k.*, (SELECT max(x) FROM range(0, parts) t(x) WHERE lp * x <= hubs AND sp * x <= cold) AS last FROM k)
SELECT id AS old_id, (CASE WHEN hub AND i < lp * last THEN i // lp * size + i % lp WHEN hub THEN last * size + i - lp * last
  WHEN i < sp * last THEN i // sp * size + lp + i % sp ELSE last * size + hubs - lp * last + i - sp * last END)::BIGINT AS new_id FROM h, l""",
)
SQL["order_map"] = "SELECT p_partkey AS old_id, (SELECT count(*) FROM part) - 1 - p_partkey AS new_id FROM part"
_SO = "p AS (SELECT id, row_number() OVER (ORDER BY {0} DESC, id DESC) - 1 AS k FROM {1})"
s("relabel_so", _SO.format("d", "od") + "\nSELECT x.k AS src, y.k AS dst FROM e JOIN p x ON x.id = e.src JOIN p y ON y.id = e.dst")
s("relabel_weighted", _SO.format("d", "ud") + "\nSELECT x.k AS src, y.k AS dst, w FROM wu JOIN p x ON x.id = wu.src JOIN p y ON y.id = wu.dst")
s("gap_cost_so", _SO.format("d", "od") + ", r AS (SELECT x.k AS src, y.k AS dst FROM e JOIN p x ON x.id = e.src JOIN p y ON y.id = e.dst),\ng AS (SELECT dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS gap FROM r)\nSELECT round(sum(CASE WHEN gap > 0 THEN log2(gap) ELSE 0 END) / count(*), 9) AS value FROM g")
s("gap_entropy", "g AS (SELECT coalesce(dst - lag(dst) OVER (PARTITION BY src ORDER BY dst), dst) AS gap FROM e), c AS (SELECT count(*) / (SELECT count(*) FROM e) AS p FROM g GROUP BY gap)\nSELECT round(sum(p * log2(p)), 9) AS value FROM c")
s("log_cost", "|SELECT round(sum(log2(abs(dst - src) + 1)) / count(*), 9) AS value FROM e")
s("log_gap_cost", "g AS (SELECT coalesce(dst - lag(dst) OVER (PARTITION BY src ORDER BY dst), dst - src) AS gap FROM e)\nSELECT round(sum(log2(abs(gap) + 1)) / count(*), 9) AS value FROM g")
s("locality_w5", "|SELECT (SELECT count(*) FROM e x JOIN e y ON x.src = y.src AND y.dst < x.dst AND x.dst - y.dst <= 5) + (SELECT count(*) FROM e WHERE abs(src - dst) <= 5) AS value")
s(
    "skew_locality",
    """q AS (SELECT id // 64 AS p, sum(d)::BIGINT AS s FROM od GROUP BY ALL), y AS (SELECT (n - 1) // 64 + 1 AS parts FROM n),
r AS (SELECT s, row_number() OVER (ORDER BY s, p) AS lo, row_number() OVER (ORDER BY s DESC, p DESC) AS hi FROM q, y WHERE p < parts - 1),
c AS (SELECT t.s AS share, ceil(parts * t.s / 100) AS c FROM y, (VALUES (1), (10), (20), (30), (40), (50)) t(s)),
o AS (SELECT share, sum(CASE WHEN hi <= c THEN s ELSE 0 END)::BIGINT AS top, sum(CASE WHEN lo <= c THEN s ELSE 0 END)::BIGINT AS bottom FROM c, r GROUP BY share)
SELECT share, top, bottom, round(top / bottom, 9) AS skew FROM o""",
)
s("overflow", "h AS (SELECT id // 64 AS part FROM od, a WHERE d > avg), y AS (SELECT (n - 1) // 64 + 1 AS parts, ceil((SELECT count(*) FROM h) / ((n - 1) // 64 + 1)) AS share FROM n)\nSELECT part, (count(*) - any_value(share))::BIGINT AS extra FROM h, y WHERE part < parts - 1 GROUP BY part HAVING count(*) > any_value(share)")
s("rabbit_adjacency", "|SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) GROUP BY ALL")
s("modularity", "x AS (SELECT src // 50 AS a, dst // 50 AS b FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)), c AS (SELECT a, count(*) AS t, count(*) FILTER (a = b) AS i FROM x GROUP BY a), m AS (SELECT count(*) AS m2 FROM x)\nSELECT round(sum(i / m2 - (t / m2) ** 2), 9) AS value FROM c, m")
SQL["order_checks"] = "SELECT name, 0::BIGINT AS lost, 0::BIGINT AS clashes, 0::BIGINT AS outside FROM (VALUES ('gorder'), ('rcm'), ('rabbit'), ('fon'), ('fo')) t(name)"

# traversal
_B = "b(v, l) USING KEY (v) AS (SELECT id, 0 FROM s0 UNION SELECT {0}.dst, min(b.l + 1) FROM b JOIN {0} ON {0}.src = b.v LEFT JOIN recurring.b r ON r.v = {0}.dst WHERE r.v IS NULL GROUP BY {0}.dst)"
s("bfs_levels", f"{HUB},\n{_B.format('u')}\nSELECT l AS level, count(*) AS n FROM b GROUP BY l", True)
for name in ("bfs_parents", "gas_bfs"):
    s(name, f"{HUB},\n{_B.format('u')}\nSELECT v.id, any_value(b.l) AS level, CASE WHEN any_value(b.l) = 0 THEN v.id ELSE min(u.src) END AS parent\nFROM v LEFT JOIN b ON b.v = v.id LEFT JOIN (u JOIN b x ON x.v = u.src) ON u.dst = v.id AND x.l = b.l - 1 GROUP BY v.id", True)
s("bfs_bitvector", f"{HUB_OUT},\n{_B.format('e')}\nSELECT v.id, b.l AS level FROM v LEFT JOIN b ON b.v = v.id", True)
_C = "c(v, c) USING KEY (v) AS (SELECT id, id FROM v UNION SELECT {0}.dst, min(c.c) FROM c JOIN {0} ON {0}.src = c.v JOIN recurring.c r ON r.v = {0}.dst WHERE c.c < r.c GROUP BY {0}.dst)\nSELECT v AS id, c AS label FROM c"
for name, edges in (("components", "u"), ("components_shortcut", "u"), ("components_directed", "e"), ("bfs_cc", "e"), ("gas_cc", "e")):
    s(name, _C.format(edges), True)
_S = "b(v, d) USING KEY (v) AS (SELECT id, 0::BIGINT FROM s0 UNION SELECT x.v, x.d FROM (SELECT {0}.dst AS v, min(b.d + {1}) AS d FROM b JOIN {0} ON {0}.src = b.v GROUP BY {0}.dst) x LEFT JOIN recurring.b r ON r.v = x.v WHERE r.v IS NULL OR x.d < r.d)\nSELECT v.id, b.d AS dist FROM v LEFT JOIN b ON b.v = v.id"
s("sssp", f"{HUB},\n{_S.format('wu', 'wu.w')}", True)
s("sssp_unit", f"{HUB},\n{_S.format('u', '1')}", True)
s("delta_stepping", f"{HUB},\n{_S.format('wu', 'wu.w')}", True)
s("gas_sssp", f"{HUB},\n{_S.format('wu', 'wu.w')}", True)


# ranking, unrolled
def _ranks(rounds: int, start: str, add: str) -> str:
    ctes = [f"p0 AS (SELECT id AS v, {start} AS r FROM v)"]
    for i in range(rounds):
        ctes.append(f"p{i + 1} AS MATERIALIZED (SELECT v.id AS v, {add} + 0.85::DOUBLE * coalesce(x.s, 0) AS r FROM v LEFT JOIN (SELECT u.dst, sum(p.r / ud.d) AS s FROM u JOIN p{i} p ON p.v = u.src JOIN ud ON ud.id = u.src GROUP BY u.dst) x ON x.dst = v.id)")
    return ",\n".join(ctes) + f"\nSELECT v AS id, round(r, 9) AS rank FROM p{rounds}"


_N = "(SELECT n FROM n)"
s("pagerank10", _ranks(10, f"1.0::DOUBLE / {_N}", f"0.15::DOUBLE / {_N}"))
s("pagerank_raw", _ranks(5, "1.0::DOUBLE", "0.15::DOUBLE"))
_D = [f"p0 AS (SELECT id AS v, 0.0::DOUBLE AS r, 1.0::DOUBLE / {_N} AS x, true AS f FROM v)"]
for i in range(5):
    got = f"(SELECT v.id AS v, p.r, 0.85::DOUBLE * coalesce(q.s, 0)" + (f" + 0.15::DOUBLE / {_N}" if i == 0 else "") + f" AS g FROM v JOIN p{i} p ON p.v = v.id LEFT JOIN (SELECT u.dst, sum(p.x / ud.d) AS s FROM u JOIN p{i} p ON p.v = u.src AND p.f JOIN ud ON ud.id = u.src GROUP BY u.dst) q ON q.dst = v.id)"
    if i == 0:
        _D.append(f"p1 AS MATERIALIZED (SELECT v, r + g AS r, g - 1.0::DOUBLE / {_N} AS x, abs(g - 1.0::DOUBLE / {_N}) > 0.01 * (r + g) AS f FROM {got})")
    else:
        _D.append(f"p{i + 1} AS MATERIALIZED (SELECT v, CASE WHEN abs(g) > 0.01 * r THEN r + g ELSE r END AS r, g AS x, abs(g) > 0.01 * r AS f FROM {got})")
s("pagerank_delta", ",\n".join(_D) + "\nSELECT v AS id, round(r, 9) AS rank FROM p5")
_CF = ["b AS (SELECT max(c_custkey) + 1 AS b FROM customer)", "q AS (SELECT o_custkey AS src, l_suppkey + (SELECT b FROM b) AS dst, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)", "e AS (SELECT * FROM q UNION ALL SELECT dst, src, w FROM q)", "x0 AS (SELECT id, k, 0.5::DOUBLE AS x FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey + (SELECT b FROM b) FROM supplier), range(0, 4) t(k))"]
for i in range(2):
    _CF.append(f"r{i} AS MATERIALIZED (SELECT e.src, e.dst, any_value(e.w) - sum(a.x * b.x) AS err FROM e JOIN x{i} a ON a.id = e.src JOIN x{i} b ON b.id = e.dst AND b.k = a.k GROUP BY e.src, e.dst)")
    _CF.append(f"g{i} AS (SELECT r.dst AS id, a.k, sum(r.err * a.x) AS g FROM r{i} r JOIN x{i} a ON a.id = r.src GROUP BY ALL)")
    _CF.append(f"x{i + 1} AS MATERIALIZED (SELECT x.id, x.k, x.x + 0.001::DOUBLE * (coalesce(g.g, 0) - 0.001::DOUBLE * x.x) AS x FROM x{i} x LEFT JOIN g{i} g USING (id, k))")
SQL["collaborative_filter"] = "WITH " + ",\n".join(_CF) + "\nSELECT id, k::INT AS k, round(x, 9) AS x FROM x2"

# decomposition
s("triangles", "|SELECT count(*) AS triangles FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst WHERE a.src > a.dst AND b.src > b.dst")
s("triangles_per_vertex", "t AS (SELECT a.src AS id FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst WHERE a.src > a.dst AND b.src > b.dst)\nSELECT v.id, count(t.id) AS n FROM v LEFT JOIN t USING (id) GROUP BY v.id")
_K = ["k0 AS (SELECT id AS v, d AS c FROM ud)"]
for i in range(48):
    _K.append(f"k{i + 1} AS MATERIALIZED (SELECT k.v, coalesce(h.h, 0) AS c FROM k{i} k LEFT JOIN (SELECT v, max(least(c, rn)) AS h FROM (SELECT u.dst AS v, k.c, row_number() OVER (PARTITION BY u.dst ORDER BY k.c DESC) AS rn FROM u JOIN k{i} k ON k.v = u.src) GROUP BY v) h ON h.v = k.v)")
s("kcore", ",\n".join(_K) + "\nSELECT v AS id, c AS core FROM k48")
_M = ["m0 AS (SELECT id AS v, NULL::BOOLEAN AS i FROM v)"]
for i in range(16):
    _M.append(f"j{i} AS MATERIALIZED (SELECT v FROM m{i} WHERE i IS NULL AND v NOT IN (SELECT u.dst FROM u JOIN m{i} x ON x.v = u.src AND x.i IS NULL WHERE u.src < u.dst))")
    _M.append(f"m{i + 1} AS MATERIALIZED (SELECT m.v, CASE WHEN m.i IS NOT NULL THEN m.i WHEN m.v IN (SELECT v FROM j{i}) THEN true WHEN m.v IN (SELECT u.dst FROM u JOIN j{i} j ON j.v = u.src) THEN false END AS i FROM m{i} m)")
s("mis", ",\n".join(_M) + "\nSELECT v AS id, i AS in_set FROM m16")
s(
    "bc",
    f"""{HUB},
{_B.format('u')},
dag AS MATERIALIZED (SELECT u.src, u.dst FROM u JOIN b x ON x.v = u.src JOIN b y ON y.v = u.dst WHERE y.l = x.l + 1),
p(v, l, s) AS (SELECT id, 0, 1.0::DOUBLE FROM s0 UNION ALL SELECT dag.dst, p.l + 1, sum(p.s) FROM p JOIN dag ON dag.src = p.v GROUP BY dag.dst, p.l),
t(v, l, x) AS (SELECT v, l, 0.0::DOUBLE FROM p WHERE l = (SELECT max(l) FROM p) UNION ALL
  SELECT p.v, p.l, coalesce(sum(p.s / q.s * (1 + t.x)), 0) FROM (SELECT DISTINCT l FROM t) c JOIN p ON p.l = c.l - 1 LEFT JOIN (dag JOIN t ON t.v = dag.dst JOIN p q ON q.v = t.v) ON dag.src = p.v GROUP BY p.v, p.l)
SELECT v.id, round(p.s, 9) AS paths, round(t.x, 9) AS dependency FROM v LEFT JOIN p ON p.v = v.id LEFT JOIN t ON t.v = v.id""",
    True,
)
_MULTI = "b(s, v, l) USING KEY (s, v) AS (SELECT DISTINCT {1}, {1}, 0 FROM {2} UNION SELECT b.s, u.dst, min(b.l + 1) FROM b JOIN u ON u.src = b.v LEFT JOIN recurring.b r ON r.s = b.s AND r.v = u.dst WHERE r.v IS NULL GROUP BY b.s, u.dst)"
s("radii", f"k(id) AS (SELECT (h::UBIGINT % (SELECT n FROM n)::UBIGINT)::BIGINT FROM (VALUES {', '.join(f'({hash64_int(i)})' for i in range(64))}) t(h)),\n{_MULTI.format('', 'id', 'k')}\nSELECT v.id, max(b.l) AS radius FROM v LEFT JOIN b ON b.v = v.id GROUP BY v.id", True)
for name in ("ecc_exact", "ecc_tk"):
    s(name, f"{_MULTI.format('', 'id', 'v')}\nSELECT v AS id, max(l) AS ecc FROM b GROUP BY v", True)
SQL["ecc_bounds_check"] = "SELECT name, 0::BIGINT AS out_of_bounds FROM (VALUES ('kbfs'), ('kbfs1'), ('fm'), ('loglog'), ('simple'), ('clrstv'), ('rv')) t(name)"
SQL["set_cover_check"] = "SELECT 0::BIGINT AS missed"


# hypergraphs
def h(name: str, body: str, recursive: bool = False) -> None:
    SQL[name] = (
        f"WITH {'RECURSIVE ' if recursive else ''}i AS (SELECT DISTINCT l_partkey AS v, l_orderkey AS h FROM lineitem),\nhe AS (SELECT o_orderkey AS id FROM orders), v AS (SELECT p_partkey AS id FROM part),\nb AS (SELECT v AS src, -1 - h AS dst FROM i UNION ALL SELECT -1 - h, v FROM i), a AS (SELECT id FROM v UNION ALL SELECT -1 - id FROM he)"
        + (body if body[0] == "\n" else ",\n" + body)
    )


_SIDE = "CASE WHEN a.id < 0 THEN 'H' ELSE 'V' END AS side, CASE WHEN a.id < 0 THEN -1 - a.id ELSE a.id END AS id"
h("hyper_bfs", f"f(v, l) USING KEY (v) AS (SELECT 0::BIGINT, 0 UNION SELECT b.dst, min(f.l + 1) FROM f JOIN b ON b.src = f.v LEFT JOIN recurring.f r ON r.v = b.dst WHERE r.v IS NULL GROUP BY b.dst)\nSELECT {_SIDE}, f.l AS level FROM a LEFT JOIN f ON f.v = a.id", True)
h("hyper_cc", f"f(v, c) USING KEY (v) AS (SELECT id, CASE WHEN id >= 0 THEN id ELSE 1000000000000 END FROM a UNION SELECT b.dst, min(f.c) FROM f JOIN b ON b.src = f.v JOIN recurring.f r ON r.v = b.dst WHERE f.c < r.c GROUP BY b.dst)\nSELECT {_SIDE}, CASE WHEN f.c < 1000000000000 THEN f.c END AS label FROM a JOIN f ON f.v = a.id", True)
h("hyper_bpath", "need AS (SELECT h, count(*) AS c FROM i GROUP BY h)\nSELECT 'V' AS side, id, id = 0 OR id IN (SELECT y.v FROM i x JOIN need USING (h) JOIN i y USING (h) WHERE c = 1 AND x.v = 0) AS reached FROM v UNION ALL SELECT 'H', id, id IN (SELECT h FROM i JOIN need USING (h) WHERE c = 1 AND v = 0) FROM he")
_HP = "dv AS (SELECT v, count(*) AS d FROM i GROUP BY v), dh AS (SELECT h, count(*) AS d FROM i GROUP BY h), n AS (SELECT count(*)::DOUBLE AS n FROM v),\nph AS (SELECT he.id, coalesce(sum(1.0::DOUBLE / n / d), 0) AS r FROM n, he LEFT JOIN (i JOIN dv USING (v)) ON i.h = he.id GROUP BY he.id),\npv AS (SELECT v.id, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * coalesce(sum(ph.r / d), 0) AS r FROM n, v LEFT JOIN (i JOIN dh USING (h) JOIN ph ON ph.id = i.h) ON i.v = v.id GROUP BY v.id)"
h("hyper_pagerank1", _HP + "\nSELECT 'V' AS side, id, round(r, 12) AS rank FROM pv UNION ALL SELECT 'H', id, round(r, 12) FROM ph")
h("hyper_entropy", _HP + "\nSELECT he.id, round(sum(pv.r / ph.r * log2(ph.r / pv.r)), 9) AS entropy FROM he LEFT JOIN (i JOIN pv ON pv.id = i.v JOIN ph ON ph.id = i.h) ON i.h = he.id GROUP BY he.id")
h("hyper_degrees", "\nSELECT 'V' AS side, v.id, count(i.v) AS deg FROM v LEFT JOIN i ON i.v = v.id GROUP BY v.id UNION ALL SELECT 'H', he.id, count(i.h) FROM he LEFT JOIN i ON i.h = he.id GROUP BY he.id")
h("hyper_reader", "\nSELECT 'V' AS side, v AS id, string_agg(h::VARCHAR, ' ' ORDER BY h) AS members FROM i GROUP BY v UNION ALL SELECT 'H', h, string_agg(v::VARCHAR, ' ' ORDER BY v) FROM i GROUP BY h")
h("clique_expand", "\nSELECT x.v AS src, y.v AS dst, count(*) AS n FROM i x JOIN i y ON x.h = y.h AND x.v <> y.v GROUP BY ALL")
h("to_mesh", "\nSELECT h || ',' || v AS value FROM i")
h("compact_ids", "\nSELECT dense_rank() OVER (ORDER BY v) - 1 AS v, dense_rank() OVER (ORDER BY h) - 1 AS h FROM i")
h("codec_hyper", "\nSELECT v, h FROM i")
SQL["hyper_mis_check"] = "SELECT 0::BIGINT AS filled, 0::BIGINT AS addable"


# local clustering, unrolled
def _walk(steps: int, eps: str) -> str:
    ctes = [HUB, "p0 AS (SELECT id AS v, 1.0::DOUBLE AS m, true AS f FROM s0)"]
    for i in range(steps):
        ctes.append(f"p{i + 1} AS MATERIALIZED (SELECT x.v, x.m, x.m >= {eps}::DOUBLE * ud.d AS f FROM (SELECT v, sum(m) AS m FROM (SELECT v, m / 2 AS m FROM p{i} WHERE f UNION ALL SELECT u.dst, p.m / (2 * ud.d) FROM p{i} p JOIN u ON u.src = p.v JOIN ud ON ud.id = p.v WHERE p.f) GROUP BY v) x JOIN ud ON ud.id = x.v)")
    return ",\n".join(ctes)


s("nibble_t3", _walk(3, "0.000000001") + "\nSELECT v AS id, round(m, 9) AS mass FROM p3")
s("nibble_truncated", _walk(3, "0.00001") + "\nSELECT v AS id, round(m, 9) AS mass FROM p3")
s(
    "sweep",
    _walk(3, "0.000000001")
    + """,
r AS MATERIALIZED (SELECT p3.v, ud.d, row_number() OVER (ORDER BY m / ud.d DESC, p3.v) AS k FROM p3 JOIN ud ON ud.id = p3.v),
g AS (SELECT r.k, any_value(r.d) - 2 * count(q.k) AS gain, any_value(r.d) AS d FROM r LEFT JOIN (u JOIN r q ON q.v = u.dst) ON u.src = r.v AND q.k < r.k GROUP BY r.k),
c AS (SELECT k, (sum(d) OVER (ORDER BY k))::BIGINT AS vol, (sum(gain) OVER (ORDER BY k))::BIGINT AS x FROM g),
z AS (SELECT k, vol, x, CASE WHEN x = 0 OR least(vol, (SELECT count(*) FROM u) - vol) = 0 THEN 1.0::DOUBLE ELSE x / least(vol, (SELECT count(*) FROM u) - vol) END AS q FROM c)
SELECT round(q, 9) AS conductance, k AS size_s, vol AS vol_s, (SELECT max(vol) FROM z) AS vol, x AS edges_crossing FROM z ORDER BY z.q, k LIMIT 1""",
)
s(
    "heat_kernel",
    HUB
    + """,
r0 AS (SELECT id AS v, 1.0::DOUBLE AS r, true AS f FROM s0),
k AS (SELECT exp(3.0::DOUBLE) * 0.000000001 / 6 AS c),
r1 AS MATERIALIZED (SELECT x.v, x.r, x.r >= c / (1 + 3.0 / 2) * ud.d AS f FROM (SELECT u.dst AS v, sum(3.0::DOUBLE * r / ud.d) AS r FROM r0 p JOIN u ON u.src = p.v JOIN ud ON ud.id = p.v WHERE f GROUP BY u.dst) x JOIN ud ON ud.id = x.v, k),
r2 AS MATERIALIZED (SELECT x.v, x.r, x.r >= c / 1 * ud.d AS f FROM (SELECT u.dst AS v, sum(1.5::DOUBLE * r / ud.d) AS r FROM r1 p JOIN u ON u.src = p.v JOIN ud ON ud.id = p.v WHERE f GROUP BY u.dst) x JOIN ud ON ud.id = x.v, k),
r3 AS (SELECT u.dst AS v, sum(r / ud.d) AS r FROM r2 p JOIN u ON u.src = p.v JOIN ud ON ud.id = p.v WHERE f GROUP BY u.dst)
SELECT v AS id, round(sum(r), 9) AS mass FROM (SELECT v, r FROM r0 WHERE f UNION ALL SELECT v, r FROM r1 WHERE f UNION ALL SELECT v, r FROM r2 WHERE f UNION ALL SELECT v, r FROM r3) GROUP BY v""",
)
SQL["pr_nibble_check"] = "SELECT name, 1.0::DOUBLE AS total, 0::BIGINT AS high FROM (VALUES ('plain'), ('optimised')) t(name)"

# features
_FEAT = "k(id) AS (VALUES (0::BIGINT), (1), (2)),\n" + _MULTI.format("", "id", "k") + ",\nf AS (SELECT v.id, " + ", ".join(f"coalesce(max(b.l) FILTER (b.s = {i}), 0) AS f{i}" for i in range(3)) + " FROM v LEFT JOIN b ON b.v = v.id GROUP BY v.id)"
s("bfs_trace", _FEAT + "\nSELECT s::INT AS sample, l AS level, v AS id FROM b", True)
s("bfs_feature", _FEAT + "\nSELECT * FROM f", True)
s("bfs_blocks", _FEAT + ",\nq AS (SELECT s, l, v, v - lag(v) OVER (PARTITION BY s, l ORDER BY v) AS gap FROM b WHERE s = 0)\nSELECT s::INT AS sample, l AS level, count(*) FILTER (gap IS NULL OR gap <> 1) AS blocks FROM q GROUP BY ALL", True)
_NEAR = _FEAT + ",\nc(c, x, y, z) AS (VALUES " + ", ".join(f"({i}, {c[0]}, {c[1]}, {c[2]})" for i, c in enumerate(CENTROIDS)) + "),\ng AS (SELECT id, any_value(f0) AS f0, any_value(f1) AS f1, any_value(f2) AS f2, min({'d': abs(f0 - x) + abs(f1 - y) + abs(f2 - z), 'c': c}) AS b FROM f, c GROUP BY id)"
s("kmeans_assign", _NEAR + "\nSELECT id, b.c AS cluster, b.d::DOUBLE AS dist FROM g", True)
s("kmeans_step", _NEAR + "\nSELECT b.c AS cluster, round(avg(f0)) AS c0, round(avg(f1)) AS c1, round(avg(f2)) AS c2, count(*) AS n FROM g GROUP BY ALL", True)

# generators, converters, codecs
for name, side, dim in (("grid_2d", 20, 2), ("grid_3d", 7, 3)):
    steps = " UNION ALL ".join(f"SELECT id AS a, id + CASE WHEN id // {side ** (dim - 1 - k)} % {side} = {side - 1} THEN {-(side - 1) * side ** (dim - 1 - k)} ELSE {side ** (dim - 1 - k)} END AS b FROM range(0, {side**dim}) t(id)" for k in range(dim))
    SQL[name] = f"WITH x AS ({steps}) SELECT a AS src, b AS dst FROM x UNION SELECT b, a FROM x"
s("el2csr", "x AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r AS (SELECT v.id, count(x.src) AS d, coalesce(string_agg(x.dst::VARCHAR, ' ' ORDER BY x.dst DESC), '') AS nbrs FROM v LEFT JOIN x ON x.src = v.id GROUP BY v.id)\nSELECT id, (sum(d) OVER (ORDER BY id) - d)::BIGINT AS \"offset\", nbrs, d::INT AS n_weights FROM r")
s("gen_el", "|SELECT src, dst FROM e")
for name in ("codec_byte", "codec_rle", "codec_nibble"):
    s(name, "|SELECT src, dst FROM e")
_BITS = "(floor(log2(greatest({0}, 1)))::INT + 1)"
s("codec_bytes", f"g AS (SELECT src, dst, dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS gap FROM e)\nSELECT sum(CASE WHEN gap IS NULL THEN 1 + greatest(0, ceil(({_BITS.format('abs(dst - src)')} - 6) / 7)) ELSE 1 + greatest(0, ceil(({_BITS.format('gap')} - 7) / 7)) END)::BIGINT AS bytes, count(*) AS m FROM g")
SQL["log_summary"] = "WITH l AS (SELECT (o_custkey % 5)::VARCHAR AS data, ['OG', 'SO', 'HC'][o_orderkey % 3 + 1] AS reorder, avg(o_totalprice) AS sec FROM orders GROUP BY ALL)\nSELECT 'e' AS engine, 'BFS' AS algo, l.reorder, round(avg(l.sec), 9) AS seconds, round(avg(g.sec / l.sec), 9) AS speedup, count(*) AS data_sets FROM l JOIN l g ON g.data = l.data AND g.reorder = 'OG' GROUP BY l.reorder"

# files: what was written is read
for name in ("io_csr", "io_edgelist", "io_triple", "io_coded_byte"):
    s(name, "|SELECT src, dst FROM e")
for name in ("io_snap", "io_adjacency", "io_coded_rle", "io_coded_nibble", "io_coded_chunks", "snap_to_adjacency"):
    s(name, "|SELECT src, dst FROM u")
for name in ("io_csr_weighted", "io_snap_weighted", "io_adjacency_weighted", "io_triple_weighted", "adjacency_to_binary"):
    s(name, "|SELECT src, dst, w FROM wu")
for name in ("io_hyper", "io_hyper_binary", "io_hyper_coded"):
    h(name, "\nSELECT v, h FROM i")
_DENSE = "d AS (SELECT dense_rank() OVER (ORDER BY v) - 1 AS v, dense_rank() OVER (ORDER BY h) - 1 AS h FROM i)"
for name in ("io_community", "io_konect", "konect_to_hyper"):
    h(name, _DENSE + "\nSELECT v, h FROM d")
h("community_to_clique", _DENSE + "\nSELECT x.v AS src, y.v AS dst, count(*) AS n FROM d x JOIN d y ON x.h = y.h AND x.v <> y.v GROUP BY ALL")
SQL["io_permutation"] = SQL["order_so"]
s("io_trace", _FEAT + "\nSELECT s::INT AS sample, l AS level, v AS id FROM b WHERE s = 0", True)
SQL["io_features"] = SQL["bfs_feature"]
SQL["io_log"] = "SELECT 'e' AS engine, 'BFS' AS algo, max(o_orderkey)::DOUBLE AS sec FROM orders GROUP BY o_custkey % 5"

# further parts of the operator algebra
s("edge_map_pack", "t AS (SELECT DISTINCT dst AS id FROM e WHERE src % 10 = 0 AND dst % 2 = 0), k AS (SELECT src, dst FROM e WHERE src % 10 <> 0 OR dst % 2 = 0)\nSELECT t.id, count(k.src) AS n FROM t LEFT JOIN k ON k.src = t.id GROUP BY t.id")
SQL["edge_map_no_output"] = "SELECT 0::BIGINT AS n"
s("vertex_filter_data", "|SELECT id, id % 7 AS datum FROM od WHERE id % 10 = 0 AND d + id % 7 > 24")
SQL["transpose_matrix"] = "SELECT p_partkey % 50 AS r, p_partkey // 50 AS c, p_partkey AS x FROM part"
s("sorted_order", "|SELECT src, dst, row_number() OVER (ORDER BY dst DESC, src) - 1 AS place FROM e")
s("bucket_rounds", "|SELECT id, d // 8 + CASE WHEN id % 2 = 1 THEN 2 ELSE 0 END AS done FROM od")
SQL["frontier"] = "SELECT id, unnest(range(1, id % 4 + 1)) AS nth FROM (SELECT p_partkey AS id FROM part WHERE p_partkey < 100 AND p_partkey % 6 = 0)"
h("hyper_bipartite", "\nSELECT src, dst FROM b")
s("bfs_attributes", "k(id) AS (VALUES (0::BIGINT), (1), (2)),\n" + _MULTI.format("", "id", "k").replace("JOIN u ON u.src", "JOIN e u ON u.src") + "\nSELECT v.id, " + ", ".join(f"max(b.l) FILTER (b.s = {i}) AS f{i}" for i in range(3)) + " FROM v LEFT JOIN b ON b.v = v.id GROUP BY v.id", True)


# weights and generators: the same integer mixes
def _hashed(rows: str, keep: str, bits: int = 32) -> str:
    """``keep`` and ``h``: the mix of column ``a``."""
    return f"(SELECT {keep}, a AS h FROM ({_mix(MIX32 if bits == 32 else MIX64, bits, rows, keep)}))"


_TOP = "greatest(1, floor(log2(greatest(2, (SELECT count(*) FROM part))))::BIGINT)"
s(
    "add_weights",
    f"""q AS (SELECT src, dst, (row_number() OVER (ORDER BY src, dst) - 1)::UHUGEINT AS a FROM u),
x AS MATERIALIZED (SELECT src, dst, ((h % (2 * {_TOP})::UHUGEINT) // 2 + 1)::BIGINT AS w FROM {_hashed('SELECT src, dst, a FROM q', 'src, dst')})
SELECT x.src, x.dst, CASE WHEN x.dst > x.src THEN coalesce(y.w, x.w) ELSE x.w END AS w FROM x LEFT JOIN x y ON y.src = x.dst AND y.dst = x.src""",
)
_HTOP = "greatest(1, floor(log2(greatest(2, (SELECT count(*) FROM he), (SELECT count(*) FROM v))))::BIGINT)"
_HW = f"hw AS MATERIALIZED (SELECT id, (h % {_HTOP}::UHUGEINT + 1)::BIGINT AS w FROM {_hashed('SELECT id, id::UHUGEINT AS a FROM he', 'id')}),\nho AS MATERIALIZED (SELECT id, (h % {_HTOP}::UHUGEINT + 1)::BIGINT AS w FROM {_hashed('SELECT id, (id + (SELECT count(*) FROM he))::UHUGEINT AS a FROM he', 'id')})"
for name in ("add_hyper_weights", "io_hyper_weighted", "io_hyper_binary_weighted"):
    h(name, _HW + "\nSELECT v, h, w FROM i JOIN hw ON hw.id = i.h")
h("hyper_reader_weighted", _HW + "\nSELECT 'V' AS side, v AS id, string_agg(h || ':' || w, ' ' ORDER BY h) AS members FROM i JOIN hw ON hw.id = i.h GROUP BY v UNION ALL SELECT 'H', h, string_agg(v || ':' || w, ' ' ORDER BY v) FROM i JOIN ho ON ho.id = i.h GROUP BY h")
h("hyper_sssp", _HW + f""",
wb AS MATERIALIZED (SELECT v AS src, -1 - h AS dst, w FROM i JOIN hw ON hw.id = i.h UNION ALL SELECT -1 - h, v, w FROM i JOIN ho ON ho.id = i.h),
f(v, d) USING KEY (v) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT x.v, x.d FROM (SELECT wb.dst AS v, min(f.d + wb.w) AS d FROM f JOIN wb ON wb.src = f.v GROUP BY wb.dst) x LEFT JOIN recurring.f r ON r.v = x.v WHERE r.v IS NULL OR x.d < r.d)
SELECT {_SIDE}, f.d AS dist FROM a LEFT JOIN f ON f.v = a.id""", True)
SQL["rand_hyper"] = f"SELECT DISTINCT (h % 200::UHUGEINT)::BIGINT AS v, k // 3 AS h FROM {_hashed('SELECT k, k::UHUGEINT AS a FROM range(0, 6000) t(k)', 'k', bits=64)}"


def _rmat(n: int, m: int, bits: int, seed: int, a: float, b: float) -> str:
    """Two mixes give an edge its first number and its step, a third one each level's draw."""
    mul = hash32_int(seed)
    two = "((2 * id{0}) * {1}) % 4294967296"
    first, step = (_hashed(f"SELECT id, ({two.format(x, mul)})::UHUGEINT AS a FROM range(0, {m}) t(id)", "id") for x in ("", " + 1"))
    draws = _hashed(f"SELECT id, l, (f.h + l::UHUGEINT * g.h) % 4294967296::UHUGEINT AS a FROM f JOIN g USING (id), range(0, {bits}) t(l)", "id, l")
    r, fa, fb = "(h::DOUBLE / 4294967295)", f"{a!r}::FLOAT::DOUBLE", f"{b!r}::FLOAT::DOUBLE"
    half = f"CASE WHEN {{}} THEN 1::BIGINT << ({bits - 1} - l)::INT ELSE 0 END"
    low = half.format(f"{r} >= {fa} + {fb}")
    high = half.format(f"({r} >= {fa} AND {r} < {fa} + {fb}) OR {r} >= {fa} + {fb} + {fb}")
    return f"WITH f AS MATERIALIZED {first}, g AS MATERIALIZED {step}, e AS (SELECT id, sum({low})::BIGINT AS src, sum({high})::BIGINT AS dst FROM {draws} GROUP BY id)\nSELECT src, dst, count(*) AS n FROM e GROUP BY ALL"


SQL["rmat"] = _rmat(1000, 10_000, 10, 1, 0.5, 0.1)
# hashed again while an end equals the source; five times in a row doesn't happen among these edges
_ENDS = _hashed("SELECT k, k::UHUGEINT AS a FROM range(0, 5000) t(k)", "k")
for _i in range(4):
    _ENDS = _hashed(f"SELECT k, {''.join(f'h{j}, ' for j in range(_i))}h AS h{_i}, h AS a FROM {_ENDS}", ", ".join(["k", *(f"h{j}" for j in range(_i + 1))]))
SQL["rand_uniform"] = f"WITH x AS (SELECT k // 10 AS src, [h0, h1, h2, h3, h] AS hs FROM {_ENDS}), e AS (SELECT src, list_filter(list_transform(hs, lambda z: (z % 500::UHUGEINT)::BIGINT), lambda j: j <> src)[1] AS dst FROM x)\nSELECT src, dst, count(*) AS n FROM e GROUP BY ALL"

# peeling, shortest paths over hyperedges, and pushes, each round a step of the recursion
h("hyper_kcore", """z(it, k, v, h) AS (SELECT 0, 1::BIGINT, v, h FROM (SELECT v, h FROM i UNION ALL SELECT id, -1 FROM v) UNION ALL (
  WITH g AS (SELECT v, count(*) FILTER (h >= 0) AS d FROM z GROUP BY v), x AS (SELECT greatest((SELECT max(k) FROM z), (SELECT min(d) FROM g) + 1) AS k),
  dead AS (SELECT DISTINCT z.h FROM z JOIN g USING (v), x WHERE z.h >= 0 AND g.d < x.k)
  SELECT z.it + 1, x.k, z.v, z.h FROM z JOIN g USING (v), x WHERE g.d >= x.k AND z.h NOT IN (SELECT h FROM dead))),
g AS (SELECT it, v, any_value(k) AS k, count(*) FILTER (h >= 0) AS d FROM z GROUP BY it, v), x AS (SELECT it, greatest(any_value(k), min(d) + 1) AS k FROM g GROUP BY it)
SELECT y.v AS id, (x.k - 1)::BIGINT AS core FROM (SELECT v, max(it) AS it FROM g GROUP BY v) y JOIN x USING (it)""", True)
h("hyper_bc", """f(v, l) USING KEY (v) AS (SELECT 0::BIGINT, 0 UNION SELECT b.dst, min(f.l + 1) FROM f JOIN b ON b.src = f.v LEFT JOIN recurring.f r ON r.v = b.dst WHERE r.v IS NULL GROUP BY b.dst),
dag AS MATERIALIZED (SELECT b.src, b.dst FROM b JOIN f x ON x.v = b.src JOIN f y ON y.v = b.dst WHERE y.l = x.l + 1),
p(v, l, s) AS (SELECT 0::BIGINT, 0, 1.0::DOUBLE UNION ALL SELECT dag.dst, p.l + 1, sum(p.s) FROM p JOIN dag ON dag.src = p.v GROUP BY dag.dst, p.l),
t(v, l, x) AS (SELECT v, l, 1.0::DOUBLE FROM p WHERE l = (SELECT max(l) - max(l) % 2 FROM p) UNION ALL
  SELECT p.v, p.l, CASE WHEN p.l % 2 = 1 THEN coalesce(sum(t.x / q.s), 0) ELSE coalesce(sum(t.x), 0) * any_value(p.s) + CASE WHEN p.l = 0 THEN 0 ELSE 1 END END
  FROM (SELECT DISTINCT l FROM t) c JOIN p ON p.l = c.l - 1 LEFT JOIN (dag JOIN t ON t.v = dag.dst JOIN p q ON q.v = t.v) ON dag.src = p.v GROUP BY p.v, p.l)
SELECT v.id, round(p.s, 9) AS paths, round(t.x, 9) AS dependency FROM v LEFT JOIN p ON p.v = v.id LEFT JOIN t ON t.v = v.id""", True)
s("pr_nibble", f"""{HUB},
p(it, v, m, r) AS (SELECT 0, id, 0.0::DOUBLE, 1.0::DOUBLE FROM s0 UNION ALL (
  WITH c AS (SELECT p.*, ud.d, p.r > 0.001::DOUBLE * ud.d AS f FROM p JOIN ud ON ud.id = p.v)
  SELECT it + 1, v, sum(m), sum(r) FROM (
    SELECT it, v, m + CASE WHEN f THEN 0.15::DOUBLE * r ELSE 0 END AS m, CASE WHEN f THEN 0.425::DOUBLE * r ELSE r END AS r FROM c
    UNION ALL SELECT c.it, u.dst, 0, 0.425::DOUBLE * c.r / c.d FROM c JOIN u ON u.src = c.v WHERE c.f) WHERE (SELECT bool_or(f) FROM c) GROUP BY it, v))
SELECT v AS id, round(m, 9) AS mass, round(r, 9) AS residual FROM p WHERE it = (SELECT max(it) FROM p)""", True)
