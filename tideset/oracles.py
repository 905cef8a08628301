"""SQL for DuckDB that gives the rows of the queries in `catalog`."""

from __future__ import annotations

_BASE = """WITH RECURSIVE interactions AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS t, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS v, CAST(least(100, 1 + floor(value)) AS BIGINT) AS l FROM events),
directed AS (SELECT * FROM (SELECT t, lag(u) OVER (PARTITION BY v ORDER BY t) AS u, u AS v, l FROM interactions) WHERE u IS NOT NULL AND u <> v),
size AS (SELECT count(*) AS n FROM events),
middle AS (SELECT n // 2 AS m FROM size),
grid AS (SELECT unnest(generate_series(greatest(1, n // 20), 20 * greatest(1, n // 20), greatest(1, n // 20))) AS snap FROM size),
alive AS (SELECT t, u, v, l FROM interactions, middle WHERE t <= m AND m < t + l),
ongrid AS (SELECT snap, t, u, v FROM interactions JOIN grid ON t <= snap AND snap < t + l),
given AS (SELECT unnest(generate_series(0, 90, 10)) AS v),
"""


def _graph(after: int = 0, longer: int = 1, name: str = "a") -> str:
    return f"{name} AS (SELECT t, u, v FROM directed, middle WHERE t <= m + {after} AND m + {after} < t + l * {longer})"


def _reach(graph: str = "a", name: str = "r") -> str:
    return f"{name}(src, dst) AS (SELECT x, x FROM (SELECT u AS x FROM {graph} UNION SELECT v FROM {graph}) UNION SELECT q.src, e.v FROM {name} q JOIN (SELECT DISTINCT u, v FROM {graph}) e ON q.dst = e.u)"


def _greedy(pairs: str, k: int) -> str:
    """CTEs from `pairs` (snap, v, u) to g (snap, step, v, gain, calls, ...): greedy with the smallest id among equal gains, and the gains that a round of lazy evaluation weighs.

    bnd holds the gain of each candidate when it was last weighed; a round weighs that of the largest bound (ti), then the candidates that its gain does not beat (ask).
    """
    return f"""c AS (SELECT snap, list(v ORDER BY v) AS vs, list(us ORDER BY v) AS uss FROM (SELECT snap, v, list(DISTINCT u) AS us FROM {pairs} GROUP BY ALL) GROUP BY snap),
g AS (SELECT snap, 0 AS step, CAST(-1 AS BIGINT) AS v, CAST(0 AS BIGINT) AS gain, CAST(0 AS BIGINT) AS calls, CAST([] AS BIGINT[]) AS cov, CAST([] AS BIGINT[]) AS took, list_transform(vs, lambda x: CAST(1000000000000 AS BIGINT)) AS bnd FROM c
  UNION ALL SELECT snap, step + 1, vs[pick], gains[pick], CAST(len(ask) AS BIGINT), list_distinct(list_concat(cov, uss[pick])), list_append(took, vs[pick]), list_transform(gains, lambda x, i: CASE WHEN list_contains(ask, i) THEN x ELSE bnd[i] END) FROM (
    SELECT *, list_filter(ask, lambda i: gains[i] = list_max(list_transform(ask, lambda j: gains[j])))[1] AS pick FROM (
      SELECT *, list_filter(open, lambda i: i = ti OR bnd[i] > gains[ti] OR bnd[i] = gains[ti] AND i < ti) AS ask FROM (
        SELECT *, list_filter(open, lambda i: bnd[i] = list_max(list_transform(open, lambda j: bnd[j])))[1] AS ti FROM (
          SELECT g.*, c.vs, c.uss, list_transform(c.uss, lambda us: CAST(len(list_filter(us, lambda x: NOT list_contains(g.cov, x))) AS BIGINT)) AS gains, list_filter(range(1, len(c.vs) + 1), lambda i: NOT list_contains(g.took, c.vs[i])) AS open
          FROM g JOIN c ON c.snap = g.snap WHERE g.step < {k}) WHERE len(open) > 0))))"""


def _multiplicity(longer: int = 1, after: int = 0, graph: str = "a", name: str = "m2") -> str:
    return f"{_graph(after, longer, graph)}, {name} AS (SELECT u, v, count(*) AS x, 2 / (1 + exp(-0.2 * count(*))) - 1 AS p FROM {graph} GROUP BY u, v)"


def _sketches(after: int = 0, suffix: str = "", last: int = 199) -> str:
    a, m, o, tg, rr = (f"{x}{suffix}" for x in ("a", "m2", "o", "tg", "rr"))
    return f"""{_multiplicity(1, after, a, m)}, {o} AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS rank FROM (SELECT u AS x FROM {a} UNION SELECT v FROM {a})),
{tg} AS (SELECT s, x FROM (SELECT s, CAST(CAST('0x' || substr(md5('z|' || s), 1, 8) AS UBIGINT) % (SELECT count(*) FROM {o}) AS BIGINT) AS rank FROM (SELECT unnest(generate_series(0, {last})) AS s)) JOIN {o} USING (rank)),
{rr} AS (SELECT s, x FROM {tg} UNION SELECT q.s, e.u FROM {rr} q JOIN {m} e ON e.v = q.x WHERE CAST('0x' || substr(md5(q.s || '|' || e.u || '|' || e.v), 1, 8) AS UBIGINT) / 4294967296.0 < e.p)"""


_W = ", w AS (SELECT s, CAST(sum(1 + coalesce(d, 0)) AS BIGINT) AS weight FROM rr LEFT JOIN (SELECT v AS x, count(*) AS d FROM m2 GROUP BY v) USING (x) GROUP BY s)"
_WEIGHTS = _sketches() + _W

_ORDERS = """orders_stream AS (SELECT row_number() OVER (ORDER BY o_orderdate, l_orderkey, l_linenumber) AS t, o_custkey AS u, l_suppkey AS v, least(1000, 1 + 20 * CAST(l_quantity AS BIGINT)) AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
og AS (SELECT unnest(generate_series(e, 20 * e, e)) AS snap FROM (SELECT greatest(1, count(*) // 20) AS e FROM orders_stream)),
op AS (SELECT snap, v, u FROM orders_stream JOIN og ON t <= snap AND snap < t + l)"""


def _sieved(k: int, eps: float) -> str:
    """CTEs from pf (g, v, u, ft) and looks (g, v, n), for groups g: ix (g, i, since, until), mem (g, i, v, ins), fs (g, i, until, s), value and calls of each index."""
    return f"""dg AS (SELECT g, v, ft AS n, count(*) OVER (PARTITION BY g, v ORDER BY ft) AS d FROM pf),
bg AS (SELECT g, big, min(n) AS since FROM (SELECT g, n, max(d) OVER (PARTITION BY g ORDER BY n) AS big FROM dg) GROUP BY g, big),
bt AS (SELECT g, big, since, lead(since) OVER (PARTITION BY g ORDER BY since) - 1 AS until FROM bg),
ix AS (SELECT g, i, min(since) AS since, CASE WHEN bool_or(until IS NULL) THEN NULL ELSE max(until) END AS until FROM (
  SELECT g, since, until, unnest(generate_series(CAST(floor(ln({1 - eps} * big) / ln({1 + eps})) AS BIGINT), CAST(ceil(ln({2 * k} * big) / ln({1 + eps})) AS BIGINT))) AS i FROM bt) GROUP BY g, i),
ev AS (SELECT g, v, ft AS n, u, 0 AS look FROM pf UNION ALL SELECT DISTINCT g, v, n, NULL, 1 FROM looks),
sv AS (SELECT g, i, since, until, CAST(-1 AS BIGINT) AS ins, CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS s FROM ix
  UNION ALL SELECT g, i, since, until, n, v, list_append(s, v) FROM (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY n, v) AS rn FROM (
    SELECT g, i, since, until, ins, pos, s, v, n, look, sum(d) OVER (PARTITION BY g, i, v ORDER BY n) AS gain FROM (
      SELECT x.g, x.i, x.since, x.until, x.ins, x.pos, x.s, x.v, x.look, unnest(CASE WHEN x.look = 1 THEN [x.n] WHEN c.c IS NULL THEN [x.n] ELSE [x.n, greatest(x.n, c.c)] END) AS n, unnest(CASE WHEN x.look = 1 THEN [0] WHEN c.c IS NULL THEN [1] ELSE [1, -1] END) AS d
      FROM (SELECT sv.*, ev.v, ev.n, ev.u, ev.look FROM sv JOIN ev USING (g) WHERE len(s) < {k} AND NOT list_contains(s, ev.v)) x
      LEFT JOIN (SELECT sv.g, sv.i, pf.u, min(pf.ft) AS c FROM sv JOIN pf ON pf.g = sv.g AND list_contains(sv.s, pf.v) GROUP BY ALL) c ON c.g = x.g AND c.i = x.i AND c.u = x.u))
    WHERE look = 1 AND gain >= pow({1 + eps}, i) / {2 * k} AND n >= since AND (until IS NULL OR n <= until) AND (n > ins OR n = ins AND v > pos)) WHERE rn = 1),
mem AS (SELECT g, i, pos AS v, ins, len(s) AS size FROM sv WHERE len(s) > 0),
fs AS (SELECT g, i, max(until) AS until, max_by(s, len(s)) AS s FROM sv GROUP BY g, i),
wz AS (SELECT ix.g, ix.i, count(*) AS calls FROM ix JOIN (SELECT DISTINCT g, v, n FROM looks) l ON l.g = ix.g AND l.n >= ix.since AND (ix.until IS NULL OR l.n <= ix.until)
  LEFT JOIN mem own ON own.g = ix.g AND own.i = ix.i AND own.v = l.v LEFT JOIN mem full_ ON full_.g = ix.g AND full_.i = ix.i AND full_.size = {k}
  WHERE (own.ins IS NULL OR l.n <= own.ins) AND (full_.ins IS NULL OR l.n < full_.ins OR l.n = full_.ins AND l.v <= full_.v) GROUP BY ALL),
vz AS (SELECT fs.g, fs.i, fs.s, count(DISTINCT pf.u) AS value FROM fs JOIN pf ON pf.g = fs.g AND list_contains(fs.s, pf.v) WHERE fs.until IS NULL GROUP BY ALL),
bz AS (SELECT g, value, i, array_to_string(list_sort(s), ',') AS nodes FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY value DESC, i) AS rn FROM vz) WHERE rn = 1)"""


_GROWN = f"looks AS (SELECT 0 AS g, v, t AS n FROM interactions), pf AS (SELECT 0 AS g, v, u, min(t) AS ft FROM interactions GROUP BY v, u), {_sieved(5, 0.2)}"
_LIVED = f"looks AS (SELECT snap AS g, v, t AS n FROM ongrid), pf AS (SELECT snap AS g, v, u, min(t) AS ft FROM ongrid GROUP BY ALL), {_sieved(5, 0.2)}"
_REACHED = f"""ge AS (SELECT snap, u, v, min(t) AS t FROM directed JOIN grid ON t <= snap AND snap < t + l GROUP BY ALL),
rt(g, v, u, ft) AS (SELECT snap, x, x, min(t) FROM (SELECT snap, u AS x, t FROM ge UNION ALL SELECT snap, v, t FROM ge) GROUP BY ALL UNION SELECT q.g, q.v, e.v, greatest(q.ft, e.t) FROM rt q JOIN ge e ON e.snap = q.g AND e.u = q.u),
pf AS (SELECT g, v, u, min(ft) AS ft FROM rt GROUP BY ALL), looks AS (SELECT g, v, ft AS n FROM pf), {_sieved(5, 0.2)}"""
_BEST = " SELECT {g}value, i, nodes, CAST((SELECT sum(calls) FROM wz WHERE wz.g = bz.g) AS BIGINT) AS calls FROM bz"

_GRAPHS = """ge AS (SELECT DISTINCT snap, u, v FROM directed JOIN grid ON t <= snap AND snap < t + l * 3),
rr(snap, v, u) AS (SELECT snap, x, x FROM (SELECT snap, u AS x FROM ge UNION SELECT snap, v FROM ge) UNION SELECT q.snap, q.v, e.v FROM rr q JOIN ge e ON e.snap = q.snap AND e.u = q.u),
hx AS (SELECT DISTINCT u, CAST('0x' || substr(md5(CAST(u AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM rr),
rg AS (SELECT snap, v AS x, h & 255 AS register, max(53 - CASE WHEN h >> 8 = 0 THEN 0 ELSE length(bin(h >> 8)) END) AS rank FROM rr JOIN hx USING (u) GROUP BY snap, v, h & 255),
sc AS (SELECT x.snap, x.v AS x, min(x.u) AS scc FROM rr x JOIN rr y ON y.snap = x.snap AND y.u = x.v AND y.v = x.u GROUP BY x.snap, x.v)"""


def _estimated(rows: str, keys: str, name: str) -> str:
    """A CTE {name} (keys, reward): what registers of `rows` tell together for each of `keys`."""
    return f"""{name} AS (SELECT {keys}, CASE WHEN raw <= 640 AND c < 256 THEN 256 * ln(256.0 / (256 - c)) ELSE raw END AS reward FROM (
  SELECT {keys}, c, 0.7213 / (1 + 1.079 / 256) * 65536 / (z + 256 - c) AS raw FROM (SELECT {keys}, sum(pow(2.0, -rank)) AS z, count(*) AS c FROM (SELECT {keys}, register, max(rank) AS rank FROM {rows} GROUP BY ALL) GROUP BY {keys})))"""


def _changed(keys: str, lives: str) -> str:
    """(keys, n, x, before) of `lives` (keys, t, l): running counts of lives at the steps that change them."""
    return f"(SELECT {keys}, n, d, sum(d) OVER (PARTITION BY {keys} ORDER BY n) AS x FROM (SELECT {keys}, n, sum(d) AS d FROM (SELECT {keys}, t AS n, 1 AS d FROM {lives} UNION ALL SELECT {keys}, t + l, -1 FROM {lives}) GROUP BY ALL HAVING sum(d) <> 0))"


_KIND = "CASE WHEN x = d THEN 'insert' WHEN x = 0 THEN 'erase' ELSE 'change' END AS change"
_P = "round(2 / (1 + exp(-0.2 * x)) - 1, 6) AS p"
_SET = "(SELECT snap, register, rank FROM rg WHERE x IN (SELECT v FROM given))"

ORACLES: dict[str, str] = {
    "stream_edges": _BASE + "z AS (SELECT 1) SELECT t, u, v, l FROM interactions",
    "directed_edges": _BASE + "z AS (SELECT 1) SELECT t, u, v, l FROM directed",
    "alive_edges": _BASE + "z AS (SELECT 1) SELECT t, u, v, l FROM alive",
    "alive_size_per_step": _BASE + "d AS (SELECT t AS step, 1 AS d FROM interactions UNION ALL SELECT t + l, -1 FROM interactions) SELECT step, CAST(sum(sum(d)) OVER (ORDER BY step) AS BIGINT) AS n_alive FROM d GROUP BY step",
    "prefix_reward": _BASE + "f AS (SELECT v, u, min(t) AS n FROM interactions GROUP BY v, u) SELECT v, n, count(*) OVER (PARTITION BY v ORDER BY n) AS reward FROM f",
    "batch_steps": _BASE + "b AS (SELECT (t - 1) // 64 + 1 AS step, v, t FROM interactions) SELECT step, count(*) AS n_rows, count(DISTINCT v) AS n_affected, max(t) AS last_row FROM b GROUP BY step HAVING count(*) = 64",
    "batch_steps_to_end": _BASE + "b AS (SELECT (t - 1) // 30 + 1 AS step, v, t FROM interactions) SELECT step, count(*) AS n_rows, count(DISTINCT v) AS n_affected, max(t) AS last_row FROM b WHERE step <= 10 GROUP BY step HAVING count(*) = 30",
    "venue_reward": _BASE + "z AS (SELECT 1) SELECT v, count(DISTINCT u) AS reward FROM alive GROUP BY v",
    "max_singleton_per_step": _BASE + "x AS (SELECT s AS snap, v, count(DISTINCT u) AS d FROM (SELECT v, u, unnest(generate_series(t, least(t + l - 1, n))) AS s FROM interactions, size) GROUP BY ALL) SELECT snap, max(d) AS most FROM x GROUP BY snap",
    "set_reward": _BASE + "z AS (SELECT 1) SELECT snap, count(DISTINCT u) AS reward FROM ongrid WHERE v IN (SELECT v FROM given) GROUP BY snap",
    "set_gain": _BASE + "c AS (SELECT DISTINCT u FROM alive WHERE v IN (SELECT v FROM given)) SELECT v, count(DISTINCT u) FILTER (u NOT IN (SELECT u FROM c)) AS gain FROM alive GROUP BY v",
    "given_set_eval": _BASE + "z AS (SELECT 1) SELECT count(DISTINCT u) AS reward FROM interactions, size WHERE t <= n AND n < t + l AND v IN (SELECT v FROM given)",
    "largest_reward_so_far": _BASE + "f AS (SELECT v, u, min(t) AS n FROM interactions GROUP BY v, u), d AS (SELECT n, count(*) OVER (PARTITION BY v ORDER BY n) AS r FROM f) SELECT n, max(r) OVER (ORDER BY n) AS most FROM d",
    "threshold_ranges": _BASE + """f AS (SELECT v, u, min(t) AS n FROM interactions GROUP BY v, u), d AS (SELECT n, count(*) OVER (PARTITION BY v ORDER BY n) AS r FROM f),
b AS (SELECT most, min(n) AS since FROM (SELECT n, max(r) OVER (ORDER BY n) AS most FROM d) GROUP BY most), q AS (SELECT most, since, lead(since) OVER (ORDER BY since) - 1 AS until FROM b),
i AS (SELECT since, until, unnest(generate_series(CAST(floor(ln(0.8 * most) / ln(1.2)) AS BIGINT), CAST(ceil(ln(10 * most) / ln(1.2)) AS BIGINT))) AS i FROM q)
SELECT i, min(since) AS since, CASE WHEN bool_or(until IS NULL) THEN -1 ELSE max(until) END AS until FROM i GROUP BY i""",
    "greedy_at": _BASE + "p AS (SELECT m AS snap, v, u FROM alive, middle), " + _greedy("p", 10) + " SELECT snap, CAST(step AS BIGINT) AS rank, v, gain, calls FROM g WHERE step > 0",
    "greedy_per_snapshot": _BASE + _greedy("ongrid", 5) + " SELECT snap, CAST(sum(gain) AS BIGINT) AS value, string_agg(v, ',' ORDER BY step) AS nodes, CAST(sum(calls) AS BIGINT) AS calls FROM g WHERE step > 0 GROUP BY snap",
    "greedy_by_budget": _BASE + _greedy("ongrid", 10) + " SELECT snap, CAST(step AS BIGINT) AS budget, CAST(sum(gain) OVER (PARTITION BY snap ORDER BY step) AS BIGINT) AS value FROM g WHERE step > 0",
    "greedy_prefix": _BASE + "p AS (SELECT snap, v, u FROM interactions JOIN grid ON t <= snap), " + _greedy("p", 5) + " SELECT snap, CAST(sum(gain) AS BIGINT) AS value FROM g GROUP BY snap",
    "greedy_orders": _BASE + _ORDERS + ", " + _greedy("op", 5) + " SELECT snap, CAST(sum(gain) AS BIGINT) AS value FROM g GROUP BY snap",
    "naive_calls": _BASE + "x AS (SELECT snap, count(DISTINCT v) AS n_nodes FROM ongrid GROUP BY snap) SELECT snap, n_nodes, n_nodes * 5 AS calls, CAST(sum(n_nodes * 5) OVER (ORDER BY snap) AS BIGINT) AS total FROM x",
    "random_baseline": _BASE + """d AS (SELECT snap, v, rep, row_number() OVER (PARTITION BY snap, rep ORDER BY CAST('0x' || substr(md5('0|' || snap || '|' || v || '|' || rep), 1, 8) AS UBIGINT), v) AS r FROM (SELECT DISTINCT snap, v FROM ongrid), (SELECT unnest([1, 2, 3]) AS rep)),
c AS (SELECT snap, rep, count(DISTINCT u) AS n FROM ongrid JOIN d USING (snap, v) WHERE r <= 5 GROUP BY ALL) SELECT snap, round(avg(n), 6) AS value FROM c GROUP BY snap""",
    "lifetime_reduction": _BASE + _LIVED + _BEST.format(g="g AS snap, "),
    "reduction_reach": _BASE + _REACHED + _BEST.format(g="g AS snap, "),
    "sieve_prefix": _BASE + _GROWN + _BEST.format(g=""),
    "sieve_series": _BASE + _GROWN + """, cv AS (SELECT i, u, min(greatest(ft, ins)) AS c FROM mem JOIN pf USING (g, v) GROUP BY i, u),
gr AS (SELECT i, c AS n, sum(count(*)) OVER (PARTITION BY i ORDER BY c) AS value, lead(c) OVER (PARTITION BY i ORDER BY c) - 1 AS next FROM cv GROUP BY i, c),
sp AS (SELECT i, greatest(n, since) AS n, value, least(coalesce(next, 1000000000000), coalesce(until, 1000000000000)) AS upto FROM gr JOIN ix USING (i)),
ch AS (SELECT n FROM sp WHERE upto >= n UNION SELECT until + 1 FROM ix WHERE until IS NOT NULL)
SELECT ch.n, CAST(max(value) AS BIGINT) AS value FROM ch JOIN sp ON sp.n <= ch.n AND ch.n <= sp.upto GROUP BY ch.n""",
    "streamed_sieve": _BASE + _GROWN + """, en AS (SELECT DISTINCT p * n // 4 AS e FROM size, (SELECT unnest([1, 2, 3, 4]) AS p)),
cv AS (SELECT e, i, u FROM mem JOIN en ON ins <= e JOIN pf USING (g, v) WHERE ft <= e GROUP BY ALL),
va AS (SELECT e, i, count(*) AS value FROM cv JOIN ix USING (i) WHERE since <= e AND (until IS NULL OR until >= e) GROUP BY e, i),
be AS (SELECT e, max(value) AS value, arg_max(i, value * 1000 - i) AS i FROM va GROUP BY e)
SELECT e AS n, value, CAST(be.i AS BIGINT) AS i, (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM mem WHERE mem.i = be.i AND mem.ins <= be.e) AS nodes FROM be""",
    "reach_size": _BASE + f"{_graph()}, {_reach()} SELECT src AS x, count(*) AS reward FROM r GROUP BY src",
    "reach_gain": _BASE + f"{_graph()}, {_reach()}, c AS (SELECT dst FROM r WHERE src IN (SELECT v FROM given)) SELECT src AS x, count(*) FILTER (dst NOT IN (SELECT dst FROM c)) AS gain FROM r GROUP BY src",
    "greedy_reach": _BASE + "ge AS (SELECT DISTINCT snap, u, v FROM directed JOIN grid ON t <= snap AND snap < t + l), rr(snap, v, u) AS (SELECT snap, x, x FROM (SELECT snap, u AS x FROM ge UNION SELECT snap, v FROM ge) UNION SELECT q.snap, q.v, e.v FROM rr q JOIN ge e ON e.snap = q.snap AND e.u = q.u), " + _greedy("rr", 5) + " SELECT snap, CAST(sum(gain) AS BIGINT) AS value FROM g GROUP BY snap",
    "affected_nodes": _BASE + f"{_graph()}, {_graph(1, 1, 'a1')}, {_reach()}, {_reach('a1', 'r1')} SELECT DISTINCT src AS x FROM (SELECT src, dst FROM r1 EXCEPT SELECT src, dst FROM r)",
    "scc": _BASE + f"{_graph(0, 3)}, {_reach()} SELECT x.src AS x, min(x.dst) AS scc FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src",
    "scc_edges": _BASE + f"{_graph(0, 3)}, {_reach()}, s AS (SELECT x.src AS x, min(x.dst) AS scc FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src) SELECT DISTINCT p.scc AS u, q.scc AS v FROM a JOIN s p ON p.x = a.u JOIN s q ON q.x = a.v WHERE p.scc <> q.scc",
    "sketched_reach": _BASE + f"{_graph(0, 20)}, {_reach()} SELECT src AS x, count(*) AS reward, TRUE AS close FROM r GROUP BY src",
    "reach_registers": _BASE + _GRAPHS + " SELECT snap, x, register, CAST(rank AS BIGINT) AS rank FROM rg",
    "reach_registers_by_levels": _BASE + _GRAPHS + " SELECT snap, x, register, CAST(rank AS BIGINT) AS rank FROM rg",
    "reach_estimate": _BASE + _GRAPHS + ", " + _estimated("rg", "snap, x", "es") + " SELECT snap, x, round(reward, 6) AS reward FROM es",
    "reach_set_estimate": _BASE + _GRAPHS + ", " + _estimated(_SET, "snap", "es") + " SELECT snap, round(reward, 6) AS reward FROM es",
    "reach_gain_estimate": _BASE + _GRAPHS + ", " + _estimated(_SET, "snap", "es") + ", bo AS (SELECT n.snap, n.x, register, rank FROM (SELECT DISTINCT snap, x FROM rg) n JOIN " + _SET + " USING (snap) UNION ALL SELECT snap, x, register, rank FROM rg), " + _estimated("bo", "snap, x", "eb") + " SELECT snap, x, round(eb.reward - coalesce(es.reward, 0), 6) AS gain FROM eb LEFT JOIN es USING (snap)",
    "scc_levels": _BASE + _GRAPHS + ", de AS (SELECT DISTINCT snap, p.scc AS u, q.scc AS v FROM ge JOIN sc p USING (snap) JOIN sc q USING (snap) WHERE p.x = ge.u AND q.x = ge.v AND p.scc <> q.scc), lv(snap, x, d) AS (SELECT DISTINCT snap, scc, 0 FROM sc UNION SELECT l.snap, de.u, l.d + 1 FROM lv l JOIN de ON de.snap = l.snap AND de.v = l.x) SELECT snap, x, CAST(max(d) AS BIGINT) AS level FROM lv GROUP BY snap, x",
    "reach_size_by_levels": _BASE + _GRAPHS + " SELECT snap, v AS x, count(*) AS reward FROM rr GROUP BY snap, v",
    "affected_by_batches": _BASE + "bt AS (SELECT u, v, min((t - 1) // e + 1) AS b FROM directed, (SELECT greatest(1, n // 8) AS e FROM size) GROUP BY u, v), rt(v, u, b) AS (SELECT x, x, min(b) FROM (SELECT u AS x, b FROM bt UNION ALL SELECT v, b FROM bt) GROUP BY x UNION SELECT q.v, e.v, greatest(q.b, e.b) FROM rt q JOIN bt e ON e.u = q.u), f AS (SELECT v, u, min(b) AS b FROM rt GROUP BY v, u) SELECT DISTINCT b AS step, v AS x FROM f",
    "streamed_rewards": _BASE + """r AS (SELECT v, u, t, t + l AS e, max(t + l) OVER (PARTITION BY v, u ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM interactions),
i AS (SELECT v, u, t, e, sum(CASE WHEN pe IS NULL OR t > pe THEN 1 ELSE 0 END) OVER (PARTITION BY v, u ORDER BY t) AS k FROM r), s AS (SELECT v, min(t) AS a, max(e) AS b FROM i GROUP BY v, u, k),
ev AS (SELECT v, n, sum(d) AS d FROM (SELECT v, a AS n, 1 AS d FROM s UNION ALL SELECT v, b, -1 FROM s UNION ALL SELECT v, t, 0 FROM interactions) GROUP BY v, n)
SELECT v, w.n, CAST(x AS BIGINT) AS reward FROM (SELECT v, n, sum(d) OVER (PARTITION BY v ORDER BY n) AS x FROM ev) w, size WHERE w.n < size.n""",
    "edge_changes": _BASE + f"z AS (SELECT 1) SELECT n, u, v, CAST(x AS BIGINT) AS x, {_P}, {_KIND} FROM " + _changed("u, v", "directed"),
    "vertex_changes": _BASE + f"ends AS (SELECT u AS node, t, l FROM directed UNION ALL SELECT v, t, l FROM directed) SELECT n, node AS x, change FROM (SELECT *, {_KIND} FROM " + _changed("node", "ends") + ") WHERE change <> 'change'",
    "edges_from_changes": _BASE + f"{_graph()} SELECT u, v, count(*) AS x, round(2 / (1 + exp(-0.2 * count(*))) - 1, 6) AS p FROM a GROUP BY u, v",
    "bitmap_set_reward": _BASE + "z AS (SELECT 1) SELECT snap, count(DISTINCT u) AS reward FROM ongrid WHERE v IN (SELECT v FROM given) GROUP BY snap",
    "bitmap_set_gain": _BASE + "c AS (SELECT DISTINCT snap, u, 1 AS held FROM ongrid WHERE v IN (SELECT v FROM given)) SELECT snap, v, count(DISTINCT u) FILTER (held IS NULL) AS gain FROM ongrid LEFT JOIN c USING (snap, u) GROUP BY snap, v",
    "bitmap_greedy": _BASE + _greedy("ongrid", 5) + " SELECT snap, CAST(step AS BIGINT) AS rank, v, gain FROM g WHERE step > 0",
    "replayed_sets": _BASE + _greedy("ongrid", 5) + " SELECT snap, CAST(sum(gain) AS BIGINT) AS told, CAST(sum(gain) AS BIGINT) AS found FROM g GROUP BY snap",
    "observed_run": _BASE + _greedy("ongrid", 5) + " SELECT (SELECT count(*) FROM ongrid) AS live, (SELECT max(snap) FROM ongrid) AS last, count(DISTINCT snap) AS snapshots, CAST(sum(calls) AS BIGINT) AS calls FROM g",
    "edge_probabilities": _BASE + _multiplicity(20) + " SELECT u, v, x, round(p, 6) AS p FROM m2",
    "node_degrees": _BASE + f"{_graph(0, 20)}, e AS (SELECT u AS x, 0 AS i, 1 AS o FROM a UNION ALL SELECT v, 1, 0 FROM a) SELECT x, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM e GROUP BY x",
    "influence_sketches": _BASE + _sketches() + " SELECT s, x FROM rr",
    "sketch_weights": _BASE + _WEIGHTS + " SELECT s, weight FROM w",
    "sketch_budget": _BASE + _sketches(last=16383) + _W + ", nn AS (SELECT (SELECT count(*) FROM o) AS n, (SELECT count(*) FROM m2) AS m) SELECT s, weight FROM (SELECT s, weight, sum(weight) OVER (ORDER BY s) AS total FROM w), nn WHERE total - weight < 2.0 * (n + m) * log2(n)",
    "influence_maximization": _BASE + _sketches() + ", p AS (SELECT 0 AS snap, x AS v, s AS u FROM rr), " + _greedy("p", 10) + " SELECT CAST(step AS BIGINT) AS rank, v AS x, gain FROM g WHERE step > 0",
    "influence_estimate": _BASE + _sketches() + " SELECT x, round((SELECT count(*) FROM o) * count(DISTINCT s) / (SELECT count(DISTINCT s) FROM rr), 6) AS influence FROM rr GROUP BY x",
    "sketch_update": _BASE + _sketches() + ", " + _sketches(1, "1") + " SELECT s, x, 'gained' AS change FROM (SELECT s, x FROM rr1 EXCEPT SELECT s, x FROM rr) UNION ALL SELECT s, x, 'lost' FROM (SELECT s, x FROM rr EXCEPT SELECT s, x FROM rr1)",
    "reach_of_set": _BASE + f"{_graph(0, 20)}, {_reach()} SELECT count(DISTINCT dst) AS reward, TRUE AS close FROM r WHERE src IN (SELECT v FROM given)",
    "reach_gain_longer": _BASE + f"{_graph(0, 20)}, {_reach()}, c AS (SELECT DISTINCT dst FROM r WHERE src IN (SELECT v FROM given)) SELECT src AS x, count(*) FILTER (dst NOT IN (SELECT dst FROM c)) AS gain FROM r GROUP BY src",
    "sketch_repair": _BASE + """ks AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
gm AS (SELECT k, u, v, 2 / (1 + exp(-0.2 * count(*))) - 1 AS p FROM directed, middle, ks WHERE t <= m + 10 * k AND m + 10 * k < t + l * 20 GROUP BY k, u, v),
nd AS (SELECT DISTINCT k, x FROM (SELECT k, u AS x FROM gm UNION ALL SELECT k, v FROM gm)),
dw AS (SELECT s, j, CAST(CAST('0x' || substr(md5('z|' || s || '|' || j), 1, 8) AS UBIGINT) % (SELECT max(u) + 1 FROM interactions) AS BIGINT) AS x FROM (SELECT unnest(generate_series(0, 199)) AS s), (SELECT unnest(generate_series(0, 999)) AS j)),
tk AS (SELECT k, s, arg_min(x, j) AS x FROM dw JOIN nd USING (x) GROUP BY k, s),
hk(k, s, x) AS (SELECT k, s, x FROM tk UNION SELECT q.k, q.s, e.u FROM hk q JOIN gm e ON e.k = q.k AND e.v = q.x WHERE CAST('0x' || substr(md5(q.s || '|' || e.u || '|' || e.v), 1, 8) AS UBIGINT) / 4294967296.0 < e.p)
SELECT k AS step, s, x, 'gained' AS change FROM (SELECT k, s, x FROM hk WHERE k > 0 EXCEPT SELECT k + 1, s, x FROM hk)
UNION ALL SELECT k, s, x, 'lost' FROM (SELECT k + 1 AS k, s, x FROM hk WHERE k < 4 EXCEPT SELECT k, s, x FROM hk)""",
    "influence_of_set": _BASE + _sketches() + " SELECT round((SELECT count(*) FROM o) * count(DISTINCT s) / (SELECT count(DISTINCT s) FROM rr), 6) AS influence FROM rr WHERE x IN (SELECT v FROM given)",
    "seeds_reach": _BASE + """mg AS (SELECT snap, u, v, 2 / (1 + exp(-0.2 * count(*))) - 1 AS p FROM directed JOIN grid ON t <= snap AND snap < t + l GROUP BY ALL),
og AS (SELECT snap, x, row_number() OVER (PARTITION BY snap ORDER BY x) - 1 AS rank, count(*) OVER (PARTITION BY snap) AS n FROM (SELECT snap, u AS x FROM mg UNION SELECT snap, v FROM mg)),
sk AS (SELECT snap, s, CAST(CAST('0x' || substr(md5('z|' || s), 1, 8) AS UBIGINT) % n AS BIGINT) AS rank FROM (SELECT DISTINCT snap, n FROM og), (SELECT unnest(generate_series(0, 199)) AS s)),
hs AS (SELECT snap, s, x FROM sk JOIN og USING (snap, rank) UNION SELECT q.snap, q.s, e.u FROM hs q JOIN mg e ON e.snap = q.snap AND e.v = q.x WHERE CAST('0x' || substr(md5(q.s || '|' || e.u || '|' || e.v), 1, 8) AS UBIGINT) / 4294967296.0 < e.p),
hp AS (SELECT snap, x AS v, s AS u FROM hs), """ + _greedy("hp", 5) + """, le AS (SELECT DISTINCT u, v FROM mg WHERE snap = (SELECT max(snap) FROM grid)),
lr AS (SELECT x AS src, x AS dst FROM (SELECT u AS x FROM le UNION SELECT v FROM le) UNION SELECT q.src, e.v FROM lr q JOIN le e ON e.u = q.dst)
SELECT snap, string_agg(DISTINCT g.v, ',' ORDER BY g.v) AS seeds, count(DISTINCT lr.dst) AS reached FROM g LEFT JOIN lr ON lr.src = g.v WHERE step > 0 GROUP BY snap""",
    "text_stream": _BASE + "z AS (SELECT 1) SELECT t, u, v, l FROM interactions",
    "text_pairs": _BASE + "z AS (SELECT 1) SELECT t, u, v, CAST(1 AS BIGINT) AS l FROM interactions",
    "text_weighted": _BASE + _multiplicity(20) + " SELECT u, v, round(p, 9) AS p FROM m2",
    "text_graph": _BASE + _multiplicity(20) + " SELECT u, v, x AS n FROM m2",
    "text_nodes": _BASE + _greedy("ongrid", 5) + " SELECT DISTINCT v + 1000 AS name FROM g WHERE step > 0",
    "text_series": _BASE + _greedy("ongrid", 10) + " SELECT 'greedy' AS solver, k, snap, printf('%.2f', CAST(sum(gain) AS DOUBLE)) AS value, CAST(sum(calls) AS BIGINT) AS calls FROM g, (SELECT CAST(unnest([5, 10]) AS BIGINT) AS k) WHERE step > 0 AND step <= k GROUP BY k, snap",
    "streamed_windows": "SELECT CAST(epoch(h) AS BIGINT) AS start, v, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS h, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS v FROM events) WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL",
}
