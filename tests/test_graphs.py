import math
import random

import pytest
from replay import reach as plain_reach
from support import rows

from tideset.operators import graphs, greedy, registers


def digraphs(seed, groups=2, nodes=14, edges=22):
    draw = random.Random(seed)
    return [(g, draw.randrange(nodes), draw.randrange(nodes)) for g in range(groups) for _ in range(edges)]


def closure(data):
    """{group: {node: nodes that it reaches}}"""
    return {g: plain_reach([(u, v) for h, u, v in data if h == g and u != v]) for g in {g for g, _, _ in data}}


def frame(spark, data):
    return spark.createDataFrame(data, "g int, u long, v long")


@pytest.mark.parametrize("seed", [1, 2])
def test_registers_sent_along_edges_are_those_of_all_that_a_node_reaches(spark, seed):
    data = digraphs(seed)
    df = frame(spark, data)
    own = {(r["x"], r["register"], r["rank"]) for r in registers.own_registers(spark.range(14).withColumnRenamed("id", "x"), bits=4).collect()}
    want = {}
    for g, cover in closure(data).items():
        for v, reached in cover.items():
            for x, register, rank in own:
                if x in reached:
                    want[g, v, register] = max(rank, want.get((g, v, register), 0))
    want = sorted((*k, r) for k, r in want.items())
    assert rows(registers.propagated(df, ["g"], 4), "g", "x", "register", "rank") == want
    assert rows(registers.by_levels(df, ["g"], 4), "g", "x", "register", "rank") == want


def test_estimates_are_near_and_gains_are_differences(spark):
    draw = random.Random(4)
    data = [(0, i, j) for i in range(300) for j in draw.sample(range(300), 2) if i < j or draw.random() < 0.1]
    found = registers.propagated(frame(spark, data), ["g"], 8)
    cover = closure(data)[0]
    for r in registers.estimated(found, ["x"], 8).collect():
        assert abs(r["reward"] - len(cover[r["x"]])) <= 1 + 4 * 1.04 / 16 * len(cover[r["x"]])
    chosen = spark.createDataFrame([(5,), (250,), (999,)], "x long")
    base = registers.set_reward(found, chosen, bits=8).first()["reward"]
    gained = {r["x"]: r["gain"] for r in registers.gains(found, chosen, bits=8).collect()}
    assert set(gained) == set(cover) and gained[5] == pytest.approx(0, abs=1e-9)
    for x in sorted(gained)[::120]:
        both = registers.set_reward(found, spark.createDataFrame([(5,), (250,), (x,)], "x long"), bits=8).first()["reward"]
        assert gained[x] == pytest.approx(both - base, abs=1e-9)
    alone = {r["x"]: r["gain"] for r in registers.gains(found, chosen.limit(0), bits=8).collect()}
    assert alone == pytest.approx({r["x"]: r["reward"] for r in registers.estimated(found, ["x"], 8).collect()})


@pytest.mark.parametrize("seed, trims", [(5, 0), (6, 3)])
def test_components_levels_and_exact_reach_by_levels(spark, seed, trims):
    data = digraphs(seed, 3, 16, 24) + [(7, i, (i + 1) % 9) for i in range(9)] + [(8, 1, 1)]
    df = frame(spark, data)
    cover = closure(data)
    scc = {(g, x): min(y for y in c if x in cover[g][y]) for g in cover for x, c in cover[g].items()}
    assert rows(graphs.components(df, ["g"], trims), "g", "x", "scc") == sorted((g, x, s) for (g, x), s in scc.items())
    assert rows(graphs.reach_by_levels(df, ["g"]), "g", "x", "reward") == sorted((g, x, len(c)) for g in cover for x, c in cover[g].items())
    below = {k: {scc[k[0], y] for y in cover[k[0]][k[1]]} - {s} for k, s in scc.items()}

    def level(g, s):
        return max([0, *(1 + level(g, t) for t in below[g, s])])

    order = graphs.condensed(graphs.edges(df, ["g"]), graphs.components(df, ["g"]), ["g"])
    members = graphs.components(df, ["g"]).select("g", graphs.F.col("scc").alias("x"))
    assert rows(graphs.levels(order, members, ["g"]), "g", "x", "level") == sorted({(g, s, level(g, s)) for (g, _), s in scc.items()})
    with pytest.raises(ValueError, match="cycle"):
        graphs.levels(spark.createDataFrame([(1, 2), (2, 1)], "u long, v long"), spark.createDataFrame([(1,), (2,)], "x long"))


def test_plans_of_components_hold_no_pairs(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)], "u long, v long")
    scc = graphs.components(ring)
    assert rows(scc) == [(i, 0) for i in range(40)]


def test_reach_that_grows_by_batches_is_that_of_the_whole_graph(spark):
    draw = random.Random(9)
    data = [(draw.randrange(12), draw.randrange(12)) for _ in range(26)]
    grown, seen = graphs.GrowingReach(), []
    for at in range(0, 26, 5):
        before = {(v, u) for v, c in plain_reach([e for e in seen if e[0] != e[1]]).items() for u in c}
        seen += data[at : at + 5]
        after = {(v, u) for v, c in plain_reach([e for e in seen if e[0] != e[1]]).items() for u in c}
        assert set(rows(grown.extend(spark.createDataFrame(data[at : at + 5], "u long, v long")), "v", "u")) == after - before
    pairs = rows(grown.pairs(), "v", "u")
    assert pairs == sorted(after)
    # the four kinds of edges: both ends new, one of them, none; an edge between connected nodes adds nothing
    one = graphs.GrowingReach(spark.createDataFrame([(1, 2)], "u long, v long"))
    for edge, gained in [((3, 4), [(3, 3), (3, 4), (4, 4)]), ((2, 5), [(1, 5), (2, 5), (5, 5)]), ((6, 1), [(6, 1), (6, 2), (6, 5), (6, 6)]), ((5, 3), [(v, u) for v in (1, 2, 5, 6) for u in (3, 4)]), ((1, 4), []), ((7, 7), [])]:
        assert rows(one.extend(spark.createDataFrame([edge], "u long, v long")), "v", "u") == sorted(gained)


def test_affected_nodes_of_batches(spark):
    data = [(1, 1, 2), (1, 2, 3), (2, 1, 3), (3, 3, 4), (3, 5, 5)]
    assert rows(graphs.affected_by_batches(spark.createDataFrame(data, "step int, u long, v long"))) == [(1, 1), (1, 2), (1, 3), (3, 1), (3, 2), (3, 3), (3, 4)]
    assert graphs.affected_by_batches(spark.createDataFrame([], "step int, u long, v long")).count() == 0


def lazily(cover, k):
    """Picks (v, gain, calls) by the rule of `max_coverage`, told plainly."""
    bounds, covered, out = {v: math.inf for v in cover}, set(), []
    while bounds and len(out) < k:
        top = min(bounds, key=lambda v: (-bounds[v], v))
        least = len(cover[top] - covered)
        asked = {v for v, b in bounds.items() if v == top or b > least or b == least and v < top}
        bounds |= {v: len(cover[v] - covered) for v in asked}
        best = min(asked, key=lambda v: (-bounds[v], v))
        out.append((best, bounds.pop(best), len(asked)))
        covered |= cover[best]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lazy_greedy_takes_what_greedy_takes_and_weighs_less(spark, seed):
    draw = random.Random(seed)
    data = [(g, draw.randrange(5 + 9 * g), int(30 * draw.random() ** 2)) for g in range(4) for _ in range(10 + 60 * g)]
    got = {}
    for r in greedy.max_coverage(spark.createDataFrame(data, "snap int, v long, u long"), 9).collect():
        got.setdefault(r["snap"], {})[r["rank"]] = (r["v"], r["gain"], r["calls"])
    calls = naive = 0
    for g in range(4):
        cover = {}
        for h, v, u in data:
            if h == g:
                cover.setdefault(v, set()).add(u)
        want = lazily(cover, 9)
        assert [got[g][rank] for rank in sorted(got[g])] == want and sorted(got[g]) == list(range(1, len(want) + 1))
        calls, naive = calls + sum(c for *_, c in want), naive + len(cover) * len(want)
    assert calls < naive / 2
