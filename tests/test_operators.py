import itertools
import math
import random

import pytest
import replay
from support import rows
from pyspark.sql import functions as F

from tideset import experiments
from tideset.functions import activation
from tideset.operators import baselines, graphs, greedy, influence, lifetimes, pruned_list, rewards, sieve
from tideset.plans import numbered, running
from tideset.sources import directed, from_events

SF = "/root/testdata/sf0.001"


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def random_stream(seed, n, users, venues, life):
    draw = random.Random(seed)
    return [(t, draw.randrange(users), draw.randrange(venues), draw.randint(1, life)) for t in range(1, n + 1)]


STREAM = "t long, u long, v long, l long"


def test_numbering_follows_the_order_with_ties_and_nulls(spark):
    data = [(random.Random(i).choice([None, 1, 2, 2, 3]), i) for i in range(500)]
    got = {r["b"]: r["t"] for r in numbered(frame(spark, data, "a long, b long"), ["a", "b"]).collect()}
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [got[b] for _, b in want] == list(range(1, 501))
    assert numbered(frame(spark, [], "a long, b long"), ["a", "b"]).count() == 0


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_aggregates_include_peers_and_cross_slices(spark, how):
    draw = random.Random(1)
    data = [(draw.randrange(3), draw.randrange(40), draw.randint(-3, 9)) for _ in range(300)]
    got = rows(running(frame(spark, data, "k int, n long, x long"), ["k"], "n", "x", "r", how, width=5))
    fold = sum if how == "sum" else max
    assert got == sorted((k, n, x, fold(z for a, m, z in data if a == k and m <= n)) for k, n, x in data)


def test_rows_live_as_long_as_they_say(spark):
    stream = frame(spark, [(1, 1, 9, 2), (2, 2, 9, 1), (3, None, 9, 1), (4, 1, 1, 0), (5, 3, 2, 700)], STREAM)
    assert [r[0] for r in rows(lifetimes.valid(stream, 50), "l")] == [1, 2, 50]
    live = lifetimes.alive_on(lifetimes.valid(stream, 50), 1, 3, 1)
    assert rows(rewards.node_reward(live, ["snap"])) == [(1, 9, 1), (2, 9, 2)]
    assert lifetimes.alive_at(lifetimes.valid(stream), 3).count() == 0
    assert rows(lifetimes.in_batches(stream, 2), "t", "step") == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert rows(lifetimes.size_per_step(lifetimes.valid(stream, 50)))[:3] == [(1, 1), (2, 2), (3, 0)]


def test_the_grid_has_the_rows_of_each_snapshot(spark):
    data = random_stream(3, 200, 9, 7, 30)
    got = rows(lifetimes.alive_on(frame(spark, data, STREAM), 15, 195, 20), "snap", "t")
    assert got == sorted((s, t) for s in range(15, 196, 20) for t, _, _, l in data if t <= s < t + l)


def test_directed_rows_link_successive_visitors(spark):
    data = random_stream(5, 300, 6, 5, 3)
    want, last = [], {}
    for t, u, v, l in data:
        if v in last and last[v] != u:
            want.append((t, last[v], u, l))
        last[v] = u
    assert rows(directed(frame(spark, data, STREAM), width=16)) == want


def test_rewards_and_gains(spark):
    draw = random.Random(2)
    pairs = sorted({(draw.randrange(8), draw.randrange(12)) for _ in range(40)})
    df = frame(spark, pairs + pairs[:5], "v long, u long")
    chosen = frame(spark, [(1,), (2,), (99,)], "v long")
    cover = replay.coverage([(u, v) for v, u in pairs])
    both = cover.get(1, set()) | cover.get(2, set())
    assert rows(rewards.node_reward(df)) == sorted((v, len(c)) for v, c in cover.items())
    assert rows(rewards.set_reward(df, chosen)) == [(len(both),)]
    assert rows(rewards.gains(df, chosen)) == sorted((v, len(c - both)) for v, c in cover.items())
    estimate = {r["v"]: r["reward"] for r in rewards.sketched_reward(rewards.node_sketches(df)).collect()}
    assert all(abs(estimate[v] - len(c)) <= 1 for v, c in cover.items())
    assert abs(rewards.sketched_reward(rewards.node_sketches(df), chosen).first()["reward"] - len(both)) <= 1


def test_greedy_takes_the_smallest_of_equal_nodes_and_fills_up(spark):
    tie = frame(spark, [(0, 1, 1), (0, 1, 2), (0, 2, 3), (0, 2, 4)], "snap long, v long, u long")
    assert rows(greedy.max_coverage(tie, 1)) == [(0, 1, 1, 2, 2)]
    data = [(s, v, u) for s in range(4) for u, v in {(random.Random(100 * s + i).randrange(9), random.Random(77 * i + s).randrange(6)) for i in range(14)}]
    got = greedy.max_coverage(frame(spark, data, "snap long, v long, u long"), 8).collect()
    for s in range(4):
        chosen, gains = replay.greedy(replay.coverage([(u, v) for g, v, u in data if g == s]), 8)
        own = sorted((r for r in got if r["snap"] == s), key=lambda r: r["rank"])
        assert [r["v"] for r in own] == chosen and [r["gain"] for r in own] == gains
    assert greedy.max_coverage(frame(spark, [], "snap long, v long, u long"), 3).count() == 0


def test_greedy_is_within_its_bound(spark):
    draw = random.Random(9)
    pairs = sorted({(0, draw.randrange(10), draw.randrange(15)) for _ in range(35)})
    cover = replay.coverage([(u, v) for _, v, u in pairs])
    best = max(len(set().union(*(cover[v] for v in s))) for s in itertools.combinations(cover, 3))
    value = greedy.solution_value(greedy.max_coverage(frame(spark, pairs, "snap int, v long, u long"), 3)).first()["value"]
    assert (1 - 1 / math.e) * best <= value <= best


@pytest.mark.parametrize("reward", ["coverage", "reach"])
def test_sieve_is_the_replay_of_the_stream(spark, reward):
    streams = {s: [(t, u, v) for t, u, v, _ in random_stream(20 + s, 90, 12, 9, 2)] for s in range(3)}
    data = [(s, t, u, v) for s, held in streams.items() for t, u, v in held]
    df = frame(spark, data, "stream long, t long, u long, v long")
    if reward == "coverage":
        first, points = rewards.first_times(df, ["stream"]), df.selectExpr("stream", "v", "t AS n")
    else:
        first = graphs.reach_times(df, ["stream"])
        points = first.selectExpr("stream", "v", "ft AS n")
    sets, ranges = sieve.sieve(first, points, 3, 0.2, ["stream"])
    held = {(r["stream"], r["i"]): set() for r in ranges.where("until IS NULL").collect()}
    for r in sets.collect():
        if (r["stream"], r["i"]) in held:
            held[r["stream"], r["i"]].add(r["v"])
    best = {r["stream"]: r["value"] for r in sieve.best_set(sets, ranges, first, ["stream"]).collect()}
    changes = {(r["stream"], r["n"]): r["value"] for r in sieve.value_per_step(sets, ranges, first, ["stream"]).collect()}
    for s, own in streams.items():
        series, last = replay.sieve(own, 3, 0.2, getattr(replay, reward))
        assert {i: set(c) for i, c in last.items()} == {i: c for (k, i), c in held.items() if k == s}
        assert best[s] == series[-1][1]
        value, got = 0, []
        for t, _ in series:
            value = changes.get((s, t), value)
            got.append((t, value))
        assert got == series


def test_solvers_give_the_known_values_on_the_first_rows(spark):
    stream = lifetimes.valid(from_events(spark, SF)).where("t <= 400")
    life = spark.read.parquet(f"{SF}/events.parquet").selectExpr("ts", "event_id", "cast(least(30, 1 + floor(value / 4)) AS long) AS l")
    stream = stream.drop("l").join(numbered(life, ["ts", "event_id"]).select("t", "l"), "t").select("t", "u", "v", "l").cache()
    each = lifetimes.alive_on(stream, 1, 400, 1).cache()
    best = {r["snap"]: r["value"] for r in greedy.solution_value(greedy.max_coverage(each, 5)).collect()}
    first = rewards.first_times(each, ["snap"])
    sets, ranges = sieve.sieve(first, each.selectExpr("snap", "v", "t AS n"), 5, 0.2)
    reduced = {r["snap"]: r["value"] for r in sieve.best_set(sets, ranges, first).collect()}
    listed = pruned_list.run_list(stream, 5, 0.2).collect()
    assert (sum(best.values()), sum(reduced.values()), sum(r["value"] for r in listed)) == (2209, 2085, 2072)
    assert [best[t] for t in (50, 100, 200, 300, 400)] == [6, 5, 6, 5, 5]
    assert [reduced[t] for t in (50, 100, 200, 300, 400)] == [5, 5, 6, 5, 5]
    assert {r["t"]: r["value"] for r in listed}[50] == 5 and max(r["n_sieves"] for r in listed) == 8
    assert all(reduced[t] >= (0.5 - 0.2) * best[t] for t in best)


def test_pruned_lists_of_several_keys_are_independent(spark):
    a, b = random_stream(1, 60, 8, 6, 9), random_stream(2, 60, 8, 6, 9)
    both = frame(spark, [("a", *r) for r in a] + [("b", *r) for r in b], f"key string, {STREAM}")
    got = rows(pruned_list.run_list(both, 3, 0.1, ["key"]))
    alone = [(k, *r) for k, s in (("a", a), ("b", b)) for r in rows(pruned_list.run_list(frame(spark, s, STREAM), 3, 0.1))]
    assert got == sorted(alone)
    reach = pruned_list.run_list(frame(spark, a, STREAM), 3, 0.1, reward="reach").collect()
    for r in reach:
        live = [(u, v) for t, u, v, l in a if t <= r["t"] < t + l]
        cover = replay.reach(live)
        assert r["value"] <= len(set().union(*cover.values()))


def test_reach_components_and_affected_nodes(spark):
    edges = [(2, 3), (1, 2), (3, 4), (1, 3), (5, 5), (4, 6), (6, 4)]
    graph = graphs.edges(frame(spark, [(1, *e) for e in edges], "t long, u long, v long"))
    cover = replay.reach(edges)
    pairs = graphs.reach(graph)
    assert rows(pairs, "v", "u") == sorted((v, u) for v, c in cover.items() for u in c)
    scc = graphs.components(graph)
    assert rows(scc) == [(1, 1), (2, 2), (3, 3), (4, 4), (6, 4)]
    assert rows(graphs.condensed(graph, scc)) == [(1, 2), (1, 3), (2, 3), (3, 4)]
    before = graphs.reach(graphs.edges(frame(spark, [(0, *e) for e in edges[:-2]], "t long, u long, v long")))
    assert rows(graphs.affected(before, pairs)) == [(1,), (2,), (3,), (4,), (6,)]


def test_reach_times_are_the_first_steps_at_which_paths_exist(spark):
    data = [(t, u, v) for t, u, v, _ in random_stream(8, 40, 9, 9, 2)]
    got = {(r["v"], r["u"]): r["ft"] for r in graphs.reach_times(frame(spark, data, "t long, u long, v long")).collect()}
    want = {}
    for n in range(1, 41):
        for v, c in replay.reach([(u, v) for t, u, v in data if t <= n]).items():
            for u in c:
                want.setdefault((v, u), n)
    assert got == want


def test_sketches_estimate_exact_influences(spark):
    graph = frame(spark, [(0, 1, 0.4), (1, 2, 0.5), (2, 0, 0.6), (2, 3, 0.7)], "u long, v long, p double")
    held = influence.sketch_nodes(graph, 4000)
    got = {r["x"]: r["influence"] for r in influence.influence(held, nodes=graphs.nodes(graph)).collect()}
    for x, exact in {0: 1.74, 1: 2.15, 2: 2.54, 3: 1.0}.items():
        assert abs(got[x] - exact) < 0.12
    alone = influence.influence(held, frame(spark, [(2,)], "x long"), nodes=graphs.nodes(graph)).first()["influence"]
    assert abs(alone - got[2]) < 1e-9
    weights = influence.sketch_weights(held, graph)
    kept = influence.within_budget(weights, graph, 1.0).collect()
    total = sum(r["weight"] for r in kept)
    assert total >= 16 > total - max(kept, key=lambda r: r["s"])["weight"]
    empty = influence.multiplicities(frame(spark, [(1, 1, 1, 1)], STREAM))
    assert influence.sketch_nodes(empty, 10).count() == 0
    assert [round(r[0], 6) for r in spark.range(4).select(activation(F.col("id"))).collect()] == [0, 0.099668, 0.197375, 0.291313]


def test_sketches_grow_until_their_weights_reach_the_budget(spark):
    graph = frame(spark, [(0, 1, 0.4), (1, 2, 0.5), (2, 0, 0.6), (2, 3, 0.7)], "u long, v long, p double")
    held = influence.enough_sketches(graph, 8.0, start=4)
    weights = {r["s"]: r["weight"] for r in influence.sketch_weights(held, graph).collect()}
    total = sum(weights.values())
    assert sorted(weights) == list(range(len(weights))) and len(weights) > 4
    assert total >= 8 * (4 + 4) * 2 > total - weights[max(weights)]
    assert rows(held) == rows(influence.sketch_nodes(graph, len(weights)))


def test_gains_weighed_are_those_of_a_replay(spark):
    data = [(0, t, u, v) for t, u, v, _ in random_stream(31, 80, 12, 9, 2)]
    df = frame(spark, data, "stream long, t long, u long, v long")
    first, points = rewards.first_times(df, ["stream"]), df.selectExpr("stream", "v", "t AS n")
    sets, ranges = sieve.sieve(first, points, 3, 0.2, ["stream"])
    got = {i: c for _, i, c in rows(sieve.gains_weighed(sets, ranges, points, 3, ["stream"]))}
    held, most, cover, want = {}, 0, {}, {}
    for _, _, u, v in data:
        cover.setdefault(v, set()).add(u)
        most = max(most, len(cover[v]))
        low, high = math.floor(math.log(0.8 * most) / math.log(1.2)), math.ceil(math.log(6 * most) / math.log(1.2))
        held = {i: held.get(i, []) for i in range(low, high + 1)}
        for i, own in held.items():
            if len(own) < 3 and v not in own:
                want[i] = want.get(i, 0) + 1
                if len(cover[v] - set().union(*(cover[x] for x in own))) >= 1.2**i / 6:
                    own.append(v)
    assert got == want


def test_random_sets_are_of_the_nodes_and_repeatable(spark):
    pairs = lifetimes.alive_on(frame(spark, random_stream(4, 100, 20, 15, 10), STREAM), 20, 100, 20)
    one, two = (rows(baselines.random_sets(pairs, 4, 2, 7)) for _ in range(2))
    held = {s: {v for g, v in rows(pairs, "snap", "v") if g == s} for s, _ in rows(pairs, "snap", "v")}
    assert one == two and {(s, k) for s, k, _ in one} == {(s, k) for s in held for k in (1, 2)}
    for s, k in {r[:2] for r in one}:
        own = [v for a, b, v in one if (a, b) == (s, k)]
        assert len(set(own)) == len(own) == min(4, len(held[s])) and set(own) <= held[s]
    assert all(r["calls"] == 4 * r["n_nodes"] for r in baselines.naive_calls(pairs, 4).collect())


def test_runs_over_settings(spark):
    stream = frame(spark, random_stream(12, 120, 10, 8, 9), STREAM)
    both = experiments.run_settings(stream, [(2, 0.2, 5), (4, 0.1, 9)])
    for k, eps, cap in ((2, 0.2, 5), (4, 0.1, 9)):
        alone = pruned_list.run_list(lifetimes.valid(stream, cap), k, eps)
        assert rows(both.where(F.col("k") == k), *alone.columns) == rows(alone)
    values = {(s, n): v for s, n, v in rows(experiments.solver_values(stream, 20, 120, 20, 3, 0.2))}
    assert {s for s, _ in values} == set(range(20, 121, 20))
    for s in range(20, 121, 20):
        assert values[s, "random"] <= values[s, "greedy"] and 0.3 * values[s, "greedy"] <= values[s, "reduction"] and 0.13 * values[s, "greedy"] <= values[s, "pruned"]
