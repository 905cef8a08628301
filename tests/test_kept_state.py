"""State that is kept from batch to batch: sieves and influence sketches."""

import random

import pytest
import replay
from pyspark.sql import functions as F
from support import rows

from tideset.operators import changes, influence, repair
from tideset.streaming import KeptSieve

K, EPS = 3, 0.3


def _taken(spark, at, parts, again=()):
    kept = KeptSieve(spark, str(at), K, EPS)
    for number, part in enumerate(parts):
        batch = spark.createDataFrame([(0, *r) for r in part], "stream int, t long, u long, v long").repartition(3)
        kept.take(batch, number)
        if number in again:
            kept.take(batch, number)
    return kept


def test_a_sieve_in_batches_gives_the_values_and_sets_of_a_replay(spark, tmp_path):
    draw = random.Random(3)
    stream = [(t, draw.randrange(40), draw.randrange(12) ** 2 // 12) for t in range(1, 121)]
    series, sets = replay.sieve(stream, K, EPS)
    value = dict(series)
    parts = [stream[:1], stream[1:50], stream[50:110], stream[110:]]
    kept = _taken(spark, tmp_path / "kept", parts, again=(1,))
    assert rows(kept.table(spark, "best"), "n", "value") == [(p[-1][0], value[p[-1][0]]) for p in parts]
    held = {}
    for r in kept.table(spark, "sets").collect():
        held.setdefault(r.i, set()).add(r.v)
    assert {i: held.get(i, set()) for i in sets} == {i: set(s) for i, s in sets.items()}


def test_a_batch_taken_again_changes_no_table(spark, tmp_path):
    parts = [[(1, 1, 1), (2, 2, 1), (3, 1, 2)], [(4, 3, 2), (5, 4, 2), (6, 5, 1)]]
    kept = _taken(spark, tmp_path / "kept", parts)
    before = {name: rows(kept.table(spark, name)) for name in ("first", "levels", "sets", "best")}
    kept.take(spark.createDataFrame([(0, *r) for r in parts[1]], "stream int, t long, u long, v long"), 1)
    assert {name: rows(kept.table(spark, name)) for name in before} == before
    assert before["best"]


def test_an_empty_batch_tells_nothing(spark, tmp_path):
    kept = _taken(spark, tmp_path / "kept", [[], [(1, 1, 1)], []])
    assert rows(kept.table(spark, "best"), "n", "value") == [(1, 1)]


def _full(graph, targets):
    """A full draw: every sketch searched from its target."""
    held = set()
    for s, x in targets:
        seen, queue = {x}, [x]
        while queue:
            v = queue.pop()
            for a, b, live in graph:
                if b == v and a not in seen and s in live:
                    seen.add(a)
                    queue.append(a)
        held |= {(s, x) for x in seen}
    return sorted(held)


def test_repaired_sketches_are_those_of_a_full_draw(spark):
    draw = random.Random(5)
    stream = [(t, draw.randrange(10), draw.randrange(10), draw.choice([3, 9, 30])) for t in range(1, 61)]
    lives = spark.createDataFrame(stream, "t long, u long, v long, l long")
    edges, vertices = changes.edge_changes(lives).checkpoint(), changes.vertex_changes(lives).checkpoint()
    graph = lambda n: changes.at_step(edges, n, ["u", "v"], ["p"])
    kept, held, at = repair.KeptSketches(graph(20), 40, 10), None, 20
    for to in (21, 30, 58, 95):  # the last step is after all lives: no graph is left
        before = set(rows(kept.held()))
        told = kept.move(graph(to), changes.between(edges, at, to, ["u", "v"], F.col("p")), changes.between(vertices, at, to, ["x"], F.lit(1)))
        told = {(r.s, r.x): r.change for r in told.collect()}
        held = rows(kept.held())
        nodes = {x for t, u, v, life in stream for x in (u, v) if u != v and t <= to < t + life}
        targets = [(r.s, r.x) for r in kept.targets.collect() if r.x is not None]
        assert len(targets) == (40 if nodes else 0) and {x for _, x in targets} <= nodes
        numbered = spark.range(40).withColumnRenamed("id", "s")
        live = numbered.crossJoin(graph(to)).where(influence.coin(F.col("p"), F.col("s"), F.col("u"), F.col("v"))).groupBy("u", "v").agg(F.collect_set("s").alias("s"))
        assert held == _full([(r.u, r.v, set(r.s)) for r in live.collect()], targets)
        assert {k for k, c in told.items() if c == "gained"} == set(held) - before and {k for k, c in told.items() if c == "lost"} == before - set(held)
        fresh = repair.first_draws(numbered.withColumn("j", F.lit(0)), spark.createDataFrame([(x,) for x in nodes], "x long"), 10)
        assert rows(kept.targets, "s", "x") == rows(fresh, "s", "x")
        at = to


def test_nodes_beyond_the_slots_are_refused(spark):
    with pytest.raises(ValueError, match="slots"):
        repair.first_draws(spark.range(1).select(F.col("id").alias("s"), F.lit(0).alias("j")), spark.range(5, 9).withColumnRenamed("id", "x"), 8)
