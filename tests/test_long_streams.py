"""What long streams need: sieves by slices of the stream, batches whose cost is that of what they bring."""

import random

import pandas as pd
import pytest
import replay
from support import rows

from tideset.operators import graphs, pruned_list, rewards, sieve
from tideset.streaming import KeptSieve
from tideset.streaming.lives import _Lives

K, EPS = 3, 0.3


def _stream(seed, n):
    draw = random.Random(seed)
    return [(t, draw.randrange(40), draw.randrange(12) ** 2 // 12) for t in range(1, n + 1)]


@pytest.mark.parametrize(("part", "slices"), [(1, 5), (10, 40), (10, 1000)])
def test_slices_of_any_width_give_the_sets_and_series_of_a_replay(spark, monkeypatch, part, slices):
    monkeypatch.setattr(sieve, "PART", part)
    monkeypatch.setattr(sieve, "SLICES", slices)
    stream = _stream(3, 150)
    series, sets = replay.sieve(stream, K, EPS)
    first = rewards.first_times(spark.createDataFrame([(0, *r) for r in stream], "stream int, t long, u long, v long"), ["stream"])
    points = spark.createDataFrame([(0, v, t) for t, _, v in stream], "stream int, v long, n long")
    found, ranges = sieve.sieve(first, points, K, EPS, ["stream"])
    held = {}
    for r in found.join(ranges.where("until IS NULL"), ["stream", "i"], "left_semi").collect():
        held.setdefault(r.i, set()).add(r.v)
    assert {i: held.get(i, set()) for i in sets} == {i: set(s) for i, s in sets.items()}
    told, value = dict(rows(sieve.value_per_step(found, ranges, first, ["stream"]), "n", "value")), 0
    for t, wanted in series:
        value = told.get(t, value)
        assert value == wanted


def test_a_kept_sieve_by_slices_gives_the_values_of_a_replay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sieve, "PART", 1)
    monkeypatch.setattr(sieve, "SLICES", 6)
    stream = _stream(8, 120)
    value, kept = dict(replay.sieve(stream, K, EPS)[0]), KeptSieve(spark, str(tmp_path / "kept"), K, EPS)
    parts = [stream[:40], stream[40:45], stream[45:]]
    for number, part in enumerate(parts):
        kept.take(spark.createDataFrame([(0, *r) for r in part], "stream int, t long, u long, v long"), number)
    assert rows(kept.table(spark, "best"), "n", "value") == [(p[-1][0], value[p[-1][0]]) for p in parts]


class _Ends:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key], self.calls = value, self.calls + 1

    def removeKey(self, key):
        del self.held[key]
        self.calls += 1


class _Handle:
    def __init__(self):
        self.ends, self.timers = _Ends(), []

    def getMapState(self, name, keys, *values):
        return self.ends

    def registerTimer(self, at):
        self.timers.append(at)


def test_users_that_come_and_go_within_a_batch_never_reach_the_state_store():
    draw = random.Random(4)
    stream = [(t, draw.randrange(30), draw.choice([1, 2, 7, 15])) for t in range(1, 401)]
    lives, told = _Lives(), {}
    handle = _Handle()
    lives.init(handle)
    for part in (stream[:250], stream[250:]):
        for out in lives.handleInputRows((7,), iter([pd.DataFrame(part, columns=["t", "u", "l"])]), None):
            told |= dict(zip(out.n, out.reward))
    alive = lambda n: len({u for t, u, life in stream if t <= n < t + life})
    assert told == {n: alive(n) for n in told} and {t for t, _, _ in stream} <= set(told)
    assert handle.ends.held == {(u,): (max(t + life for t, x, life in stream if x == u),) for u in {x for t, x, life in stream if t + life > 400}}
    assert handle.ends.calls <= 2 * alive(250) + alive(400) and len(handle.timers) <= alive(250) + alive(400)


@pytest.mark.parametrize(("seed", "size"), [(1, 8), (2, 20), (3, 60)])
def test_components_that_grow_tell_whose_reach_does(spark, seed, size):
    draw = random.Random(seed)
    edges = [(1 + at // 12, draw.randrange(size), draw.randrange(size)) for at in range(48)]
    found = rows(graphs.affected_by_batches(spark.createDataFrame(edges, "step long, u long, v long")), "step", "x")
    wanted, before = [], {}
    for step in range(1, 5):
        after = replay.reach([(u, v) for s, u, v in edges if s <= step])
        wanted += [(step, x) for x in sorted(after) if after[x] != before.get(x)]
        before = after
    assert found == wanted


def test_values_at_single_steps_walk_their_periods_only(spark):
    draw = random.Random(9)
    stream = [(draw.choice("ab"), t, draw.randrange(9), draw.randrange(6), draw.choice([1, 1, 2, 9])) for t in range(1, 201)]
    df = spark.createDataFrame(stream, "key string, t long, u long, v long, l long")
    held, period, wanted = {}, {}, []
    for key, t, u, v, life in stream:
        period[key] = period.get(key, 0) + (held.get(key, 0) < t)
        held[key] = max(held.get(key, 0), t + life - 1)
        wanted.append((key, t, period[key]))
    assert max(period.values()) > 3
    assert rows(pruned_list.periods(df, ["key"]), "key", "t", "period") == sorted(wanted)
    steps = df.where("t % 7 = 0")
    full = rows(pruned_list.run_list(df, 3, 0.2, ["key"]).where("t % 7 = 0"), "key", "t", "value")
    assert rows(pruned_list.values_at(df, steps, 3, 0.2, ["key"]), "key", "t", "value") == full
