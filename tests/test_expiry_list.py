"""The list of sieves that Spark takes on batch by batch."""

import math
import random

from support import rows

from tideset.operators.expiry_list import ExpiryList, pruned
from tideset.operators.pruned_list import PrunedList

K, EPS = 2, 0.25


def _sieve(fed):
    """The best value and set, and the gains weighed from each step on, of rows (n, u, v)."""
    cover, sets, most, weighed = {}, {}, 0, {}
    for n in sorted({r[0] for r in fed}):
        new = [r for r in fed if r[0] == n]
        for _, u, v in new:
            cover.setdefault(v, set()).add(u)
        most = max([most, *(len(cover[v]) for _, _, v in new)])
        low, high = math.floor(math.log((1 - EPS) * most) / math.log(1 + EPS)), math.ceil(math.log(2 * K * most) / math.log(1 + EPS))
        sets = {i: sets.get(i, []) for i in range(low, high + 1)}
        for i, chosen in sets.items():
            for v in sorted({r[2] for r in new}):
                covered = set().union(*(cover[x] for x in chosen))
                if v not in chosen and len(chosen) < K and len(cover[v] - covered) >= (1 + EPS) ** i / (2 * K):
                    chosen.append(v)
    value = {i: len(set().union(*(cover[x] for x in s))) for i, s in sets.items()}
    best = min(value, key=lambda i: (-value[i], i))
    return value[best], best, sorted(sets[best])


def _replay(parts, width):
    """The told rows: each sieve is searched anew over the rows that it has been fed."""
    fed, live, told = {}, [], []
    for part in parts:
        begin, now = part[0][0], part[-1][0]
        stay = {x: f for x, f in fed.items() if x >= now}
        rows = [(t, u, v, t + life - 1) for t, u, v, life in part if t + life - 1 >= now]
        live = [r for r in live if r[3] >= now]
        fed = {x: list(f) for x, f in stay.items()}
        for x in {max(now, r[3] // width * width) for r in rows} - set(stay):
            end = min((y for y in stay if y > x), default=math.inf)
            fed[x] = list(stay.get(end, [])) + [(begin, u, v) for _, u, v, last in live if x <= last < end]
        for x in fed:
            fed[x] += [(t, u, v) for t, u, v, last in rows if last >= x]
        live += rows
        found = {x: _sieve(fed[x]) for x in fed}
        kept = [x for x, _ in pruned([(x, found[x][0]) for x in sorted(fed)], EPS)]
        fed = {x: fed[x] for x in kept}
        told.append((now, *found[kept[0]], len(kept)))
    return told


def _taken(spark, at, parts, width=1, again=()):
    kept = ExpiryList(spark, str(at), K, EPS, width)
    for number, part in enumerate(parts):
        batch = spark.createDataFrame(part, "t long, u long, v long, l long")
        for _ in range(2 if number in again else 1):
            kept.take(batch, number)
    return kept.told(spark)


def test_batches_give_the_values_sets_and_length_of_a_replay(spark, tmp_path):
    draw = random.Random(11)
    stream = [(t, draw.randrange(30), draw.randrange(9) ** 2 // 9, draw.choice([1, 5, 20, 45])) for t in range(1, 61)]
    parts = [stream[:10], stream[10:30], stream[30:32], stream[32:]]
    told = _taken(spark, tmp_path / "list", parts, width=4, again=(1,))
    wanted = [(n, value, i, tuple(nodes), length) for n, value, i, nodes, length in _replay(parts, 4)]
    assert rows(told, "n", "value", "i", "nodes", "n_sieves") == wanted
    assert all(r.calls > 0 for r in told.collect())


def test_rows_one_by_one_and_a_batch_without_rows(spark, tmp_path):
    stream = [(1, 1, 1, 3), (2, 2, 1, 1), (3, 3, 2, 4)]
    told = _taken(spark, tmp_path / "list", [stream[:1], [], stream[1:2], stream[2:]])
    one = PrunedList(K, EPS)
    assert rows(told, "n", "value") == [(t, one.step(t, u, v, life)[0]) for t, u, v, life in stream]


def test_what_is_pruned_lies_between_two_of_nearly_equal_value():
    assert pruned([(1, 10), (2, 9), (3, 8), (4, 7), (5, 2), (6, 2)], 0.2) == [(1, 10), (3, 8), (4, 7), (5, 2), (6, 2)]
    assert pruned([(1, 10), (2, 10), (3, 10)], 0.2) == [(1, 10), (3, 10)]
    assert pruned([], 0.2) == []
    assert pruned([(1, 0), (2, 0)], 0.2) == [(1, 0), (2, 0)]
