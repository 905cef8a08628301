"""Plain replays of the solvers, row by row, to hold the Spark operators against."""

import math


def reached(edges, start):
    seen, queue = {start}, [start]
    while queue:
        x = queue.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                queue.append(b)
    return seen


def coverage(rows):
    cover = {}
    for u, v in rows:
        cover.setdefault(v, set()).add(u)
    return cover


def reach(rows):
    edges = {(u, v) for u, v in rows if u != v}
    return {x: reached(edges, x) for e in edges for x in e}


def greedy(cover, k):
    chosen, covered, gains = [], set(), []
    while len(chosen) < min(k, len(cover)):
        gain, v = max((len(cover[v] - covered), -v) for v in cover if v not in chosen)
        chosen.append(-v)
        gains.append(gain)
        covered |= cover[-v]
    return chosen, gains


def sieve(rows, k, eps, reward=coverage):
    """rows: (t, u, v) in order; the value of the best set after each row, and the last sets kept."""
    sets, most, before, fed, series = {}, 0, {}, [], []
    for t, u, v in rows:
        fed.append((u, v))
        cover = reward(fed)
        affected = {v} if reward is coverage else {x for x in cover if len(cover[x]) > len(before.get(x, ()))}
        before = cover
        most = max([most, *(len(cover[x]) for x in affected)])
        if most:
            low, high = math.floor(math.log((1 - eps) * most) / math.log(1 + eps)), math.ceil(math.log(2 * k * most) / math.log(1 + eps))
            sets = {i: sets.get(i, []) for i in range(low, high + 1)}
        for i, chosen in sets.items():
            for x in sorted(affected):
                covered = set().union(*(cover[y] for y in chosen))
                if x not in chosen and len(chosen) < k and len(cover[x] - covered) >= (1 + eps) ** i / (2 * k):
                    chosen.append(x)
        series.append((t, max([0, *(len(set().union(*(cover[y] for y in s))) for s in sets.values())])))
    return series, sets
