"""A pruned list of sieves: one pass over an expiring stream, with a state that does not grow with the stream.

The list holds sieves by the step at which they expire. A row goes to all sieves that expire no later than it does; a new sieve starts as a copy of its
successor where the values of neighbours differ by more than a share of eps, and sieves between two of nearly equal value go. The head of the list gives
the value and the set of a step.

A list depends on each step before, so streams are dealt by keys (`by`: a source, a region, a group of venues): a key's list is one task's, which reads
the key's rows as a stream and holds the state only, the live rows and the sieves. Keys run side by side. `streaming.run_stream` takes the same
steps on micro-batches.
"""

from __future__ import annotations

import copy
import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut, running


class Coverage:
    """Venues and their distinct users."""

    def __init__(self):
        self.cover: dict[int, set[int]] = {}

    def feed(self, u: int, v: int) -> set[int]:
        """Add a row; the candidates to look at."""
        self.cover.setdefault(v, set()).add(u)
        return {v}


class Reach:
    """Nodes and those they reach in a directed graph that only grows."""

    def __init__(self):
        self.cover: dict[int, set[int]] = {}
        self.back: dict[int, set[int]] = {}

    def feed(self, u: int, v: int) -> set[int]:
        if u == v:
            return set()
        fresh = {x for x in (u, v) if x not in self.cover}
        for x in fresh:
            self.cover[x], self.back[x] = {x}, set()
        if v not in self.cover[u]:
            # whoever reaches u now reaches all that v reaches
            gained = self.cover[v]
            queue, seen = [u], {u}
            while queue:
                x = queue.pop()
                if gained <= self.cover[x]:
                    continue
                self.cover[x] = self.cover[x] | gained
                fresh.add(x)
                queue += [y for y in self.back[x] if y not in seen]
                seen |= self.back[x]
        self.back[v].add(u)
        return fresh


REWARDS = {"coverage": Coverage, "reach": Reach}


class Sieve:
    """The sets of one addition-only stream; `expire` is the last step at which the sieve counts."""

    def __init__(self, reward: str, k: int, eps: float, expire: int):
        self.graph, self.k, self.eps, self.expire = REWARDS[reward](), k, eps, expire
        self.most, self.value, self.calls = 0, 0, 0
        self.nodes: tuple[int, ...] = ()
        self.sets: dict[int, list[int]] = {}

    def update(self, affected: set[int]) -> None:
        cover, k = self.graph.cover, self.k
        most = max([self.most, *(len(cover[v]) for v in affected)])
        if most > self.most:
            self.most, step = most, math.log(1 + self.eps)
            low, high = math.floor(math.log((1 - self.eps) * most) / step), math.ceil(math.log(2 * k * most) / step)
            self.sets = {i: self.sets.get(i, []) for i in range(low, high + 1)}
        self.value, self.nodes = 0, ()
        for i, chosen in self.sets.items():
            covered = set().union(*(cover[v] for v in chosen))
            asked = (1 + self.eps) ** i / (2 * k)
            for v in sorted(affected) if len(chosen) < k else ():
                if v in chosen:
                    continue
                self.calls += 1
                if len(cover[v] - covered) >= asked:
                    chosen.append(v)
                    covered |= cover[v]
                    if len(chosen) == k:
                        break
            if len(covered) > self.value:
                self.value, self.nodes = len(covered), tuple(chosen)

    def fork(self, expire: int) -> Sieve:
        other = copy.deepcopy(self)
        other.expire, other.calls = expire, 0
        return other


class PrunedList:
    """The state of one key."""

    def __init__(self, k: int, eps: float, reward: str = "coverage"):
        self.k, self.eps, self.reward = k, eps, reward
        self.sieves: list[Sieve] = []
        self.rows: list[tuple[int, int, int]] = []  # (expire, u, v) of rows that outlive their step, by expire
        self.calls = 0

    def step(self, t: int, u: int, v: int, life: int) -> tuple[int, tuple[int, ...], int, int]:
        """Take the row of step t; the value, the nodes, the gains weighed so far and the length of the list."""
        last = t + life - 1
        sieves = self.sieves
        self._expire(t - 1)  # steps of other keys' rows may lie between
        if not sieves or sieves[-1].expire < last:
            sieves.append(Sieve(self.reward, self.k, self.eps, last))
        before = sum(s.calls for s in sieves)  # a fork counts from 0
        at = 0
        while at < len(sieves) and sieves[at].expire <= last:
            sieves[at].update(sieves[at].graph.feed(u, v))
            at += 1
        if at < len(sieves) and not (at and sieves[at - 1].expire == last) and (not at or sieves[at].value < sieves[at - 1].value * (1 - self.eps)):
            fresh = sieves[at].fork(last)
            affected = fresh.graph.feed(u, v)
            for _, a, b in self.rows[bisect_left(self.rows, (last,)) : bisect_left(self.rows, (sieves[at].expire,))]:
                affected |= fresh.graph.feed(a, b)
            fresh.update(affected)
            sieves.insert(at, fresh)
        self.calls += sum(s.calls for s in sieves) - before
        self._prune()
        if life > 1:
            insort(self.rows, (last, u, v))
        result = sieves[0].value, sieves[0].nodes, self.calls, len(sieves)
        self._expire(t)
        return result

    def _expire(self, t: int) -> None:
        while self.sieves and self.sieves[0].expire <= t:
            self.sieves.pop(0)
        del self.rows[: bisect_left(self.rows, (t + 1,))]

    def _prune(self) -> None:
        at = 0
        while at < len(self.sieves):
            far = at
            while far + 1 < len(self.sieves) and self.sieves[far + 1].value >= (1 - self.eps) * self.sieves[at].value:
                far += 1
            del self.sieves[at + 1 : far]  # the one at `far` moves next to its start and is the next start
            at += 1


SCHEMA = "t long, value long, nodes array<long>, calls long, n_sieves int"


def run_list(stream: DataFrame, k: int, eps: float, by: Sequence[str] = (), reward: str = "coverage", every: int = 1) -> DataFrame:
    """(by, t, value, nodes, calls, n_sieves) after every `every`-th step of each key's stream (t, u, v, l).

    Rows are dealt by key and sorted within their task; a task walks its rows in batches of bounded size.
    """
    by = list(by)
    keyed = stream.select(*by, "t", "u", "v", "l")
    placed = keyed.repartition(*by).sortWithinPartitions(*by, "t") if by else keyed.repartition(1).sortWithinPartitions("t")
    kinds = {c: t for c, t in keyed.dtypes}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, PrunedList(k, eps, reward)
        for batch in batches:
            out = []
            for *own, t, u, v, life in batch.itertuples(index=False):
                if own != key:
                    key, state = own, PrunedList(k, eps, reward)
                value, nodes, calls, n = state.step(t, u, v, life)
                if t % every == 0:
                    out.append((*own, t, value, list(nodes), calls, n))
            if out:
                yield pd.DataFrame(out, columns=[*by, "t", "value", "nodes", "calls", "n_sieves"])

    return placed.mapInPandas(walk, ", ".join([*(f"{c} {kinds[c]}" for c in by), SCHEMA]))


def periods(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The stream with `period`: it grows at each row of a key that comes when no earlier row of it is alive. No sieve outlives a period, so each begins with an empty list."""
    by = list(by)
    keyed = stream.withColumns({"_all": F.lit(0), "_last": F.col("t") + F.col("l") - 1})
    ends = keyed.groupBy("_all", *by, "t").agg(F.max("_last").alias("_last"))
    gone = running(ends.select("_all", *by, (F.col("t") + 1).alias("t"), "_last", F.lit(0).alias("_row")).unionByName(ends.select("_all", *by, "t", F.lit(None).cast("long").alias("_last"), F.lit(1).alias("_row"))), ["_all", *by], "t", "_last", "_held", "max")
    begun = cut(gone.where("_row = 1").select("_all", *by, "t", F.when(F.coalesce(F.col("_held") >= F.col("t"), F.lit(False)), 0).otherwise(1).alias("_new")))
    return keyed.join(running(begun, ["_all", *by], "t", "_new", "period").drop("_new"), ["_all", *by, "t"]).drop("_all", "_last")


def values_at(stream: DataFrame, steps: DataFrame, k: int, eps: float, by: Sequence[str] = (), reward: str = "coverage") -> DataFrame:
    """(by, t, value) of `run_list` at `steps` (by, t). Only periods (see `periods`) that hold such a step can tell its value, so only these are walked, side by side."""
    by = list(by)
    placed = cut(periods(stream, by))
    asked = placed.join(steps.select(*by, "t").distinct(), [*by, "t"], "left_semi").groupBy(*by, "period").agg(F.max("t").alias("_end"))
    held = placed.join(asked, [*by, "period"]).where("t <= _end")
    return run_list(held, k, eps, [*by, "period"], reward).select(*by, "t", "value").join(steps.select(*by, "t").distinct(), [*by, "t"], "left_semi")
