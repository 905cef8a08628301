"""Runs of the solvers over many settings, as one DataFrame each."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import baselines, greedy, lifetimes, pruned_list, rewards, sieve
from .plans import cut


def greedy_by_budget(picks: DataFrame, by: Sequence[str] = ("snap",)) -> DataFrame:
    """(by, budget, value) for every budget up to the picks' k: greedy's sets are nested, so one run serves all budgets."""
    upto = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # k rows at most
    return picks.select(*by, F.col("rank").cast("long").alias("budget"), F.sum("gain").over(upto).alias("value"))


def run_settings(stream: DataFrame, settings: Iterable[tuple[int, float, int]], every: int = 1, reward: str = "coverage", by: Sequence[str] = ()) -> DataFrame:
    """(k, eps, cap, by, t, value, nodes, calls, n_sieves) of the pruned list for each (k, eps, cap): the runs, and the keys of each, are tasks side by side."""
    runs = []
    for k, eps, cap in settings:
        found = pruned_list.run_list(lifetimes.valid(stream, cap), k, eps, by, every=every, reward=reward)
        runs.append(found.select(F.lit(k).alias("k"), F.lit(eps).alias("eps"), F.lit(cap).alias("cap"), *found.columns))
    return reduce(DataFrame.union, runs)


def solver_values(stream: DataFrame, start: int, stop: int, every: int, k: int, eps: float, repeats: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """(by, snap, solver, value): greedy, per-lifetime reduction, pruned list and random sets of each key on the same snapshots.

    The pruned list gives the value of a key's last step up to the snapshot, where that step is alive there yet.
    """
    by = list(by)
    group = [*by, "snap"]
    rows = cut(lifetimes.alive_on(stream, start, stop, every))
    first = rewards.first_times(rows, group)
    sets, ranges = sieve.sieve(first, rows.select(*group, "v", F.col("t").alias("n")), k, eps, group)
    latest = rows.groupBy(*group).agg(F.max("t").alias("t"))
    latest = cut(latest)
    listed = pruned_list.values_at(stream, latest, k, eps, by).join(latest, [*by, "t"])
    found = {
        "greedy": greedy.solution_value(greedy.max_coverage(rows, k, group), group),
        "reduction": sieve.best_set(sets, ranges, first, group),
        "pruned": listed,
        "random": baselines.random_value(rows, k, repeats, by=group),
    }
    return reduce(DataFrame.union, [df.select(*group, F.lit(name).alias("solver"), F.col("value").cast("double").alias("value")) for name, df in found.items()])
