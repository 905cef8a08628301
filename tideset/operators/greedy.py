"""Greedy maximum coverage with lazy evaluation, for any number of groups at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import BROADCAST, cut


def _first(order: Column, *columns: str) -> Column:
    """The columns of the row with the least `order`, as a struct; ties go to the smallest v."""
    return F.min(F.struct(order.alias("_order"), *columns)).alias("_first")


def _sized(most: int) -> Callable[[DataFrame], DataFrame]:
    """A broadcast hint for tables of at most `most` bytes, if that is little."""
    return F.broadcast if most <= BROADCAST else lambda df: df


def max_coverage(pairs: DataFrame, k: int, by: Sequence[str] = ("snap",)) -> DataFrame:
    """(by, rank, v, gain, calls): for each group the k candidates that greedy takes from pairs (by, v, u).

    A round takes each group's candidate with the largest gain, of equal ones the smallest id. Gains only fall, so a gain weighed in an earlier round is a bound:
    a round weighs the candidate of the largest bound, then those whose bound lies above that gain (or equals it, at a smaller id), and no others, since they
    cannot win. The pairs are kept once; a round reads those of the candidates that it weighs, less what the picks cover. calls is how many gains the round
    weighs. Where all is covered, the smallest remaining ids fill the ranks at a gain of 0, a call each; a group with fewer than k candidates gives them all.
    """
    by = list(by)
    key = [*by, "v"]
    pairs = cut(pairs.select(*key, "u").distinct())
    bounds = cut(pairs.groupBy(*key).agg(F.count("*").alias("bound")).withColumn("asked", F.lit(True)))
    # what rounds join has a row for each group, candidate or element at most, so its size is known once for all rounds
    width = 32 * (len(by) + 4)
    each = _sized(bounds.select(*by).distinct().count() * width * k)
    all_of = _sized(bounds.count() * width)
    seen = _sized(pairs.select(*by, "u").distinct().count() * width)

    def uncovered(of: DataFrame, covered: DataFrame) -> DataFrame:
        """(key, _gain) of candidates with gains above 0."""
        return pairs.join(of, key, "left_semi").join(seen(covered), [*by, "u"], "left_anti").groupBy(*key).agg(F.count("*").alias("_gain"))

    picks = []
    for rank in range(1, k + 1):
        if rank > 1:
            left = bounds.join(each(picks[-1].select(*key)), key, "left_anti").select(*key, "bound")
            covered = pairs.join(each(reduce(DataFrame.union, picks).select(*key)), key, "left_semi").select(*by, "u").distinct()
            top = left.groupBy(*by).agg(_first(-F.col("bound"), "v")).select(*by, F.col("_first.v").alias("v"))
            weighed = top.join(each(uncovered(each(top), covered)), key, "left").select(*by, F.col("v").alias("_top"), F.coalesce("_gain", F.lit(0)).alias("_least"))
            rival = (F.col("v") == F.col("_top")) | (F.col("bound") > F.col("_least")) | ((F.col("bound") == F.col("_least")) & (F.col("v") < F.col("_top")))
            asked = left.join(each(weighed), by).select(*key, "bound", rival.alias("asked"))
            again = asked.join(all_of(uncovered(all_of(asked.where("asked").select(*key)), covered)), key, "left")
            bounds = cut(again.select(*key, F.when(F.col("asked"), F.coalesce("_gain", F.lit(0))).otherwise(F.col("bound")).alias("bound"), "asked"))
        best = bounds.where("asked").groupBy(*by).agg(_first(-F.col("bound"), "v"), F.count("*").alias("calls"))
        best = cut(best.select(*by, F.lit(rank).alias("rank"), F.col("_first.v").alias("v"), (-F.col("_first._order")).alias("gain"), "calls"))
        picks.append(best)
        if rank % 4 == 0 and rank < k and not best.agg(F.max("gain")).first()[0]:  # nothing is left to cover, or no candidate
            break
    taken = reduce(DataFrame.union, picks)
    if len(picks) == k:
        return taken
    return taken.union(_fill(bounds.select(*key), cut(taken), k, by, each))


def _fill(candidates: DataFrame, taken: DataFrame, k: int, by: list[str], each) -> DataFrame:
    """The smallest ids that are not taken, up to rank k, in groups with fewer picks: the k smallest of parts of a group, then of the group."""
    counts = taken.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") < k)
    spare = candidates.join(taken, [*by, "v"], "left_anti").join(each(counts), by)
    parts = Window.partitionBy(*by, F.pmod(F.xxhash64("v"), F.lit(64))).orderBy("v")
    least = spare.withColumn("_r", F.row_number().over(parts)).where(F.col("_r") + F.col("_n") <= k)
    ranked = least.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("v")) + F.col("_n")).where(F.col("_r") <= k)
    return ranked.select(*by, F.col("_r").cast("int").alias("rank"), "v", F.lit(0).cast("long").alias("gain"), F.lit(1).cast("long").alias("calls"))


def solution_value(picks: DataFrame, by: Sequence[str] = ("snap",)) -> DataFrame:
    """(by, value, nodes, calls) of `max_coverage`'s picks: the sum of gains, the nodes in the order taken, the gains weighed."""
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda x: x.v)  # k at most
    return picks.groupBy(*by).agg(F.sum("gain").alias("value"), nodes.alias("nodes"), F.sum("calls").alias("calls"))
