"""Yardsticks: random sets, and the cost of greedy without lazy evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform
from ..plans import running


def random_sets(pairs: DataFrame, k: int, repeats: int, seed: int = 0, by: Sequence[str] = ("snap",)) -> DataFrame:
    """(by, rep, v): for each snapshot and repeat k candidates drawn by a hash, so that every run draws the same."""
    nodes = pairs.select(*by, "v").distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    draw = uniform(F.lit(seed), *[F.col(c) for c in by], F.col("v"), F.col("rep"))
    order = Window.partitionBy(*by, "rep").orderBy("_draw", "v")
    return nodes.withColumn("_draw", draw).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select(*by, "rep", "v")


def random_value(pairs: DataFrame, k: int, repeats: int, seed: int = 0, by: Sequence[str] = ("snap",)) -> DataFrame:
    """(by, value): the mean reward of the random sets."""
    sets = random_sets(pairs, k, repeats, seed, by)
    rewards = sets.join(pairs.select(*by, "v", "u").distinct(), [*by, "v"]).groupBy(*by, "rep").agg(F.countDistinct("u").alias("reward"))
    return rewards.groupBy(*by).agg(F.avg("reward").alias("value"))


def naive_calls(pairs: DataFrame, k: int) -> DataFrame:
    """(snap, n_nodes, calls, total): gains that greedy weighs without lazy evaluation, n * k, and their running sum."""
    n = pairs.groupBy("snap").agg(F.countDistinct("v").alias("n_nodes")).withColumn("calls", F.col("n_nodes") * k).withColumn("_all", F.lit(0))
    return running(n, ["_all"], "snap", "calls", "total").select("snap", "n_nodes", "calls", "total")
