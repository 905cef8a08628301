"""Rewards of nodes and sets, exact or by sketches, over pairs (candidate v, element u).

On a bipartite graph the elements are the users of a venue; on a directed graph they are the nodes that a node reaches (see `graphs.reach`);
with influence sketches they are sketches. All functions take extra key columns `by`, so that many snapshots are one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import running


def node_reward(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, reward): how many distinct elements each candidate covers."""
    return pairs.groupBy(*by, "v").agg(F.countDistinct("u").alias("reward"))


def set_reward(pairs: DataFrame, chosen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, reward): how many distinct elements the nodes of `chosen` (v, or by and v) cover together; unknown nodes cover nothing."""
    keys = [c for c in (*by, "v") if c in chosen.columns]
    return pairs.join(chosen.select(*keys).distinct(), keys, "left_semi").groupBy(*by).agg(F.countDistinct("u").alias("reward"))


def gains(pairs: DataFrame, chosen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, gain) of every candidate over the set `chosen`, in one job: elements that the set does not cover yet. Gains may be 0."""
    keys = [c for c in (*by, "v") if c in chosen.columns]
    covered = pairs.join(chosen.select(*keys).distinct(), keys, "left_semi").select(*by, "u").distinct().withColumn("_covered", F.lit(True))
    return pairs.select(*by, "v", "u").distinct().join(covered, [*by, "u"], "left").groupBy(*by, "v").agg(F.count(F.when(F.col("_covered").isNull(), 1)).alias("gain"))


def node_sketches(pairs: DataFrame, by: Sequence[str] = (), bits: int = 12) -> DataFrame:
    """(by, v, sketch): mergeable distinct-count sketches of 2 ** bits registers."""
    return pairs.groupBy(*by, "v").agg(F.hll_sketch_agg("u", F.lit(bits)).alias("sketch"))


def sketched_reward(sketches: DataFrame, chosen: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Estimated rewards: of each node, or of the set `chosen` by the union of its sketches."""
    if chosen is None:
        return sketches.select(*by, "v", F.hll_sketch_estimate("sketch").alias("reward"))
    held = sketches.join(chosen.select("v").distinct(), "v", "left_semi")
    return held.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("reward"))


def first_times(pairs: DataFrame, by: Sequence[str] = (), step: str = "t") -> DataFrame:
    """(by, v, u, ft): when each candidate first covers each element of a stream that only grows."""
    return pairs.groupBy(*by, "v", "u").agg(F.min(step).alias("ft"))


def reward_so_far(first: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, n, reward): each candidate's reward after each step n at which it grew."""
    grown = first.groupBy(*by, "v", F.col("ft").alias("n")).agg(F.count("*").alias("d"))
    return running(grown, [*by, "v"], "n", "d", "reward").drop("d")


def largest_so_far(first: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, most): the largest reward of one candidate up to each step n at which any grew."""
    per_step = reward_so_far(first, by).groupBy(*by, "n").agg(F.max("reward").alias("r"))
    keyed = per_step if by else per_step.withColumn("_all", F.lit(0))
    return running(keyed, by or ["_all"], "n", "r", "most", "max").select(*by, "n", "most")
