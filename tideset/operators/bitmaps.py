"""Coverage by bitmaps: the elements of a candidate as bits, in place of a row each; exact, and mergeable by or.

Elements (whole numbers) are dealt to buckets of 32,768 bits, so a candidate has a bitmap of 4 KB for each bucket that it has elements in: less than rows
where it covers more than some hundred of a bucket's numbers. Rewards and gains are counts of bits; no join is on elements.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut


def bitmaps(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, bucket, bits) of pairs (by, v, u); repeated pairs set their bit once."""
    placed = pairs.select(*by, "v", F.bitmap_bucket_number("u").alias("bucket"), F.bitmap_bit_position("u").alias("_at"))
    return placed.groupBy(*by, "v", "bucket").agg(F.bitmap_construct_agg("_at").alias("bits"))


def union(maps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, bucket, bits): what the candidates of `maps` cover together."""
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def node_reward(maps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, reward)"""
    return maps.groupBy(*by, "v").agg(F.sum(F.bitmap_count("bits")).alias("reward"))


def set_reward(maps: DataFrame, chosen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, reward) of the nodes of `chosen` (v, or by and v) together."""
    keys = [c for c in (*by, "v") if c in chosen.columns]
    held = union(maps.join(chosen.select(*keys).distinct(), keys, "left_semi"), by)
    return held.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("reward"))


def gains(maps: DataFrame, covered: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, gain) of every candidate over what is covered (by, bucket, bits), of one row for each bucket: the bits that an or adds. Gains may be 0."""
    by = list(by)
    met = maps.join(covered.withColumnRenamed("bits", "_set"), [*by, "bucket"], "left")
    either = F.explode(F.array("bits", F.coalesce("_set", "bits")))
    merged = met.select(*by, "v", "bucket", F.coalesce(F.bitmap_count("_set"), F.lit(0)).alias("_held"), either.alias("bits")).groupBy(*by, "v", "bucket", "_held").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by, "v").agg(F.sum(F.bitmap_count("bits") - F.col("_held")).alias("gain"))


def max_coverage(pairs: DataFrame, k: int, by: Sequence[str] = ("snap",)) -> DataFrame:
    """(by, rank, v, gain): the picks of `greedy.max_coverage`, over bitmaps. A round reads the bitmaps once and keeps a pick and the set's bitmap for each group."""
    by = list(by)
    maps = cut(bitmaps(pairs, by))
    picks: list[DataFrame] = []
    covered = None
    for rank in range(1, k + 1):
        if covered is None:
            weighed = node_reward(maps, by).withColumnRenamed("reward", "gain")
        else:
            weighed = gains(maps.join(reduce(DataFrame.union, picks).select(*by, "v"), [*by, "v"], "left_anti"), covered, by)
        best = weighed.groupBy(*by).agg(F.min(F.struct((-F.col("gain")).alias("g"), "v")).alias("b"))
        best = cut(best.select(*by, F.lit(rank).alias("rank"), F.col("b.v").alias("v"), (-F.col("b.g")).alias("gain")))
        picks.append(best)
        own = maps.join(best.select(*by, "v"), [*by, "v"], "left_semi").select(*by, "bucket", "bits")
        covered = cut(union(own if covered is None else own.union(covered), by))
    return reduce(DataFrame.union, picks)
