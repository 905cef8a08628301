"""What changes in the graph of a stream (t, u, v, l) from step to step, at every step: a row's life begins at t and ends before t + l.

Each life is two events, +1 and -1, and what is alive is their running sum, so a feed of changes is one aggregate and running sums in slices; no snapshot is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import activation
from ..plans import running


def _alive(lives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, before, x): how many of a key's lives there are before and after each step n that changes their number."""
    keys = list(keys)
    events = lives.select(*keys, F.col("t").alias("n"), F.lit(1).alias("d")).union(lives.select(*keys, F.col("t") + F.col("l"), F.lit(-1)))
    steps = events.groupBy(*keys, "n").agg(F.sum("d").alias("d")).where("d <> 0")
    return running(steps, keys, "n", "d", "x").select(*keys, "n", (F.col("x") - F.col("d")).cast("long").alias("before"), F.col("x").cast("long").alias("x"))


def _kind() -> Column:
    return F.when(F.col("before") == 0, "insert").when(F.col("x") == 0, "erase").otherwise("change")


def edge_changes(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, u, v, x, p, change): the pairs whose number of lives x changes at step n, with their new probability p (0 when erased).

    change: insert, change or erase. A step at which as many lives of a pair begin as end changes nothing. Self-loops do not count.
    """
    told = _alive(stream.where("u <> v"), [*by, "u", "v"])
    return told.select(*by, "n", "u", "v", "x", activation(F.col("x")).alias("p"), _kind().alias("change"))


def vertex_changes(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, x, change): the vertices that get their first edge at step n (insert) or are left without any (erase)."""
    pairs = stream.where("u <> v")
    ends = pairs.select(*by, F.col("u").alias("node"), "t", "l").union(pairs.select(*by, "v", "t", "l"))
    told = _alive(ends, [*by, "node"]).withColumn("change", _kind()).where("change <> 'change'")
    return told.select(*by, "n", F.col("node").alias("x"), "change")


def at_step(feed: DataFrame, step: int, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, columns) as a feed left them at a step, without what is erased: each key's last row up to it."""
    last = feed.where(F.col("n") <= step).groupBy(*keys).agg(F.max_by(F.struct("change", *columns), "n").alias("_last"))
    return last.where("_last.change <> 'erase'").select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def between(feed: DataFrame, after: int, upto: int, keys: Sequence[str], column: Column) -> DataFrame:
    """(keys, before, now): `column` of the keys that a feed tells of in the steps after < n <= upto, as it was at `after` and is at `upto`; null where a key is not there."""
    asked = feed.where((F.col("n") > after) & (F.col("n") <= upto)).select(*keys).distinct()
    told = feed.where(F.col("n") <= upto).join(asked, list(keys), "left_semi").select(*keys, "n", F.when(F.col("change") != "erase", column).alias("_x"))
    early = F.col("n") <= after
    last = told.groupBy(*keys).agg(F.max_by(F.struct("_x"), F.when(early, F.col("n"))).alias("_b"), F.max_by(F.struct("_x"), "n").alias("_a"))
    return last.select(*keys, F.col("_b._x").alias("before"), F.col("_a._x").alias("now"))
