"""Which rows of a stream (t, u, v, l) are alive when: a row that arrives at step t lives through the steps t, ..., t + l - 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import running


def valid(stream: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows with ids and a lifetime of 1 at least, lifetimes cut to `cap`."""
    rows = stream.where("u IS NOT NULL AND v IS NOT NULL AND t IS NOT NULL AND l >= 1")
    return rows.withColumn("l", F.least(F.col("l"), F.lit(cap)).cast("long")) if cap else rows


def in_batches(stream: DataFrame, size: int, end: int | None = None) -> DataFrame:
    """The stream with `step`, its batch of `size` arrivals; a last batch that is not full is left out, and steps after `end` too."""
    full = stream.agg(F.max("t")).first()[0] or 0
    steps = full // size if end is None else min(full // size, end)
    return stream.withColumn("step", (F.floor((F.col("t") - 1) / size) + 1).cast("long")).where(F.col("step") <= steps)


def alive_at(stream: DataFrame, snap: int) -> DataFrame:
    """The rows alive at one step; the predicate reaches the scan."""
    return stream.where((F.col("t") <= snap) & (F.col("t") + F.col("l") > snap))


def alive_on(stream: DataFrame, start: int, stop: int, every: int) -> DataFrame:
    """`stream` with snap before its columns: each row once for each snapshot start, start + every, ..., stop within its life. An explode, not a range join."""
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - start) / every)).cast("long")
    last = F.least(F.lit(stop), F.col("t") + F.col("l") - 1)
    last = F.floor((last - start) / every).cast("long")
    held = stream.withColumns({"_a": first, "_b": last}).where("_b >= _a")
    return held.select(F.explode(F.transform(F.sequence("_a", "_b"), lambda i: (i * every + start).cast("long"))).alias("snap"), *stream.columns)


def prefixes(stream: DataFrame, start: int, stop: int, every: int) -> DataFrame:
    """(snap, t, u, v, l) as `alive_on`, for a stream that only grows: each row from its arrival on."""
    return alive_on(stream.withColumn("l", F.greatest(F.lit(stop) - F.col("t") + 1, F.lit(0)).cast("long")).where("l > 0"), start, stop, every)


def size_per_step(stream: DataFrame) -> DataFrame:
    """(step, n_alive) for each step with an arrival or the step after a last life: a running sum of arrivals less expiries."""
    deltas = stream.select(F.col("t").alias("step"), F.lit(1).alias("d")).union(stream.select(F.col("t") + F.col("l"), F.lit(-1)))
    summed = deltas.groupBy("step").agg(F.sum("d").alias("d")).withColumn("key", F.lit(0))
    return running(summed, ["key"], "step", "d", "n_alive").select("step", F.col("n_alive").cast("long").alias("n_alive"))

