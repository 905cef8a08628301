"""Row numbers and running aggregates that do not gather a stream, or one key's rows, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut

_INSIDE = (1 << 33) - 1  # monotonically_increasing_id holds the partition above 33 bits and the row within it below


def numbered(df: DataFrame, order: Sequence[str], name: str = "t") -> DataFrame:
    """`df` with its rows numbered from 1 in the order of `order`, nulls first.

    The rows are sorted by ranges and kept; a row's number is its place in its partition and how many rows stand in those before. Ties over all of `order` are
    numbered in any order, so end it with a key; then a value that many rows share in the first column is no single task's.
    """
    placed = cut(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_id").bitwiseAND(F.lit(_INSIDE)) + 1
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, number.cast("long")).drop("_part", "_id", "_before")


def running(df: DataFrame, by: Sequence[str], order: str, value: str, name: str, how: str = "sum", width: int = 4096) -> DataFrame:
    """`df` with `name`, the sum or max of `value` over the rows of the same `by` up to this one in `order`, a whole number; peers are included.

    Rows are windowed in slices of `width` of the order, the slices' totals in blocks of `width` slices, and the blocks' totals, `width` ** 2 times
    fewer than a key's steps, by key.
    """
    combine: Column = F.sum if how == "sum" else F.max
    merge = (lambda *x: sum((F.coalesce(c, F.lit(0)) for c in x[1:]), F.coalesce(x[0], F.lit(0)))) if how == "sum" else F.greatest
    earlier = lambda keys, at: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    cutup = df.withColumn("_slice", F.floor(F.col(order) / width))
    totals = cutup.groupBy(*by, "_slice").agg(combine(value).alias("_total")).withColumn("_block", F.floor(F.col("_slice") / width))
    blocks = totals.groupBy(*by, "_block").agg(combine("_total").alias("_total"))
    blocks = blocks.select(*by, "_block", combine("_total").over(earlier(by, "_block")).alias("_first"))
    totals = totals.select(*by, "_block", "_slice", combine("_total").over(earlier([*by, "_block"], "_slice")).alias("_before"))
    totals = totals.join(blocks, [*by, "_block"]).drop("_block")
    upto = Window.partitionBy(*by, "_slice").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    out = cutup.withColumn("_in", combine(value).over(upto)).join(totals, [*by, "_slice"])
    return out.withColumn(name, merge(F.col("_in"), F.col("_before"), F.col("_first"))).drop("_slice", "_in", "_before", "_first")
