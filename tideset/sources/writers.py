"""Writers of result series, node sets and snapshots, as tab-separated text or as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_series(series: DataFrame, path: str, value_col: str = "value", settings: dict | None = None, text: bool = True) -> None:
    """A result series, its value with two decimals. `settings` (k, eps, ...) become partition folders, so that runs stay side by side."""
    out = series.withColumns({k: F.lit(v) for k, v in (settings or {}).items()})
    if text:
        out = out.withColumn(value_col, F.format_string("%.2f", F.col(value_col).cast("double")))
    writer = out.write.mode("append").partitionBy(*(settings or {}))
    writer.option("sep", "\t").option("header", True).csv(path) if text else writer.parquet(path)


def write_nodes(solution: DataFrame, path: str, node_col: str = "v") -> None:
    """A solution's nodes, one on each line; an array column is exploded."""
    kind = dict(solution.dtypes)[node_col]
    nodes = solution.select(F.explode(node_col).alias(node_col)) if kind.startswith("array") else solution.select(node_col)
    nodes.write.mode("overwrite").csv(path)


def write_snapshot(alive: DataFrame, path: str, distinct: bool = False) -> None:
    """The live edges of a snapshot, with repeats, or the distinct edges of its graph."""
    edges = alive.select("u", "v")
    (edges.distinct() if distinct else edges).write.mode("overwrite").option("sep", "\t").csv(path)
