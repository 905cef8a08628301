"""Interaction streams as DataFrames (t, u, v, l): arrival number from 1, user, venue, lifetime in steps.

Text files may be compressed; a malformed row fails the job, since leaving it out would shift the arrival numbers. Files have no order in Spark, so readers of streams number the rows by file and line offset, or by the columns that
the caller names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import numbered


def _text(spark: SparkSession, path: str, schema: str, sep: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("comment", "#").option("mode", "FAILFAST").csv(path)


def read_interactions(spark: SparkSession, path: str, sep: str = "\t", lifetimes: bool = True) -> DataFrame:
    """A stream (t, u, v, l) from rows `u v l`, or `u v` with l = 1. The order is that of the files' names, then of their lines."""
    rows = _text(spark, path, "u long, v long" + ", l long" * lifetimes, sep)
    life = F.col("l") if lifetimes else F.lit(1).cast("long")
    rows = rows.select("u", "v", life.alias("l"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return numbered(rows, ["_file", "_block", "_line"]).select("t", "u", "v", "l")


def read_edges(spark: SparkSession, path: str, sep: str = "\t", distinct: bool = True) -> DataFrame:
    """The distinct edges (u, v) of a static graph, or its list of pairs as it is."""
    edges = _text(spark, path, "u long, v long", sep)
    return edges.distinct() if distinct else edges


def read_weighted(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """The edges (u, v, p) of a graph with probabilities."""
    return _text(spark, path, "u long, v long, p double", sep)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A set of nodes (v), one on each line."""
    return _text(spark, path, "v long", "\t").distinct()


def read_map(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A map (key, value) of ids from rows `value key`."""
    return _text(spark, path, "value long, key long", sep).select("key", "value")


def from_events(spark: SparkSession, sf_dir: str, cap: int = 100) -> DataFrame:
    """The stream of the table `events`: t by time and id, u the user, v the number in props, l from value, at most `cap`."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    venue = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    life = F.least(F.lit(cap), 1 + F.floor("value")).cast("long")
    rows = events.select("ts", "event_id", F.col("user_id").cast("long").alias("u"), venue.alias("v"), life.alias("l"))
    return numbered(rows, ["ts", "event_id"]).select("t", "u", "v", "l")


def from_orders(spark: SparkSession, sf_dir: str, cap: int = 1000) -> DataFrame:
    """A larger stream, of customers and suppliers: one row for each line of an order, in the order of dates and line keys."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_orderdate").cast("timestamp").alias("d"), "l_orderkey", "l_linenumber", F.col("o_custkey").cast("long").alias("u"), F.col("l_suppkey").cast("long").alias("v"), F.least(F.lit(cap), 1 + 20 * F.col("l_quantity").cast("long")).cast("long").alias("l"))
    return numbered(rows, ["d", "l_orderkey", "l_linenumber"]).select("t", "u", "v", "l")


def directed(stream: DataFrame, width: int = 65_536) -> DataFrame:
    """The directed stream (t, u, v, l) that a bipartite one implies: from a venue's previous visitor u to its visitor v; no self-loops.

    A venue's rows are windowed in slices of `width` arrivals; a slice's first row takes the last visitor of the venue's earlier slices.
    """
    cutup = stream.withColumn("slice", F.floor(F.col("t") / width))
    last = cutup.groupBy("v", "slice").agg(F.max_by("u", "t").alias("last"))
    earlier = last.select("v", "slice", F.lag("last").over(Window.partitionBy("v").orderBy("slice")).alias("before"))
    own = F.lag("u").over(Window.partitionBy("v", "slice").orderBy("t"))
    pairs = cutup.withColumn("own", own).join(earlier, ["v", "slice"]).select("t", F.coalesce("own", "before").alias("from"), F.col("u").alias("to"), "l")
    return pairs.where("from IS NOT NULL AND from <> to").select("t", F.col("from").alias("u"), F.col("to").alias("v"), "l")
