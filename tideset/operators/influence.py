"""Influence by reverse-reachable sketches on the live graph of a snapshot.

Pairs (u, v) met x times while alive influence with probability p(x). A sketch has a random target and holds all nodes from which live coins
lead to it; a set's influence is n times the share of sketches that it hits. Coins and targets are hashes, so a change of the graph
changes exactly the sketches whose coins it turns, without any repair of state.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import activation, coin, uniform
from ..plans import cut, numbered, running, small


def multiplicities(alive: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, u, v, x, p): how often each pair is alive, and its probability. Self-loops do not count."""
    return alive.where("u <> v").groupBy(*by, "u", "v").agg(F.count("*").alias("x")).withColumn("p", activation(F.col("x")))


def degrees(alive: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, n_in, n_out) of each node, with multiplicity."""
    pairs = alive.where("u <> v")
    ends = pairs.select(*by, F.col("u").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")).union(pairs.select(*by, "v", F.lit(1), F.lit(0)))
    return ends.groupBy(*by, "x").agg(F.sum("a").alias("n_in"), F.sum("b").alias("n_out"))


def targets(graph: DataFrame, sketches: int, by: Sequence[str] = (), first: int = 0) -> DataFrame:
    """(by, s, x): the target of each sketch first, first + 1, ..., uniform over the nodes in ascending order of id."""
    x = graph.select(*by, F.col("u").alias("x")).union(graph.select(*by, F.col("v"))).distinct()
    placed = numbered(x, [*by, "x"], "_t")
    counts = cut(placed.groupBy(*by).agg(F.count("*").alias("n"), F.min("_t").alias("_first")))
    ranked = placed.join(small(counts.drop("n")), by) if by else placed.withColumn("_first", F.lit(1))
    drawn = counts.drop("_first").where("n > 0").withColumn("s", F.explode(F.sequence(F.lit(first), F.lit(first + sketches - 1))))
    drawn = drawn.withColumn("rank", (uniform(F.lit("z"), F.col("s")) % F.col("n")).cast("long"))
    return drawn.join(ranked.select(*by, "x", (F.col("_t") - F.col("_first")).alias("rank")), [*by, "rank"]).select(*by, F.col("s").cast("long").alias("s"), "x")


def sketch_nodes(graph: DataFrame, sketches: int, by: Sequence[str] = (), first: int = 0) -> DataFrame:
    """(by, s, x): the nodes of each sketch over edges (by, u, v, p). A reverse closure of all sketches at once."""
    by = list(by)
    graph = cut(graph.select(*by, "u", "v", "p"))
    known = fresh = cut(targets(graph, sketches, by, first))
    while True:
        back = fresh.withColumnRenamed("x", "v").join(graph, [*by, "v"]).where(coin(F.col("p"), F.col("s"), F.col("u"), F.col("v")))
        fresh = cut(back.select(*by, "s", F.col("u").alias("x")).distinct().join(known, [*by, "s", "x"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.union(fresh))


def sketch_weights(held: DataFrame, graph: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, s, weight): the sum of 1 + indegree over each sketch's nodes; indegrees count distinct edges."""
    indegree = graph.groupBy(*by, F.col("v").alias("x")).agg(F.count("*").alias("d"))
    return held.join(indegree, [*by, "x"], "left").groupBy(*by, "s").agg(F.sum(1 + F.coalesce("d", F.lit(0))).alias("weight"))


def _budget(graph: DataFrame, beta: float) -> float:
    n = graph.select(F.col("u").alias("x")).union(graph.select("v")).distinct().count()
    return beta * (n + graph.select("u", "v").distinct().count()) * math.log2(n) if n > 1 else 0.0


def within_budget(weights: DataFrame, graph: DataFrame, beta: float) -> DataFrame:
    """(s, weight): the fewest first sketches whose weights reach beta * (n + m) * log2 n, or all if they do not.

    Sketches are summed in slices of their number, so no task sees all of them.
    """
    summed = running(weights.withColumn("_all", F.lit(0)), ["_all"], "s", "weight", "total")
    return summed.where(F.col("total") - F.col("weight") < _budget(graph, beta)).select("s", "weight")


def enough_sketches(graph: DataFrame, beta: float, start: int = 256) -> DataFrame:
    """(s, x) of the fewest first sketches whose weights reach the budget of `within_budget`: their number doubles until they do."""
    graph = cut(graph)
    budget, held, n = _budget(graph, beta), None, 0
    while True:
        more = sketch_nodes(graph, n or start, first=n)
        held, n = more if held is None else cut(held.union(more)), 2 * n or start
        weights = cut(sketch_weights(held, graph))
        if (weights.agg(F.sum("weight")).first()[0] or budget) >= budget:
            return held.join(within_budget(weights, graph, beta).select("s"), "s", "left_semi")


def influence(held: DataFrame, chosen: DataFrame | None = None, by: Sequence[str] = (), nodes: DataFrame | None = None) -> DataFrame:
    """n times the share of sketches hit: (by, x, influence) of each node in a sketch, or (by, influence) of the set `chosen` (x).

    `nodes` (by, x) gives n; without it n counts the nodes in sketches.
    """
    by = list(by)
    size = (nodes if nodes is not None else held.select(*by, "x")).distinct().groupBy(*by).agg(F.count("*").alias("n"))
    total = held.groupBy(*by).agg(F.countDistinct("s").alias("r"))
    hits = held.groupBy(*by, "x").agg(F.countDistinct("s").alias("h")) if chosen is None else held.join(chosen.select("x").distinct(), "x", "left_semi").groupBy(*by).agg(F.countDistinct("s").alias("h"))
    keys = [*by, "x"] if chosen is None else by
    if by:
        both = hits.join(size, by).join(total, by)
    else:
        both = hits.withColumn("_all", F.lit(0)).join(F.broadcast(size.withColumn("_all", F.lit(0))), "_all").join(F.broadcast(total.withColumn("_all", F.lit(0))), "_all")  # one row each
    return both.select(*keys, (F.col("n") * F.col("h") / F.col("r")).alias("influence"))


def renamed(nodes: DataFrame, names: DataFrame, node_col: str = "x") -> DataFrame:
    """The nodes under the ids that a map (key, value) gives them; nodes without one are left out."""
    names = cut(names)
    return nodes.join(small(names.withColumnRenamed("key", node_col)), node_col).drop(node_col).withColumnRenamed("value", node_col)
