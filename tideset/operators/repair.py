"""Influence sketches that are kept from step to step and repaired where a change of the graph touches them.

A change of an edge's probability from p to q turns its coin only in sketches that hold its head and whose draw lies between p and q. Where coins turn to live only, a sketch grows from their
tails; where one turns to dead, or the target goes, the sketch is searched anew. All others stay as they are: their rows are scanned for the heads of changed edges, but not joined,
shuffled or written again. Since coins are hashes, a repaired sketch is the one that a full draw on the new graph gives.

Targets are drawn so that few of them move: a sketch draws ids below `slots` until it meets a live node, so each live node is equally likely, a new node takes
the sketches in which it is drawn before their target, and a node that goes leaves its own sketches to later draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coin, uniform
from ..plans import Kept, cut, small


def _draw(slots: int) -> Column:
    return uniform(F.lit("z"), F.col("s"), F.col("j")) % slots


def first_draws(asked: DataFrame, nodes: DataFrame, slots: int) -> DataFrame:
    """(s, j, x): of the draws j of each sketch from `asked` (s, j) on, the first that is one of `nodes` (x). Without nodes j is -1 and x is null."""
    nodes = cut(nodes.select("x").distinct())
    if nodes.isEmpty():
        return asked.select("s", F.lit(-1).cast("long").alias("j"), F.lit(None).cast("long").alias("x"))
    if not nodes.where(~F.col("x").between(0, slots - 1)).isEmpty():
        raise ValueError(f"nodes need ids from 0 to {slots - 1}; number them (plans.numbered) or ask for more slots")
    found, width = None, 32
    left = cut(asked.select("s", F.col("j").cast("long").alias("j")))
    while not left.isEmpty():
        tried = left.select("s", F.explode(F.sequence("j", F.col("j") + (width - 1))).alias("j")).withColumn("x", _draw(slots))
        hit = tried.join(small(nodes), "x").groupBy("s").agg(F.min(F.struct("j", "x")).alias("_b"))
        hit = cut(hit.select("s", "_b.j", "_b.x"))
        found = hit if found is None else found.union(hit)
        left = cut(left.join(hit, "s", "left_anti").withColumn("j", F.col("j") + width))
        width = min(2 * width, 4096)
    return found if found is not None else left.withColumn("x", F.col("j"))


class KeptSketches:
    """Sketches 0, ..., number - 1 of a graph (u, v, p) without self-loops, as tables of rows gained and lost, and their targets."""

    def __init__(self, graph: DataFrame, number: int, slots: int):
        self.slots = slots
        graph = cut(graph.select("u", "v", "p"))
        asked = graph.sparkSession.range(number).select(F.col("id").alias("s"), F.lit(0).alias("j"))
        self.targets = cut(first_draws(asked, _nodes(graph), slots))
        roots = cut(self.targets.where("x IS NOT NULL").select("s", "x"))
        self._rows = Kept(cut(_spread(roots, Kept(roots), graph).withColumn("d", F.lit(1))))

    def held(self, of: DataFrame | None = None) -> DataFrame:
        """(s, x): the nodes of all sketches, or of those of the sketches or nodes `of` (s or x). What is not asked for is filtered before the aggregate."""
        rows = self._rows.table()
        if of is not None:
            rows = rows.join(small(of), of.columns, "left_semi")
        return rows.groupBy("s", "x").agg(F.sum("d").alias("d")).where("d > 0").select("s", "x")

    def move(self, graph: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
        """Go on to `graph` (u, v, p); (s, x, change), the rows gained and lost by it.

        edges: (u, v, before, now), the pairs whose probabilities differ, null where there is no edge; vertices: (x, before, now), those that came or went (`changes.between`).
        """
        graph = cut(graph.select("u", "v", "p"))
        edges = cut(edges.select("u", "v", F.coalesce("before", F.lit(0.0)).alias("p"), F.coalesce("now", F.lit(0.0)).alias("q")).where("p <> q"))
        moved = cut(self._move_targets(graph, vertices))
        heads = cut(edges.select(F.col("v").alias("x")).distinct())
        met = self.held(heads).withColumnRenamed("x", "v").join(edges, "v")
        turned = met.withColumn("_r", uniform(F.col("s"), F.col("u"), F.col("v")) / 4294967296.0)
        turned = cut(turned.where("(_r < p) <> (_r < q)").select("s", "u", F.expr("_r < q").alias("live")))
        again = cut(moved.select("s").union(turned.where("NOT live").select("s")).distinct())
        grown = turned.where("live").join(again, "s", "left_anti")
        touched = cut(again.union(grown.select("s").distinct()))
        old = cut(self.held(touched))
        stay = old.join(again, "s", "left_anti")
        self.targets = cut(self.targets.join(moved, "s", "left_anti").unionByName(moved))
        roots = self.targets.join(again, "s", "left_semi").where("x IS NOT NULL").select("s", "x")
        tails = grown.select("s", F.col("u").alias("x")).distinct().join(old, ["s", "x"], "left_anti")
        start = cut(roots.unionByName(tails))
        new = cut(_spread(start, Kept(cut(stay.unionByName(start))), graph))
        changes = cut(new.join(old, ["s", "x"], "left_anti").withColumn("d", F.lit(1)).unionByName(old.join(new, ["s", "x"], "left_anti").withColumn("d", F.lit(-1))))
        self._rows.add(changes)
        return changes.select("s", "x", F.when(F.col("d") > 0, "gained").otherwise("lost").alias("change"))

    def _move_targets(self, graph: DataFrame, vertices: DataFrame) -> DataFrame:
        """(s, j, x) of the sketches whose target is another one now."""
        vertices = cut(vertices)
        came = cut(vertices.where("before IS NULL AND now IS NOT NULL").select("x"))
        gone = vertices.where("before IS NOT NULL AND now IS NULL").select("x")
        earlier = self.targets.where("j > 0").select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j") - 1)).alias("j")).withColumn("x", _draw(self.slots))
        taken = earlier.join(small(came), "x").groupBy("s").agg(F.min(F.struct("j", "x")).alias("_b"))
        taken = cut(taken.select("s", "_b.j", "_b.x"))
        lost = self.targets.join(gone, "x", "left_semi").select("s", "j").union(self.targets.where("x IS NULL").select("s", "j"))
        lost = cut(lost.join(taken, "s", "left_anti").withColumn("j", F.col("j") + 1))
        return taken if lost.isEmpty() else taken.unionByName(first_draws(lost, _nodes(graph), self.slots))


def _nodes(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("u").alias("x")).union(graph.select("v")).distinct()


def _spread(start: DataFrame, known: Kept, graph: DataFrame) -> DataFrame:
    """The rows (s, x) `known`, which hold `start`, and all from which live coins lead to `start`."""
    fresh = start
    while not fresh.isEmpty():
        back = fresh.withColumnRenamed("x", "v").join(graph, "v").where(coin(F.col("p"), F.col("s"), F.col("u"), F.col("v")))
        fresh = cut(back.select("s", F.col("u").alias("x")).distinct().join(known.table(), ["s", "x"], "left_anti"))
        known.add(fresh)
    return known.table()
