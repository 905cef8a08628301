"""Directed graphs of interactions: reachability, strongly connected components and their levels, reach that grows by batches, all but the last with extra keys `by`.

Closures are semi-naive loops: each round extends only the pairs that are new, and an anti-join drops those known. Deltas are kept in the shared checkpoint
folder, a few times each at most (`plans.Kept`). Components need no closure: labels of a node's size go round, not pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import Kept, cut, small


def _kept(df: DataFrame) -> DataFrame:
    """`df`, kept in at most as many parts as shuffles have. Kept tables and their unions hand their parts on from join to join, so that these add up in loops."""
    return cut(df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def edges(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The distinct edges (by, u, v) without self-loops."""
    return stream.where("u <> v").select(*by, "u", "v").distinct()


def nodes(graph: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ends (by, x) of edges; a node with self-loops only is none."""
    return graph.select(*by, F.col("u").alias("x")).union(graph.select(*by, F.col("v"))).distinct()


def reach(graph: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The pairs (by, v, u): candidate v reaches node u, itself included. Columns are named as for `rewards`."""
    by = list(by)
    steps = cut(graph.select(*by, F.col("u").alias("mid"), F.col("v").alias("next")))
    fresh = cut(nodes(graph, by).select(*by, F.col("x").alias("v"), F.col("x").alias("u")))
    known = Kept(fresh)
    while True:
        further = fresh.withColumnRenamed("u", "mid").join(steps, [*by, "mid"]).select(*by, "v", F.col("next").alias("u")).distinct()
        fresh = cut(further.join(known.table(), [*by, "v", "u"], "left_anti"))
        if fresh.isEmpty():
            return known.table()
        known.add(fresh)


def reach_times(stream: DataFrame, by: Sequence[str] = (), step: str = "t") -> DataFrame:
    """(by, v, u, ft): when v first reaches u in a stream that only grows; a node reaches itself from its first edge on.

    That is the least, over paths, of the latest first arrival of an edge: a closure that keeps the least time of each pair and goes on
    with the pairs whose time has fallen.
    """
    by = list(by)
    timed = cut(stream.where("u <> v").groupBy(*by, "u", "v").agg(F.min(step).alias("at")))
    steps = timed.select(*by, F.col("u").alias("mid"), F.col("v").alias("next"), "at")
    own = timed.select(*by, F.col("u").alias("v"), "at").union(timed.select(*by, "v", "at")).groupBy(*by, "v").agg(F.min("at").alias("ft")).select(*by, "v", F.col("v").alias("u"), "ft")
    fresh = cut(own)
    known = Kept(fresh)
    while True:
        held = known.table().groupBy(*by, "v", "u").agg(F.min("ft").alias("ft"))
        further = fresh.withColumnRenamed("u", "mid").join(steps, [*by, "mid"]).groupBy(*by, "v", F.col("next").alias("u")).agg(F.min(F.greatest("ft", "at")).alias("new"))
        fresh = cut(further.join(held, [*by, "v", "u"], "left").where("ft IS NULL OR new < ft").select(*by, "v", "u", F.col("new").alias("ft")))
        if fresh.isEmpty():
            return held
        known.add(fresh)


def components(graph: DataFrame, by: Sequence[str] = (), trims: int = 3) -> DataFrame:
    """(by, x, scc): each node's strongly connected component, named by its smallest node, of edges (by, u, v).

    Rounds over what is left of the graph. Nodes without edges in or out are trimmed, `trims` times. Then the smallest id that reaches a node becomes its colour,
    which goes along edges as long as a colour falls; a colour's own node and all that reach it within the colour are a component. Other components
    lie within one colour each, so only edges of one colour outside of those found are left. No pairs of nodes are ever made but edges.
    """
    by = list(by)
    graph = _kept(edges(graph, by))
    left, found = graph, []
    while True:
        for _ in range(trims):
            inner = left.select(*by, F.col("u").alias("x")).intersect(left.select(*by, F.col("v")))
            left = left.join(inner.withColumnRenamed("x", "u"), [*by, "u"], "left_semi").join(inner.withColumnRenamed("x", "v"), [*by, "v"], "left_semi").select(*by, "u", "v")
        left = _kept(left)
        if left.isEmpty():
            break
        colour = _kept(_colours(left, by))
        same = left.join(colour.select(*by, F.col("x").alias("u"), "c"), [*by, "u"]).join(colour.select(*by, F.col("x").alias("v"), "c"), [*by, "v", "c"])
        same = _kept(same.select(*by, "c", "u", "v"))
        members = _kept(_reaching(colour.where("x = c"), same, [*by, "c"]))
        found.append(members)
        for end in ("u", "v"):
            same = same.join(members.select(*by, F.col("x").alias(end)), [*by, end], "left_anti")
        left = same.select(*by, "u", "v")
    named = nodes(graph, by)
    if not found:
        return named.withColumn("scc", F.col("x"))
    told = found[0]
    for one in found[1:]:
        told = told.unionByName(one)
    return named.join(told, [*by, "x"], "left").select(*by, "x", F.coalesce("c", "x").alias("scc"))


def _colours(graph: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, c): the smallest node that reaches each node."""
    fresh = _kept(nodes(graph, by).withColumn("c", F.col("x")))
    known = Kept(fresh)
    while True:
        held = known.table().groupBy(*by, "x").agg(F.min("c").alias("c"))
        sent = fresh.withColumnRenamed("x", "u").join(graph, [*by, "u"]).groupBy(*by, F.col("v").alias("x")).agg(F.min("c").alias("_c"))
        fresh = _kept(sent.join(held, [*by, "x"]).where("_c < c").select(*by, "x", F.col("_c").alias("c")))
        if fresh.isEmpty():
            return held
        known.add(fresh)


def _reaching(roots: DataFrame, graph: DataFrame, by: list[str], of: Sequence[str] = ()) -> DataFrame:
    """(by, of, x): the nodes that reach the roots (by, of, x); `of` names roots and is no column of the graph."""
    own = [*by, *of]
    fresh = _kept(roots.select(*own, "x"))
    known = Kept(fresh)
    while True:
        back = fresh.withColumnRenamed("x", "v").join(graph, [*by, "v"]).select(*own, F.col("u").alias("x")).distinct()
        fresh = _kept(back.join(known.table(), [*own, "x"], "left_anti"))
        if fresh.isEmpty():
            return known.table()
        known.add(fresh)


def condensed(graph: DataFrame, scc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The distinct edges (by, u, v) between components."""
    named = graph.join(scc.select(*by, F.col("x").alias("u"), F.col("scc").alias("su")), [*by, "u"]).join(scc.select(*by, F.col("x").alias("v"), F.col("scc").alias("sv")), [*by, "v"])
    return named.where("su <> sv").select(*by, F.col("su").alias("u"), F.col("sv").alias("v")).distinct()


def levels(order: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, level) of the nodes `members` (by, x) of a graph without cycles (by, u, v): 0 without successors, else one above the highest of them.

    Round r holds the nodes from which a way of r edges leads down, which are those with a successor of round r - 1; as many rounds as levels, each of what is left only.
    """
    by = list(by)
    order = cut(order.select(*by, "u", "v"))
    fresh = cut(members.select(*by, "x").distinct())
    most = fresh.count()
    out = None
    for level in range(most + 1):
        above = cut(order.join(fresh.withColumnRenamed("x", "v"), [*by, "v"], "left_semi").select(*by, F.col("u").alias("x")).distinct())
        done = fresh.join(above, [*by, "x"], "left_anti").withColumn("level", F.lit(level))
        out = done if out is None else out.union(done)
        if above.isEmpty():
            return out
        fresh = above
    raise ValueError("the graph has a cycle")


def condensation(graph: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The components (by, x, scc) of a graph, and the edges (by, u, v, level) between them with the level of u; a component without edges out is none's u."""
    by = list(by)
    graph = cut(edges(graph, by))
    scc = cut(components(graph, by))
    order = cut(condensed(graph, scc, by))
    placed = levels(order, scc.select(*by, F.col("scc").alias("x")), by)
    return scc, cut(order.join(placed.withColumnRenamed("x", "u"), [*by, "u"]).select(*by, "u", "v", "level"))


def merged_by_levels(order: DataFrame, own: DataFrame, keys: Sequence[str], value: str | None, by: Sequence[str] = ()) -> DataFrame:
    """The rows (by, x, keys, value) of `own`, and for each node also those of all nodes that it reaches along `order` (by, u, v, level): the largest value of each key.

    Without `value` the rows are sets. One merge for each level, of the successors' finished rows; lower levels are never touched again.
    """
    by, keys = list(by), list(keys)
    columns = [*by, "x", *keys]
    merge = (lambda rows: rows.groupBy(*columns).agg(F.max(value).alias(value))) if value else (lambda rows: rows.select(*columns).distinct())
    own = cut(merge(own))
    order = cut(order)
    steps = small(order)
    top = order.agg(F.max("level")).first()[0] or 0
    done = Kept(own)  # of nodes above level 0 too: their own rows are part of what they end with
    for level in range(1, top + 1):
        now = steps.where(F.col("level") == level).select(*by, F.col("v").alias("x"), F.col("u").alias("_up"))
        sent = done.table().join(now, [*by, "x"]).drop("x").withColumnRenamed("_up", "x")
        done.add(cut(merge(sent.select(*columns, *([value] if value else [])))))
    return merge(done.table())


def reach_by_levels(graph: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, reward): how many nodes each node reaches, exact, by merging the members of components level by level."""
    by = list(by)
    scc, order = condensation(graph, by)
    own = scc.select(*by, F.col("scc").alias("x"), F.col("x").alias("member"))
    sizes = merged_by_levels(order, own, ["member"], None, by).groupBy(*by, F.col("x").alias("scc")).agg(F.count("*").alias("reward"))
    return scc.join(sizes, [*by, "scc"]).select(*by, "x", "reward")


def affected(before: DataFrame, after: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, v): the candidates whose cover has grown between two sets of pairs (by, v, u)."""
    return after.join(before, [*by, "v", "u"], "left_anti").select(*by, "v").distinct()


class GrowingReach:
    """The pairs (v, u) of a graph that grows by batches of edges: v reaches u, itself included.

    A batch adds known x new edges x known. Nodes seen first reach themselves (so an edge with one or two new ends is no case of its own); an edge whose ends are
    connected already adds nothing; the other edges are closed among themselves over the known pairs, and only nodes that do not reach
    an edge's end yet pass through it. What is joined with the known pairs is of the size of the change, and is broadcast while it is small, so that
    the known pairs are read where they lie.
    """

    def __init__(self, graph: DataFrame | None = None):
        self.known = Kept(cut(reach(edges(graph)))) if graph is not None else None

    def pairs(self) -> DataFrame:
        return self.known.table()

    def _fresh(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are not known, kept."""
        pairs = cut(pairs)
        hits = self.pairs().join(small(pairs), ["v", "u"], "left_semi")
        return cut(pairs.join(small(cut(hits)), ["v", "u"], "left_anti"))

    def extend(self, batch: DataFrame) -> DataFrame:
        """Add edges (u, v); the pairs (v, u) that are new, kept."""
        batch = cut(edges(batch))
        loops = nodes(batch).select(F.col("x").alias("v"), F.col("x").alias("u"))
        if self.known is None:
            loops = cut(loops)
            self.known = Kept(loops)
        else:
            loops = self._fresh(loops)
            self.known.add(loops)
        new = self._fresh(batch.select(F.col("u").alias("v"), F.col("v").alias("u")))  # as pairs: v the edge's start, u its end
        if new.isEmpty():
            return loops
        starts, ends = new.select(F.col("v").alias("u")).distinct(), new.select(F.col("u").alias("v")).distinct()
        between = self.pairs().join(small(cut(starts)), "u", "left_semi").join(small(cut(ends)), "v", "left_semi")
        hops = cut(between.select(F.col("v").alias("at"), F.col("u").alias("mid")).join(new.withColumnRenamed("v", "mid"), "mid").select("at", F.col("u").alias("to")).where("at <> to").distinct())
        closed, fresh = Kept(new), new
        while True:
            further = fresh.withColumnRenamed("u", "at").join(small(hops), "at").select("v", F.col("to").alias("u")).distinct()
            fresh = cut(further.join(closed.table(), ["v", "u"], "left_anti"))
            if fresh.isEmpty():
                break
            closed.add(fresh)
        through = cut(closed.table())
        passing = self.pairs().join(small(through.select(F.col("v").alias("u"), F.col("u").alias("end"))), "u").select("v", F.col("end").alias("u")).distinct()
        passing = self._fresh(passing)
        onward = self.pairs().select(F.col("v").alias("mid"), F.col("u").alias("to"))
        gained = self._fresh(onward.join(small(passing.withColumnRenamed("u", "mid")), "mid").select("v", F.col("to").alias("u")).distinct())
        self.known.add(gained)
        return cut(loops.union(gained))


class GrowingComponents:
    """The components of a graph that grows by batches of edges, and the edges between them; it tells whose reach a batch grows, without the pairs that `GrowingReach` holds.

    A node's reach grows where it reaches the start of a new edge but not its end. Whole components do so together, and a batch's edges within a component change nothing. So
    what is searched are components above the ends of edges between two of them: marks go up the order once for all edges to nodes seen first, and by ends for the others.
    A batch's components are those of the order so far and the batch's edges between components, not of the graph.
    """

    def __init__(self):
        self.members = self.order = self.added = None  # (x, c): a node's component; (u, v) between components; those of the last batch

    def _settle(self) -> None:
        """Merge the components that the last batch has joined."""
        graph = self.added if self.order is None else self.order.unionByName(self.added)
        scc = _kept(components(graph, trims=1))
        renamed = self.members.join(scc.withColumnRenamed("x", "c"), "c", "left")
        self.members, self.order, self.added = _kept(renamed.select("x", F.coalesce("scc", "c").alias("c"))), _kept(condensed(graph, scc)), None

    def extend(self, batch: DataFrame) -> DataFrame:
        """Add edges (u, v); the nodes (x) whose reach grows, kept."""
        batch = _kept(edges(batch))
        if self.members is None:
            fresh = _kept(nodes(batch))
            self.members, self.added = fresh.select("x", F.col("x").alias("c")), batch
            return fresh
        if self.added is not None:
            self._settle()
        fresh = _kept(nodes(batch).join(self.members, "x", "left_anti"))
        placed = _kept(self.members.unionByName(fresh.select("x", F.col("x").alias("c"))))
        named = batch.join(placed.select(F.col("x").alias("u"), F.col("c").alias("_u")), "u").join(placed.select(F.col("x").alias("v"), F.col("c").alias("_v")), "v")
        named = _kept(named.where("_u <> _v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct())
        if named.isEmpty():
            return fresh  # and none is new
        grown = self.members.join(self._gaining(named, fresh).select(F.col("x").alias("c")), "c", "left_semi").select("x")
        grown = _kept(grown.union(fresh))
        self.members, self.added = placed, named
        return grown

    def _gaining(self, named: DataFrame, fresh: DataFrame) -> DataFrame:
        """The known components (x) that reach more by the edges `named` between components, of which `fresh` are new nodes."""
        start, end = fresh.select(F.col("x").alias("u")), fresh.select(F.col("x").alias("v"))
        old = _kept(named.join(start, "u", "left_anti"))
        found = _kept(_reaching(old.join(end, "v", "left_semi").select(F.col("u").alias("x")).distinct(), self.order, []))
        pairs = _kept(old.join(end, "v", "left_anti").join(found.select(F.col("x").alias("u")), "u", "left_anti"))
        if pairs.isEmpty():
            return found
        ends = pairs.select(F.col("u").alias("e")).union(pairs.select("v")).distinct()
        above = _kept(_reaching(ends.withColumn("x", F.col("e")), self.order, [], ["e"]))
        gain = pairs.join(above.withColumnRenamed("e", "u"), "u").select("v", "x").distinct()
        return found.union(gain.join(above.withColumnRenamed("e", "v"), ["v", "x"], "left_anti").select("x")).distinct()


def affected_by_batches(stream: DataFrame, step: str = "step") -> DataFrame:
    """(step, x): the nodes whose reach grows with each batch of edges (step, u, v), batches in ascending order."""
    stream = cut(stream.groupBy("u", "v").agg(F.min(step).alias(step)))  # an edge that comes again changes nothing
    grown, out = GrowingComponents(), None
    for row in stream.select(step).distinct().orderBy(step).collect():  # a batch is a job of its own, as it would be on a stream
        gained = grown.extend(stream.where(F.col(step) == row[0]))
        one = gained.select(F.lit(row[0]).alias(step), "x")
        out = one if out is None else out.union(one)
    return out if out is not None else stream.select(step, F.col("u").alias("x"))
