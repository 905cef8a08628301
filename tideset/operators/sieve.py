"""Threshold sieving of a stream that only grows, and of an expiring one by snapshots.

For each threshold index a set of at most k nodes grows: when a node's cover has changed and its gain over the set reaches the threshold, it joins.
Sets of different indices do not touch each other, and a set changes k times at most, so instead of replaying the stream the sieve
is k rounds over all groups and indices together. A round finds, for each set, the first point (step, node) after the last insertion at which a gain reaches the
threshold: gains are running sums over a candidate's elements, +1 when it first covers one, -1 when the set does. Each element's row knows who covers it, so the sets, which are
few and small, go to the elements, and what comes back is counted by slices of the stream before any of it is sorted.

Both rewards fit: `first` holds when a candidate v first covers an element u (a venue its user, or a node another node that it reaches).
A snapshot of an expiring stream is a stream of its live rows that only grows, so per-lifetime reduction is this operator with the snapshot as a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import highest_index, lowest_index, threshold
from ..plans import BROADCAST, cut, running, small
from .rewards import largest_so_far

PART, SLICES = 100_000, 512  # rows that a round searches without slices, and slices of a longer stream
_END = 1 << 62


def levels(first: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, most, since): each value that the largest reward of one node takes, and the step from which it does."""
    return largest_so_far(first, by).groupBy(*by, "most").agg(F.min("n").alias("since"))


def ranges_of(levels: DataFrame, k: int, eps: float, by: Sequence[str]) -> DataFrame:
    """(by, i, since, until): the steps at which each threshold index is kept; `until` is null for those kept to the end."""
    by = list(by)
    ranges = levels.withColumn("until", F.lead("since").over(Window.partitionBy(*by).orderBy("since")) - 1)
    indexed = ranges.select(*by, "since", "until", F.explode(F.sequence(lowest_index(F.col("most"), eps), highest_index(F.col("most"), k, eps))).alias("i"))
    until = F.when(F.count(F.when(F.col("until").isNull(), 1)) == 0, F.max("until"))
    return indexed.groupBy(*by, "i").agg(F.min("since").alias("since"), until.alias("until"))


def index_ranges(first: DataFrame, k: int, eps: float, by: Sequence[str]) -> DataFrame:
    """`ranges_of` the levels of a stream."""
    return ranges_of(levels(first, by), k, eps, by)


def sieve(first: DataFrame, points: DataFrame, k: int, eps: float, by: Sequence[str] = ("snap",)) -> tuple[DataFrame, DataFrame]:
    """The sets (by, i, v, ins) with the step of each insertion, and the index ranges of `index_ranges`.

    first: (by, v, u, ft); points: (by, v, n), the steps at which candidates are looked at. At one step, nodes are looked at by ascending id, after all of the step's rows.
    """
    ranges = cut(index_ranges(first, k, eps, by))
    return grown(first, points, ranges, k, eps, by), ranges


def grown(first: DataFrame, points: DataFrame, ranges: DataFrame, k: int, eps: float, by: Sequence[str] = ("snap",), held: DataFrame | None = None) -> DataFrame:
    """The insertions (by, i, v, ins) at `points` into the sets `held` of earlier points (none: empty sets).

    Only what the points ask for need be in `first`: the rows, of all steps, of the nodes looked at and of those held. From a group's first point on, each step at which a node
    first covers an element must be one of its points. No other point inserts: between two such steps a node's gain only falls, as sets and their covers grow, and an
    index that begins asks for more than any node has covered before. So a round looks at first times alone.
    """
    by = list(by)
    key = [*by, "i"]
    first = cut(first.select(*by, "v", "u", "ft"))
    asked = cut(points.groupBy(*by, "v").agg(F.min("n").alias("_from")))
    degree = cut(first.join(asked, [*by, "v"], "left_semi").groupBy(*by, "v").agg(F.count("*").alias("d")))
    begun = ranges.join(asked.groupBy(*by).agg(F.min("_from").alias("_from")), by)
    kept = cut(begun.select(*key, F.greatest("since", "_from").alias("lo"), "until", threshold(F.col("i"), k, eps).alias("asks")))
    n_keys, (n_rows, low, high) = kept.count(), first.agg(F.count("*"), F.min("ft"), F.max("ft")).first()
    if not n_rows or not n_keys:
        return kept.join(asked, by).select(*key, "v", F.col("lo").alias("ins")).limit(0)
    # who covers an element, since when, and how many a node that is looked at covers in the end
    parts = first.sparkSession.sparkContext.defaultParallelism
    elements = first.join(small(degree), [*by, "v"], "left").repartition(max(parts, n_rows // PART), *by, "u")
    elements = cut(elements.groupBy(*by, "u").agg(F.collect_list(F.struct("v", "ft", "d")).alias("cover")))
    sized = F.broadcast if n_keys * (128 + 32 * k) <= BROADCAST else lambda df: df
    width = None if n_rows <= PART else (high - low) // SLICES + 1
    taken = None if held is None else cut(held.select(*key, "v", "ins"))
    chosen: list[DataFrame] = []
    for turn in range(k):
        pool = kept if not turn else kept.join(chosen[-1].select(*key), key, "left_semi")
        if taken is None:
            pool = pool.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (("members", "map<bigint,bigint>"), ("ins", "bigint"), ("at", "bigint"))])
        else:
            entries = F.map_from_entries(F.collect_list(F.struct("v", "ins"))).alias("members")  # k at most
            now = taken.groupBy(*key).agg(entries, F.max(F.struct("ins", "v")).alias("_x"), F.count("*").alias("_size"))
            pool = pool.join(now, key, "left").where(F.coalesce("_size", F.lit(0)) < k)
            pool = pool.withColumns({"ins": F.col("_x.ins"), "at": F.col("_x.v"), "lo": F.greatest("lo", "_x.ins")}).drop("_x", "_size").where("until IS NULL OR lo <= until")
        pool = sized(cut(pool))
        new = _inserted(_events(elements, pool, by), pool, key, width, low)
        if new.isEmpty():
            break
        chosen.append(new)
        taken = new if taken is None else taken.unionByName(new)
    if not chosen:
        return kept.join(asked, by).select(*key, "v", F.col("lo").alias("ins")).limit(0)
    return reduce(DataFrame.union, [c.select(*key, "v", "ins") for c in chosen])


def _events(elements: DataFrame, pool: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, v, n, d, look): the steps at which a candidate's gain over its set changes by d; what came before `lo` counts there. `look` where the candidate itself grows."""
    own = F.filter("cover", lambda x: F.map_contains_key("members", x.v))
    covered = F.array_min(F.transform(own, lambda x: F.greatest(x.ft, F.element_at("members", x.v))))
    each = elements.join(pool, by).withColumn("c", covered).withColumn("_one", F.explode("cover"))
    each = each.select(*by, "i", "_one.v", "_one.d", "_one.ft", F.greatest("_one.ft", "lo").alias("n"), "lo", "until", "asks", "members", "c")
    each = each.where("d >= asks AND (until IS NULL OR n <= until) AND (c IS NULL OR c > n)").where(~F.coalesce(F.map_contains_key("members", F.col("v")), F.lit(False)))
    event = lambda n, d, look: F.struct(n.alias("n"), F.lit(d).alias("d"), look.alias("look"))
    gained, lost = event(F.col("n"), 1, F.col("ft") >= F.col("lo")), event(F.col("c"), -1, F.lit(False))
    both = F.when(F.col("c") <= F.coalesce("until", "c"), F.array(gained, lost)).otherwise(F.array(gained))
    return each.select(*by, "i", "v", F.explode(both).alias("_e")).select(*by, "i", "v", "_e.*")


def _inserted(events: DataFrame, pool: DataFrame, key: list[str], width: int | None, low: int) -> DataFrame:
    """(by, i, ins, v), kept: the first look of each set, after its last insertion, at which a gain reaches what the set asks for.

    Counts by slices of `width` steps tell, without a sort of all events, in which slices a gain may reach it. Only these are searched step by step, those of each set from the
    first on, more of them each time, until one inserts.
    """
    if width is None:
        return cut(_reached(events.withColumns({"s": F.lit(0), "before": F.lit(0)}), pool, key))
    events = events.withColumn("s", F.floor((F.col("n") - low) / width))
    cells = events.groupBy(*key, "v", "s").agg(F.sum("d").alias("net"), F.count(F.when(F.col("d") > 0, 1)).alias("plus"), F.max("look").alias("look"))
    earlier = Window.partitionBy(*key, "v").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("net").over(earlier), F.lit(0))).join(pool.select(*key, "asks"), key)
    left = cut(cells.where("look AND before + plus >= asks").select(*key, "v", "s", "before"))
    found, span = [], 4
    while True:
        begin = left.groupBy(*key).agg(F.min("s").alias("_s"))
        tried = cut(left.join(begin, key).where(F.col("s") < F.col("_s") + span).drop("_s"))
        found.append(cut(_reached(events.join(small(tried), [*key, "v", "s"]), pool, key)))
        left = left.join(tried, [*key, "v", "s"], "left_anti").join(found[-1], key, "left_anti")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
        span *= 4


def _reached(events: DataFrame, pool: DataFrame, key: list[str]) -> DataFrame:
    """(by, i, ins, v): each set's first insertion among events (key, v, s, n, d, look) whose slices s begin with the gains `before`."""
    steps = events.groupBy(*key, "v", "s", "before", "n").agg(F.sum("d").alias("d"), F.max("look").alias("look"))
    gain = F.col("before") + F.sum("d").over(Window.partitionBy(*key, "v", "s").orderBy("n"))
    found = steps.withColumn("gain", gain).where("look").join(pool.select(*key, "asks", "ins", "at"), key)
    found = found.where("gain >= asks AND (ins IS NULL OR n > ins OR n = ins AND v > at)")
    return found.groupBy(*key).agg(F.min(F.struct("n", "v")).alias("_x")).select(*key, F.col("_x.n").alias("ins"), F.col("_x.v").alias("v"))


def _covers(sets: DataFrame, first: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, i, u, c): when each set covers each element."""
    return sets.join(first, [*by, "v"]).groupBy(*by, "i", "u").agg(F.min(F.greatest("ft", "ins")).alias("c"))


def best_set(sets: DataFrame, ranges: DataFrame, first: DataFrame, by: Sequence[str] = ("snap",)) -> DataFrame:
    """(by, value, i, nodes) at the end: of the indices kept, the set with the largest reward, of equal ones the lowest index.

    A group in which no node reached a threshold has no row.
    """
    by = list(by)
    kept = sets.join(ranges.where("until IS NULL").select(*by, "i"), [*by, "i"], "left_semi")
    values = _covers(kept, first, by).groupBy(*by, "i").agg(F.count("*").alias("value"))
    best = values.groupBy(*by).agg(F.min(F.struct((-F.col("value")).alias("g"), "i")).alias("b")).select(*by, (-F.col("b.g")).alias("value"), F.col("b.i").alias("i"))
    nodes = kept.groupBy(*by, "i").agg(F.array_sort(F.collect_list("v")).alias("nodes"))  # k at most
    return best.join(nodes, [*by, "i"]).select(*by, "value", "i", "nodes")


def value_per_step(sets: DataFrame, ranges: DataFrame, first: DataFrame, by: Sequence[str] = ("stream",)) -> DataFrame:
    """(by, n, value): the best set's reward after each step n at which some set's reward or the kept indices changed.

    The stream falls into spans at the steps at which indices are dropped. Within a span all that is kept stays, and rewards only grow, so the best one is a running maximum;
    a span begins with what its indices had reached before.
    """
    by = list(by)
    grown = _covers(sets, first, by).groupBy(*by, "i", F.col("c").alias("n")).agg(F.count("*").alias("d"))
    series = running(grown, [*by, "i"], "n", "d", "value").join(ranges, [*by, "i"]).withColumn("n", F.greatest("n", "since")).where("until IS NULL OR n <= until")
    ends = cut(ranges.where("until IS NOT NULL").select(*by, (F.col("until") + 1).alias("n")).distinct())
    # a group has few indices, and few ends: their number grows with the logarithm of its largest reward
    spans = cut(ends.groupBy(*by).agg(F.array_sort(F.collect_list("n")).alias("ends")))
    series = series.join(small(spans), by, "left").withColumn("span", F.coalesce(F.size(F.filter("ends", lambda n: n <= F.col("n"))), F.lit(0)))
    series = cut(series.select(*by, "i", "span", "n", "value", "until"))
    reached = series.groupBy(*by, "i", "span", "until").agg(F.max("value").alias("value"))
    later = reached.join(spans, by).select(*by, "until", "span", "value", F.posexplode("ends").alias("at", "n"))  # the span that begins at ends[at] is at + 1
    begun = later.where("at + 1 > span AND (until IS NULL OR until >= n)").groupBy(*by, "n", (F.col("at") + 1).alias("span")).agg(F.max("value").alias("value"))
    steps = series.select(*by, "n", "span", "value").unionByName(begun).groupBy(*by, "span", "n").agg(F.max("value").alias("value"))
    return running(steps, [*by, "span"], "n", "value", "most", "max").select(*by, "n", F.col("most").alias("value"))


def gains_weighed(sets: DataFrame, ranges: DataFrame, points: DataFrame, k: int, by: Sequence[str] = ("snap",)) -> DataFrame:
    """(by, i, calls): how many gains the sieve weighs for each index, those of indices that it drops later too.

    A point (v, n) costs a gain for each index kept at n whose set is not full yet and has not taken v before. These are the points of a node between two steps, so running
    counts at both tell their number.
    """
    by = list(by)
    key = [*by, "i"]
    stop = sets.groupBy(*key).agg(F.count("*").alias("c"), F.max(F.struct(F.col("ins").alias("n"), "v")).alias("stop")).where(F.col("c") == k).select(*key, "stop")
    kept = cut(ranges.join(stop, key, "left"))
    seen = cut(points.groupBy(*by, "v", "n").agg(F.lit(1).alias("d")))
    full = F.when(F.col("v") <= F.col("stop.v"), F.col("stop.n")).otherwise(F.col("stop.n") - 1)
    last = F.least("until", full, "ins", F.when(F.coalesce("until", "stop.n", "ins").isNull(), F.lit(_END)))
    asked = seen.select(*by, "v").distinct().join(kept, by).join(sets.select(*key, "v", "ins"), [*key, "v"], "left").withColumn("last", last).where("last >= since")
    ends = F.array(F.struct((F.col("since") - 1).alias("n"), F.lit(-1).alias("sign")), F.struct(F.col("last").alias("n"), F.lit(1).alias("sign")))
    asked = asked.select(*by, "v", "i", F.explode(ends).alias("_e")).select(*by, "v", "i", "_e.*", F.lit(0).alias("d"))
    both = running(seen.withColumns({"i": F.lit(None).cast("long"), "sign": F.lit(0)}).unionByName(asked), [*by, "v"], "n", "d", "seen")
    return both.where("sign <> 0").groupBy(*key).agg(F.sum(F.col("sign") * F.col("seen")).alias("calls")).where("calls > 0")
