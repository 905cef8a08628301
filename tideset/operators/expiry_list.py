"""A pruned list of sieves over one whole expiring stream, taken on batch by batch as Spark jobs.

The list holds sieves by the step at which they expire; the sieve of expiry x has seen the rows that are alive at x or longer. A batch of rows goes to all sieves that
expire no later than they do: `sieve.grown` with the expiry as a key takes all sieves on at once. The expiries of new rows begin as copies of their successor, to
which the live rows between the two are added. Then sieves between two of nearly equal value go, so the list stays short: its head gives the best set of the step.

Rows, covers and sets are tables; a batch reads those that the batch before has left and writes its own, so a batch taken again changes nothing, and the
state has the size of what is alive times the list. The driver holds only the list itself, an expiry and a value for each sieve: before it is pruned,
at most one for each `width` steps of the longest lifetime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import cut, small
from . import sieve

_SCHEMAS = {
    "live": "u long, v long, last long",
    "first": "x long, v long, u long, ft long",
    "levels": "x long, most long, since long",
    "sets": "x long, i long, v long, ins long",
    "list": "x long, value long",
    "told": "n long, value long, i long, nodes array<long>, calls long, n_sieves long",
}


def pruned(values: list[tuple[int, int]], eps: float) -> list[tuple[int, int]]:
    """The (expiry, value) of a list by expiry without those between a sieve and the last after it whose values all are within a share of eps of its own."""
    kept: list[tuple[int, int]] = []
    end = None  # the last of the run that follows kept[-1]
    for one in values:
        if kept and one[1] >= (1 - eps) * kept[-1][1]:
            end = one
            continue
        if end:
            kept.append(end)
            end = None
            if one[1] >= (1 - eps) * kept[-1][1]:
                end = one
                continue
        kept.append(one)
    return kept + [end] if end else kept


class ExpiryList:
    """The list under the shared folder `at`; `width` rounds the expiries of new sieves down, so that a batch begins fewer (1: one for each expiry)."""

    def __init__(self, spark: SparkSession, at: str, k: int, eps: float, width: int = 1):
        self.at, self.k, self.eps, self.width = at, k, eps, width
        for name, schema in _SCHEMAS.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{at}/{name}/batch=-1")

    def told(self, spark: SparkSession) -> DataFrame:
        """(n, value, i, nodes, calls, n_sieves) at the last step n of each batch: the head's best set, the gains weighed in the batch and the list's length."""
        return spark.read.schema(f"{_SCHEMAS['told']}, batch long").parquet(f"{self.at}/told").drop("batch")

    def take(self, batch: DataFrame, number: int) -> None:
        """Take batch `number` = 0, 1, ... of rows (t, u, v, l), each later than all of the batches before; a function for `foreachBatch`."""
        spark = batch.sparkSession
        rows = cut(batch.select("t", "u", "v", (F.col("t") + F.col("l") - 1).alias("last")))
        before = {name: spark.read.schema(schema).parquet(f"{self.at}/{name}/batch={number - 1}") for name, schema in _SCHEMAS.items() if name != "told"}
        begin, now = rows.agg(F.min("t"), F.max("t")).first()
        if now is None:
            self._write(number, **before, told=spark.createDataFrame([], _SCHEMAS["told"]))
            return
        stay = sorted(r.x for r in before["list"].where(F.col("x") >= now).collect())
        arriving = rows.where(F.col("last") >= now)
        rounded = F.greatest(F.lit(now), F.floor(F.col("last") / self.width) * self.width).cast("long")
        begun = sorted({r.x for r in arriving.select(rounded.alias("x")).distinct().collect()} - set(stay))
        after = {x: min((y for y in stay if y > x), default=None) for x in begun}
        source = spark.createDataFrame([(x, x) for x in stay] + [(x, y) for x, y in after.items()], "x long, source long")
        held = {name: cut(before[name].withColumnRenamed("x", "source").join(small(source), "source").drop("source")) for name in ("first", "levels", "sets")}

        live = cut(before["live"].where(F.col("last") >= now))
        feeds = arriving.select(F.explode(self._those([(x, None) for x in stay + begun])).alias("x"), "v", "u", F.col("t").alias("n"))
        if begun:
            feeds = feeds.union(live.select(F.explode(self._those(list(after.items()))).alias("x"), "v", "u", F.lit(begin).alias("n")))
        feeds = cut(feeds)
        fresh = feeds.groupBy("x", "v", "u").agg(F.min("n").alias("ft")).join(held["first"], ["x", "v", "u"], "left_anti")
        first = cut(held["first"].unionByName(fresh))
        levels = cut(held["levels"].unionByName(self._higher(first, feeds, held["levels"])))
        ranges = cut(sieve.ranges_of(levels, self.k, self.eps, ["x"]))
        points = feeds.select("x", "v", "n")
        grown = sieve.grown(first, points, ranges, self.k, self.eps, ["x"], held["sets"])
        sets = cut(held["sets"].unionByName(grown.select("x", "i", "v", "ins")))
        best = cut(sieve.best_set(sets, ranges, first, ["x"]))
        calls = sieve.gains_weighed(sets, ranges, points, self.k, ["x"]).agg(F.sum("calls")).first()[0] or 0

        value = {r.x: r.value for r in best.select("x", "value").collect()}
        kept = pruned([(x, value.get(x, 0)) for x in sorted(stay + begun)], self.eps)
        mine = small(spark.createDataFrame(kept, _SCHEMAS["list"]).select("x"))
        head = spark.createDataFrame([(now, kept[0][0], calls, len(kept))], "n long, x long, calls long, n_sieves long")
        told = head.join(best, "x", "left").select("n", F.coalesce("value", F.lit(0)).alias("value"), "i", "nodes", "calls", "n_sieves")
        state = {name: table.join(mine, "x", "left_semi") for name, table in (("first", first), ("levels", levels), ("sets", sets))}
        self._write(number, live=live.unionByName(arriving.select("u", "v", "last")), list=spark.createDataFrame(kept, _SCHEMAS["list"]), told=told, **state)

    @staticmethod
    def _those(spans: list[tuple[int, int | None]]):
        """The expiries x of `spans` (x, end) that a row's `last` reaches, but not their `end`."""
        each = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(end).cast("long").alias("end")) for x, end in spans])
        return F.transform(F.filter(each, lambda s: (s.x <= F.col("last")) & (s.end.isNull() | (F.col("last") < s.end))), lambda s: s.x)

    def _higher(self, first: DataFrame, feeds: DataFrame, levels: DataFrame) -> DataFrame:
        """The levels that the largest reward of one venue takes by the feeds."""
        touched = first.join(feeds.select("x", "v").distinct(), ["x", "v"], "left_semi")
        most = levels.groupBy("x").agg(F.max("most").alias("_most"))
        new = sieve.levels(touched, ["x"]).join(most, "x", "left").where("_most IS NULL OR most > _most")
        return new.select("x", F.col("most").cast("long").alias("most"), "since")

    def _write(self, number: int, **tables: DataFrame) -> None:
        for name, table in tables.items():
            table.select(*[c.split()[0] for c in _SCHEMAS[name].split(", ")]).write.mode("overwrite").parquet(f"{self.at}/{name}/batch={number}")
