"""The threshold sieve kept over the micro-batches of a stream that only grows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rewards, sieve
from ..plans import cut, small


class KeptSieve:
    """Sets, index ranges and covers in tables under the shared folder `at`, taken on by each batch of rows (by, t, u, v).

    A batch writes what it adds: `first` (by, v, u, ft), the pairs that it meets first; `levels` (by, most, since), the values that the largest reward of one node takes in it;
    `sets` (by, i, v, ins), its insertions; `best` (by, n, value, i, nodes), each key's best set at its last step n in the batch. It reads those of earlier batches only and
    overwrites its own, so that a batch taken again, whole or after a failure, changes nothing. The sets go on from their last insertion: gains are weighed for the
    venues of the batch alone, over their rows and those of the few venues held. `first` is scanned by columns and filtered to these venues; nothing else of it is joined.

    Rows of one key must come by ascending t from batch to batch. After any division into batches the sets are those of `operators.sieve.sieve` on the rows so far.
    """

    def __init__(self, spark: SparkSession, at: str, k: int, eps: float, by: Sequence[str] = ("stream",), kinds: Sequence[str] = ("int",)):
        self.at, self.k, self.eps, self.by = at, k, eps, list(by)
        keys = ", ".join(f"{name} {kind}" for name, kind in zip(by, kinds))
        columns = {"first": "v long, u long, ft long", "levels": "most long, since long", "sets": "i long, v long, ins long", "best": "n long, value long, i long, nodes array<long>"}
        self.schemas = {name: f"{keys}, {rest}" for name, rest in columns.items()}
        for name, schema in self.schemas.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{at}/{name}/batch=-1")

    def table(self, spark: SparkSession, name: str, before: int | None = None) -> DataFrame:
        """A table as the batches `before` this one, or all, have left it."""
        kept = spark.read.schema(f"{self.schemas[name]}, batch long").parquet(f"{self.at}/{name}")
        return (kept if before is None else kept.where(F.col("batch") < before)).drop("batch")

    def take(self, batch: DataFrame, number: int) -> None:
        """Take the rows of one batch; a function for `foreachBatch`."""
        spark, by = batch.sparkSession, self.by
        rows = cut(batch.select(*by, "t", "u", "v"))
        before = {name: cut(self.table(spark, name, number)) for name in ("levels", "sets")}
        touched = rows.select(*by, "v").distinct()
        asked = cut(touched.union(before["sets"].select(*by, "v")).distinct())
        known = cut(self.table(spark, "first", number).join(small(asked), [*by, "v"], "left_semi"))
        fresh = cut(rewards.first_times(rows, by).join(known, [*by, "v", "u"], "left_anti").select(*by, "v", "u", "ft"))
        first = cut(known.unionByName(fresh))
        most = before["levels"].groupBy(*by).agg(F.max("most").alias("_most"))
        new = sieve.levels(first.join(touched, [*by, "v"], "left_semi"), by).join(most, by, "left").where("_most IS NULL OR most > _most").select(*by, "most", "since")
        levels = cut(new.select(*by, F.col("most").cast("long").alias("most"), "since"))
        ranges = cut(sieve.ranges_of(before["levels"].unionByName(levels), self.k, self.eps, by))
        open_now = ranges.join(rows.groupBy(*by).agg(F.min("t").alias("_from")), by).where("until IS NULL OR until >= _from").drop("_from")
        sets = cut(sieve.grown(first, rows.select(*by, "v", F.col("t").alias("n")), cut(open_now), self.k, self.eps, by, before["sets"]))
        best = sieve.best_set(before["sets"].unionByName(sets), ranges, first, by)
        best = rows.groupBy(*by).agg(F.max("t").alias("n")).join(best, by).select(*by, "n", "value", "i", "nodes")
        for name, table in (("first", fresh), ("levels", levels), ("sets", sets), ("best", best)):
            table.write.mode("overwrite").parquet(f"{self.at}/{name}/batch={number}")


def keep_sieve(stream: DataFrame, at: str, state: str, k: int, eps: float, by: Sequence[str] = ("stream",), **trigger: object) -> StreamingQuery:
    """Start a query that takes a streaming DataFrame (by, t, u, v) into the `KeptSieve` under `at`; a query started anew with the same `state` folder goes on after the last whole batch."""
    kinds = dict(stream.dtypes)
    kept = KeptSieve(stream.sparkSession, at, k, eps, by, [kinds[c] for c in by])
    return stream.writeStream.foreachBatch(kept.take).option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start()


def sieved(spark: SparkSession, at: str, by: Sequence[str] = ("stream",), kinds: Sequence[str] = ("int",)) -> DataFrame:
    """(by, n, value, i, nodes) at the end of each batch that was taken."""
    return KeptSieve(spark, at, 0, 0.0, by, kinds).table(spark, "best")
