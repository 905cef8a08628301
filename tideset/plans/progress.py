"""Progress of batch and streaming runs: figures that Spark gathers while a plan runs, without a job of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """What each micro-batch of the streams it listens to took and found: `batches`, rows (query, batch, rows, ms, metrics) as they end. Add it by spark.streams.addListener.

    metrics holds the figures of `df.observe(name, ...)` on the stream, by name.
    """

    def __init__(self):
        self.batches: list[dict] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        observed = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.batches.append({"query": p.name or str(p.id), "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration, "metrics": observed})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def observed(df: DataFrame, **figures: Column) -> tuple[DataFrame, Observation]:
    """`df` with aggregates that are gathered by the action that runs it; `get` of what is returned beside it waits for that action."""
    told = Observation()
    return df.observe(told, *[column.alias(name) for name, column in figures.items()]), told
