"""The lifetime window on an unbounded stream (t, u, v, l): each venue's reward as rows come and die."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Lives(StatefulProcessor):
    """Of one venue: its live users with the step at which each is gone, and a timer for each such step.

    A call to the state store is a round trip, so a micro-batch takes its rows in memory and stores only what it leaves changed: users that come and go within it never
    reach the store, and have no timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getMapState("ends", "u long", "gone long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._stored()
        held, queue = dict(before), self._queued(before)
        told: dict[int, int] = {}
        parts = [part[["t", "u", "l"]] for part in rows]
        for t, u, life in pd.concat(parts).sort_values("t").itertuples(index=False):
            t, u, gone = int(t), int(u), int(t + life)
            self._expire(held, queue, t, told)
            if gone > held.get(u, 0):
                held[u] = gone
                heappush(queue, (gone, u))
            told[t] = len(held)
        self._store(before, held)
        if told:
            yield self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._stored()
        held = dict(before)
        told: dict[int, int] = {}
        self._expire(held, self._queued(before), expiredTimerInfo.getExpiryTimeInMs() // 1000, told)
        self._store(before, held)
        if told:
            yield self._rows(key, told)

    def _stored(self) -> dict[int, int]:
        return {u[0]: gone[0] for u, gone in self.ends.iterator()}

    @staticmethod
    def _queued(held: dict[int, int]) -> list[tuple[int, int]]:
        return sorted((gone, u) for u, gone in held.items())

    def _store(self, before: dict[int, int], held: dict[int, int]) -> None:
        for u in before.keys() - held.keys():
            self.ends.removeKey((u,))
        fresh = {u: gone for u, gone in held.items() if before.get(u) != gone}
        for u, gone in fresh.items():
            self.ends.updateValue((u,), (gone,))
        for gone in set(fresh.values()):
            self.handle.registerTimer(gone * 1000)

    def close(self) -> None:
        pass

    @staticmethod
    def _expire(held: dict[int, int], queue: list[tuple[int, int]], step: int, told: dict[int, int]) -> None:
        """Drop the users gone at `step` or before, and tell the reward at each of these steps; a user who came again stands in the queue more than once."""
        while queue and queue[0][0] <= step:
            gone, u = heappop(queue)
            if held.get(u) == gone:
                del held[u]
                told[gone] = len(held)

    @staticmethod
    def _rows(key, told: dict[int, int]) -> pd.DataFrame:
        return pd.DataFrame({"v": [key[0]] * len(told), "n": list(told), "reward": list(told.values())})


def live_rewards(stream: DataFrame, lag: int = 0) -> DataFrame:
    """(v, n, reward) of a streaming DataFrame (t, u, v, l): a venue's distinct live users at each step n at which it gets a row or loses a user (append mode).

    A row lives through the steps t, ..., t + l - 1. Steps are the stream's event time; rows may come late by `lag` steps, and a step without rows of a venue is told once the
    watermark has passed it. A venue's state is its live users, kept in the state store (RocksDB: spark.sql.streaming.stateStore.providerClass), so a
    restarted query goes on where it stopped. Within a micro-batch rows are taken by t.
    """
    timed = stream.select("t", "u", "v", "l", F.timestamp_seconds("t").alias("at")).withWatermark("at", f"{lag} seconds")
    return timed.groupBy("v").transformWithStateInPandas(statefulProcessor=_Lives(), outputStructType="v long, n long, reward long", outputMode="Append", timeMode="EventTime")
