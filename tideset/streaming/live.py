"""Solvers and rewards on unbounded streams (key, t, u, v, l) with Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pruned_list import SCHEMA, PrunedList


def run_stream(stream: DataFrame, k: int, eps: float, reward: str = "coverage", key_col: str = "key", idle: str | None = None) -> DataFrame:
    """The rows of `operators.pruned_list.run_list` of a streaming DataFrame, for each key as its rows arrive (append mode).

    The state of a key (live rows and sieves) is kept in Spark's state store and survives restarts; with `idle` (milliseconds) a key without rows for
    so long is forgotten. Within a micro-batch rows are sorted by t; a row that does not come after all others of its key is late: it
    changes nothing and is returned with nulls, so that late rows can be counted.
    """
    kind = dict(stream.dtypes)[key_col]

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, clock = pickle.loads(state.get[0]) if state.exists else (PrunedList(k, eps, reward), 0)
        out = []
        for t, u, v, life in pd.concat(list(batches)).sort_values("t")[["t", "u", "v", "l"]].itertuples(index=False):
            if t > clock:
                value, nodes, calls, n = held.step(t, u, v, life)
                out.append((key[0], t, value, list(nodes), calls, n))
                clock = t
            else:
                out.append((key[0], t, None, None, None, None))
        state.update((pickle.dumps((held, clock)),))
        if idle:
            state.setTimeoutDuration(int(idle))
        rows = pd.DataFrame(out, columns=[key_col, "t", "value", "nodes", "calls", "n_sieves"])
        yield rows.astype({"value": "Int64", "calls": "Int64", "n_sieves": "Int32"})

    timeout = "ProcessingTimeTimeout" if idle else "NoTimeout"
    return stream.groupBy(key_col).applyInPandasWithState(handle, f"{key_col} {kind}, {SCHEMA}", "state binary", "append", timeout)


def alive_counts(stream: DataFrame, time_col: str, lag: str, window: str) -> DataFrame:
    """(start, end, v, n): arrivals for each venue and time window, late by `lag` at most; a constant lifetime makes sliding windows of these."""
    windows = stream.withWatermark(time_col, lag).groupBy(F.window(time_col, window).alias("w"), "v").agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "v", "n")
