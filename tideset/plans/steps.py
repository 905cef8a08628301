"""Cutting lineage in loops, and broadcasts behind a check of size."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

BROADCAST = 32 << 20


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="tideset-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's (`spark.checkpoint.dir`). Only a local session that sets none, as in tests, gets a temporary one.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Kept:
    """A table that grows by deltas, each kept as it comes. `FAN` parts of one size class become one of the next, so a row is written again a few times at most."""

    FAN = 4

    def __init__(self, first: DataFrame):
        self._parts = [(0, first)]

    def add(self, delta: DataFrame) -> None:
        """Add a kept delta."""
        self._parts.append((0, delta))
        while len(self._parts) >= self.FAN and self._parts[-1][0] == self._parts[-self.FAN][0]:
            merged = [self._parts.pop() for _ in range(self.FAN)]
            self._parts.append((merged[0][0] + 1, cut(reduce(DataFrame.unionByName, [df for _, df in merged]))))

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [df for _, df in self._parts])


def _width(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType, MapType)):
        return F.greatest(F.size(column), F.lit(0)) * 8 + 24
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column.alias("x")))), F.lit(0)) + 24
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """`df` with a broadcast hint if its rows take at most `most` bytes, else as it is, so that a join shuffles it. Call it on a checkpoint."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the folder that the driver and all executors share (see `cut`)."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
