from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold(index: Column, k: int, eps: float) -> Column:
    """(1 + eps) ** index / (2 k): the gain that a set of this index asks for."""
    return F.pow(F.lit(1 + eps), index) / (2 * k)


def lowest_index(most: Column, eps: float) -> Column:
    """The lowest index that is kept when `most` is the largest reward of one node so far."""
    return F.floor(F.log((1 - eps) * most) / F.log(F.lit(1 + eps))).cast("long")


def highest_index(most: Column, k: int, eps: float) -> Column:
    return F.ceil(F.log(2 * k * most) / F.log(F.lit(1 + eps))).cast("long")


def activation(multiplicity: Column) -> Column:
    """The probability that a pair met `multiplicity` times influences: 2 / (1 + exp(-x / 5)) - 1."""
    return 2 / (1 + F.exp(-0.2 * multiplicity)) - 1


def uniform(*parts: Column) -> Column:
    """A whole number below 2**32 drawn by a hash of the parts, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def coin(probability: Column, *parts: Column) -> Column:
    """Whether a coin of this probability falls on heads; each value of the parts has its own coin."""
    return uniform(*parts) / 4294967296.0 < probability
