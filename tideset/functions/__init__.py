"""Scalar functions of columns: thresholds, activation probabilities, reproducible coins."""

from .scalars import activation, coin, highest_index, lowest_index, threshold, uniform

__all__ = ["activation", "coin", "highest_index", "lowest_index", "threshold", "uniform"]
