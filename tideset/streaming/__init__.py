"""Structured Streaming forms of the operators."""

from .live import alive_counts, run_stream
from .lives import live_rewards
from .sieves import KeptSieve, keep_sieve, sieved

__all__ = ["KeptSieve", "alive_counts", "keep_sieve", "live_rewards", "run_stream", "sieved"]
