"""What several operators share: words and their hashes, Arrow batches, connected components; checkpoints and checked broadcasts as in `plans`."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import cut, small
from ..plans.steps import BROADCAST

__all__ = ["LOWER", "UPPER", "WHITE", "Runs", "connected", "cut", "exact_hashes", "grams", "mix", "sliced", "small", "small_batches", "texts", "unused", "word_hashes", "word_spans", "words"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased; null: none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WHITE), lambda w: w != "")


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores as it takes to clash with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of runs of a sequence of hashes: polynomials modulo 2**64, by differences of prefix sums, divided by the odd base's power where the run begins."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self.powers = _powers(n, 0x9E3779B97F4A7C15)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes) * up, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the runs [start, end), none of them empty."""
        return mix((self.sums[end] - self.sums[start]) * self.powers[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each run of length k, for k up to the sequence's length."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.powers[: len(self.sums) - k] + np.uint64(k))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes; of the whole sequence if it is shorter; none if it is empty."""
    return Runs(hashes).grams(min(k, len(hashes))) if len(hashes) else hashes


_BASE = 0xD6E8FEB86659FD93  # odd
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BLOCK = 1 << 20


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 14)
        _POWERS[base] = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = mix(np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + np.uint64(1))
_AS_THEY_ARE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def word_hashes(text: bytes, letters: np.ndarray = _LETTERS) -> np.ndarray:
    """A hash of each word `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, A-Z lower-cased, the same in every process; `letters` gives a number to each byte.

    A word's hash is a polynomial of its bytes modulo 2**64, taken as a difference of prefix sums; long texts go in blocks that end at white space.
    """
    parts, at = [], 0
    while len(text) - at > _BLOCK:
        end = at + _BLOCK
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        parts.append(_hashed(text[at:end], letters))
        at = end
    parts.append(_hashed(text[at:], letters))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def exact_hashes(text: bytes) -> np.ndarray:
    """`word_hashes` of words as they are."""
    return word_hashes(text, _AS_THEY_ARE)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of UTF-8 bytes starts and ends."""
    edge = np.empty(len(text) + 2, bool)
    edge[0] = edge[-1] = True
    np.take(_SPACE, np.frombuffer(text, np.uint8), out=edge[1:-1])
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    return turns[::2], turns[1::2]


def _hashed(text: bytes, letters: np.ndarray) -> np.ndarray:
    n = len(text)
    if not n:
        return np.zeros(0, np.uint64)
    start, end = word_spans(text)
    up, down = _powers(n + 1, _BASE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[np.frombuffer(text, np.uint8)] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def sliced(batches, rows: int = 256):
    """Arrow batches cut to at most `rows` rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches take `BATCH` bytes or one row; a lower setting stays.

    An executor holds a batch outside its heap, and twice while it grows, and its worker holds it too. By default it takes 10,000 rows of up to 64 MB.
    What a query returns is not touched, only into how many batches its rows are cut.
    """
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", spark.conf.get(_BYTES).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH:
        spark.conf.set(_BYTES, f"{BATCH}b")


def texts(batch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of an Arrow batch's text column; null: empty."""
    import pyarrow as pa

    return (x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist())


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of undirected `edges` (a, b): one row (node, component) for each node, component its smallest node.

    Alternates large-star and small-star steps (Kiveris and others, 2014) until every node hangs on one root. No step makes more edges than there
    are, so one check of size tells whether the least neighbours, taken by a combined aggregate, come back by a broadcast; else the
    join shuffles both sides and Spark splits a hub's rows.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    few = edges.count() * 64 <= BROADCAST

    def star(pairs: DataFrame) -> DataFrame:
        """pairs (u, v): with m, the least of u and its v's."""
        least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        return pairs.join(F.broadcast(least) if few else cut(least), "u").select("u", "v", "m")

    while True:
        ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = cut(star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        starred = star(large)
        edges = cut(starred.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
