"""Packing of documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one remainder. The histogram of the pieces' lengths, in classes of `grain` ids, is all
that the driver sees: at most capacity / grain numbers. A linear program chooses how often to use each pattern (a multiset of classes that
fits a sequence); a knapsack dynamic program prices new patterns until none, or too little, can be gained. Counts are rounded down,
what remains is filled first-fit-decreasing. The pieces of each class are ranked in Spark (by salted counts and offsets, so that a
frequent length is not one task's), and a rank leads to a sequence through the intervals that the patterns claim.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sliced, small, texts

CAPACITY = 1024
END_ID = 0


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best total value, and the numbers of each size 1..len(values) that reach it in `capacity`; values below 0 count as 0."""
    sizes = len(values)
    gain = np.maximum(values, 0)
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        n = min(c, sizes)
        options = gain[:n] + best[c - n : c][::-1]
        i = int(options.argmax())
        best[c], last[c] = options[i], i + 1
        if best[c - 1] >= best[c]:
            best[c], last[c] = best[c - 1], 0
    counts, c = np.zeros(sizes, np.int64), capacity
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def patterns(demand: np.ndarray, capacity: int, gap: float = 0.001, most: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """Patterns (numbers of each size 1..capacity) with whole counts that hold `demand` of each size exactly.

    Column generation: a revised simplex over the patterns known so far, started from one pattern for each size. It stops when no
    pattern prices out, when the bound z / price shows that z is within `gap` of the best, or after `most` pivots.
    """
    sizes = np.flatnonzero(demand) + 1
    need = demand[sizes - 1].astype(float)
    m = len(sizes)
    if not m:
        return []
    columns = np.diag((capacity // sizes).astype(float))
    cost = np.ones(m)
    inverse = np.diag(1 / np.diag(columns))
    level = inverse @ need
    for _ in range(most):
        dual = cost @ inverse
        if dual.min() < -1e-9:  # a size in surplus
            i = int(dual.argmin())
            column, price = np.zeros(m), 0.0
            column[i] = -1
        else:
            values = np.zeros(capacity)
            values[sizes - 1] = dual
            best, counts = knapsack(values, capacity)
            if best <= 1 + 1e-9 or 1 - 1 / best <= gap:
                break
            column, price = counts[sizes - 1].astype(float), 1.0
        direction = inverse @ column
        rows = np.flatnonzero(direction > 1e-9)
        if not len(rows):
            break
        ratio = level[rows] / direction[rows]
        out = rows[int(ratio.argmin())]
        step = max(float(ratio.min()), 0.0)
        level -= step * direction
        level[out] = step
        np.maximum(level, 0, out=level)
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        columns[:, out], cost[out] = column, price

    left, used = demand.astype(np.int64).copy(), []

    def use(counts: np.ndarray, times: int) -> None:
        if times > 0 and counts.any():
            left[:] -= counts * times
            used.append((counts, times))

    for j in np.argsort(-level, kind="stable"):
        if cost[j]:
            counts = np.zeros(capacity, np.int64)
            counts[sizes - 1] = np.rint(columns[:, j]).astype(np.int64)
            own = counts > 0
            use(counts, min(int(level[j] + 1e-6), int((left[own] // counts[own]).min())))
    while left.any():  # first-fit-decreasing of what is left, as often as the same pattern fits
        counts, room = np.zeros(capacity, np.int64), capacity
        for size in np.flatnonzero(left)[::-1] + 1:
            counts[size - 1] = min(int(left[size - 1]), room // size)
            room -= int(counts[size - 1]) * size
        own = counts > 0
        use(counts, int((left[own] // counts[own]).min()))
    return used


def intervals(used: list[tuple[np.ndarray, int]], classes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size 1..classes: where its ranks' intervals start, each interval's first sequence, and how many a sequence takes."""
    out: list[tuple[list, list, list]] = [([], [], []) for _ in range(classes)]
    reached, sequence = [0] * classes, 0
    for counts, times in used:
        for i in np.flatnonzero(counts):
            start, base, each = out[i]
            start.append(reached[i])
            base.append(sequence)
            each.append(int(counts[i]))
            reached[i] += int(counts[i]) * times
        sequence += times
    return [tuple(np.array(x, np.int64) for x in o) for o in out]


#: The special tokens of `byte_bpe_50k`.
SPECIAL = {"<|endoftext|>": 50_256}


@cache
def _encoder(path: str | None, special: tuple[tuple[str, int], ...]):
    """The vocabulary as a tiktoken encoding. Its ids are those of the `tokenizers` file of the same vocabulary (tested), in a third of the time."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def _pieces(path: str | None, special: tuple[tuple[str, int], ...], capacity: int):
    """Arrow batches (id, text) to one row of a document with its pieces."""

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(path, special)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))
        for part in sliced(batches):
            pieces, totals = [], []
            for text in texts(part):
                ids = np.array([*encoder.encode(text.decode("utf-8", "replace"), allowed_special="all"), END_ID], "<u4")
                pieces.append([{"start": i, "length": min(capacity, len(ids) - i), "crc": zlib.crc32(ids[i : i + capacity].tobytes())} for i in range(0, len(ids), capacity)])
                totals.append(len(ids))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(pieces, kind), pa.array(totals, pa.int64())], ["id", "pieces", "total"])

    return run


def _placed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Arrow batches (..., class, rank) with the sequence of each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            c, rank = batch.column("class").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            sequence = np.zeros(len(rank), np.int64)
            for i in np.unique(c):
                own = c == i
                start, base, each = found[i - 1]
                at = np.searchsorted(start, rank[own], "right") - 1
                sequence[own] = base[at] + (rank[own] - start[at]) // each[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("id", "start", "length", "crc", "total")), pa.array(sequence)], ["id", "start", "length", "crc", "total", "sequence_id"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grain: int = 4, path: str | None = None, special: dict[str, int] = SPECIAL, rows_per_salt: int = 100_000) -> DataFrame:
    """One row (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of a document's ids.

    A document's ids are those of its text by the vocabulary file `path` (a byte-level BPE; that of `byte_bpe_50k` by default), where the
    strings of `special` give their own ids, then id 0. start counts the document's ids before the piece, offset the sequence's; a sequence's pieces follow each other
    from 0, in at most `capacity` ids.

    Defined cases: a null text is empty and gives one piece, id 0. Each row is a document of its own, whether its id is null or repeated.
    Other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(_pieces(path, tuple(special.items()), capacity), f"id {kind}, pieces array<struct<start:long,length:long,crc:long>>, total long")
    pieces = cut(found.select("id", F.explode("pieces").alias("p"), "total").select("id", "p.start", "p.length", "p.crc", "total", F.ceil(F.col("p.length") / grain).cast("int").alias("class")))
    histogram = {x["class"]: x["count"] for x in pieces.groupBy("class").count().collect()}  # capacity / grain numbers at most
    classes = math.ceil(capacity / grain)
    demand = np.zeros(classes, np.int64)
    for c, n in histogram.items():
        demand[c - 1] = n
    found = intervals(patterns(demand, capacity // grain), classes)

    salts = max(16, math.ceil(sum(histogram.values()) / rows_per_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", "crc", "total"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("class", "salt").count()
    before = F.sum("count").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    before = cut(counts.select("class", "salt", F.coalesce(before, F.lit(0)).alias("before")))
    inside = F.row_number().over(Window.partitionBy("class", "salt").orderBy("id", "start", "crc", "total"))
    ranked = salted.withColumn("inside", inside).join(small(before), ["class", "salt"]).withColumn("rank", (F.col("inside") - 1 + F.col("before")).cast("long"))
    placed = ranked.select("id", "start", "length", "crc", "total", "class", "rank").mapInArrow(_placed(found), f"id {kind}, start long, length long, crc long, total long, sequence_id long")
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "crc", "total").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")
    return placed.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), "sequence_id", offset.alias("offset"))
