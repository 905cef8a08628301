"""Removal of runs of text that repeat, by winnowing.

The hashes that are winnowed are of word lines: the `k` words from each position on, whatever the line breaks, since
repeated passages often begin and end inside a line. Of each window of `w` consecutive hashes, which is a run of min_run = w + k - 1 words, the least
one (the last of equals) is selected. A window that stands at two places selects the same fingerprint there, so repeats are sought among the places
of shared fingerprints only.

A place stands for all the windows that select it, which follow each other: its span is the fingerprint, extended both ways to the first
word of the first of these windows and to the last word of the last. Places of one fingerprint whose spans are equal hold the same windows: all but the first
place are repeats as they are. Where spans of one fingerprint differ, at the rims of repeated passages, the first place of each span
is opened, and the hashes of its single windows are compared instead. So exactly the windows that stand at an earlier place are found, each by two hashes
of 64 bits, and texts are never sent to other texts. The words of these windows are deleted; the first occurrence stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import Runs, cut, mix, sliced, small, texts, word_hashes, word_spans


def minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the position of its least one, the last of equals; none if there are fewer than w.

    Compares the upper 40 bits, with the position (later is less) below them; each window's minimum is that of two prefix or suffix minima of blocks.
    """
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    found = []
    for at in range(0, n - w + 1, 1 << 23):  # positions must fit their bits
        part = hashes[at : at + (1 << 23) + w - 1]
        size = len(part)
        padded = np.full(-(-size // w) * w, np.uint64(2**64 - 1))
        padded[:size] = part & ~low | low - np.arange(size, dtype=np.uint64)
        blocks = padded.reshape(-1, w)
        before = np.minimum.accumulate(blocks, 1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(after[: size - w + 1], before[w - 1 : size])
        found.append((low - (least & low)).astype(np.int64) + at)
    return np.concatenate(found)


def select(hashes: np.ndarray, w: int) -> np.ndarray:
    """The positions that windows of w hashes select, each once."""
    places = minima(hashes, w)
    return places[np.flatnonzero(np.diff(places, prepend=-1))]


class Winnowed:
    """A text's selected places `p` in ascending order, and the first and the last window that select each; `windows`: how many there are."""

    def __init__(self, text: bytes, k: int, w: int):
        hashes = word_hashes(text)
        self.words, self.length = len(hashes), k + w - 1
        self.windows = max(0, self.words - self.length + 1)
        if self.windows:
            self.runs = Runs(hashes)
            self.grams = self.runs.grams(k)
            chosen = minima(self.grams, w)
            self.first = np.flatnonzero(np.diff(chosen, prepend=-1))
            self.last = np.append(self.first[1:], self.windows) - 1
            self.p = chosen[self.first]

    def spans(self) -> np.ndarray:
        """The hashes of the places' spans, and of where in it the fingerprint stands."""
        return mix(self.runs.of(self.first, self.last + self.length) + (self.p - self.first).astype(np.uint64))


def _place_rows(batch, f, c, p, own):
    import pyarrow as pa

    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(f, longs), pa.array(c, longs), pa.array(p, pa.list_(pa.int32())), pa.array(own, pa.bool_())], ["id", "h", "f", "c", "p", "own"])


def _fingerprints(k: int, w: int):
    """Arrow batches (id, h, text) to (id, h, f, c, p, own): fingerprints, spans and places; of places of equal span in one text the first only.

    own: whether the text holds a fingerprint twice, as each does that repeats a window of its own.
    """

    def run(batches):
        for batch in sliced(batches):
            f, c, p, own = [], [], [], []
            for text in texts(batch):
                found = Winnowed(text, k, w)
                if not found.windows:
                    for column in (f, c, p):
                        column.append(())
                    own.append(False)
                    continue
                prints, spans = found.grams[found.p], found.spans()
                own.append(len(set(prints.tolist())) < len(prints))
                once = np.sort(np.unique(prints ^ mix(spans), return_index=True)[1]) if own[-1] else slice(None)
                f.append(prints[once].view(np.int64))
                c.append(spans[once].view(np.int64))
                p.append(found.p[once].astype(np.int32))
            yield _place_rows(batch, f, c, p, own)

    return run


def _windows(k: int, w: int):
    """Arrow batches (id, h, text, asked) to (id, h, f, c, p, own) of the single windows that select the places asked for: p is a window's first word."""

    def run(batches):
        for batch in sliced(batches):
            f, c, p = [], [], []
            for text, asked in zip(texts(batch), batch.column("asked").to_pylist(), strict=True):
                found = Winnowed(text, k, w)
                which = np.searchsorted(found.p, np.unique(asked))
                size = found.last[which] - found.first[which] + 1
                start = np.repeat(found.first[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
                f.append(np.repeat(found.grams[found.p[which]], size).view(np.int64))
                c.append(found.runs.of(start, start + found.length).view(np.int64))
                p.append(start.astype(np.int32))
            yield _place_rows(batch, f, c, p, [None] * len(f))

    return run


def repeats(text: bytes, places: list[int], own: bool, k: int, w: int) -> list[tuple[int, int]]:
    """The runs of words [a, b) of the windows in `places` (first words, or ~p for all windows that select p) and, with `own`, of those that the text itself repeats."""
    found = Winnowed(text, k, w)
    if not found.windows:
        return []
    marked = np.zeros(found.windows, bool)
    if own:
        marked[:] = True
        marked[np.unique(found.runs.grams(found.length), return_index=True)[1]] = False
    given = np.array(places, np.int64)
    marked[given[given >= 0]] = True
    which = np.searchsorted(found.p, ~given[given < 0])
    edges = np.zeros(found.words + 1, np.int64)
    np.add.at(edges, found.first[which], 1)
    np.add.at(edges, found.last[which] + found.length, -1)
    own = np.flatnonzero(marked)
    np.add.at(edges, own, 1)
    np.add.at(edges, own + found.length, -1)
    turns = np.flatnonzero(np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0, append=0))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the runs of words [a, b), which ascend and do not touch. A line break beside a run stays."""
    if not runs:
        return text
    start, end = word_spans(text)
    out, at = [], 0
    for a, b in runs:
        before = text[end[a - 1] if a else 0 : start[a]]
        after = text[end[b - 1] : start[b] if b < len(start) else len(text)]
        out.append(text[at : start[a] - len(before)])
        if a and b < len(start):
            out.append(before if b"\n" in before else after)
        at = end[b - 1] + len(after)
    return b"".join([*out, text[at:]])


def _delete(k: int, w: int):
    def run(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in sliced(batches):
            kept, spans = [], []
            for text, places, own in zip(texts(batch), batch.column("places").to_pylist(), batch.column("own").to_pylist(), strict=True):
                runs = repeats(text, places, own, k, w)
                kept.append(without(text, runs).decode("utf-8", "replace"))
                spans.append([{"start": a, "length": b - a} for a, b in runs])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), pa.array(spans, kinds)], ["row", "text", "removed"])

    return run


def _later(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, h, f, c, p): the first place (f, c, s, n) of each f and c, and the rows (id, h, p) that stand at another one."""
    firsts = cut(rows.groupBy("f", "c").agg(F.min(F.struct("id", "h", "p")).alias("s"), F.count("*").alias("n")))
    again = cut(firsts.where("n > 1").select("f", "c", "s"))
    return firsts, rows.join(again, ["f", "c"]).where("NOT (id = s.id AND h = s.h AND p = s.p)").select("id", "h", "p")


def _places(named: DataFrame, kind: str, k: int, w: int) -> DataFrame:
    """(id, h, places, own) of the texts of `named` (id, h, text) that hold repeats; places as in `repeats`."""
    # places are joined without hints: both sides are kept tables, so Spark splits a common fingerprint's rows or broadcasts a side by its measured size
    kinds = f"id {kind}, h long, f array<long>, c array<long>, p array<int>, own boolean"
    single = lambda df: df.select("id", "h", F.explode(F.arrays_zip("f", "c", "p")).alias("x")).select("id", "h", "x.f", "x.c", "x.p")
    winnowed = cut(named.mapInArrow(_fingerprints(k, w), kinds))
    held = single(winnowed)
    shared = cut(held.groupBy("f").count().where("count > 1").select("f"))
    met = cut(held.join(shared, "f", "left_semi"))
    firsts, later = _later(met)

    # fingerprints with several spans: their windows one by one
    mixed = cut(firsts.groupBy("f").count().where("count > 1").select("f"))
    asked = firsts.join(mixed, "f", "left_semi").select("s.id", "s.h", "s.p")
    asked = cut(asked.groupBy("id", "h").agg(F.collect_list("p").alias("asked")))
    opened = single(cut(named.join(small(asked), ["id", "h"]).mapInArrow(_windows(k, w), kinds)))
    _, single_later = _later(opened)

    own = F.lit(False).alias("own")
    found = later.select("id", "h", (-F.col("p") - 1).alias("p"), own).union(single_later.select("id", "h", "p", own)).union(winnowed.where("own").select("id", "h", F.lit(None).cast("int"), "own"))
    return cut(found.groupBy("id", "h").agg(F.collect_set("p").alias("places"), F.max("own").alias("own")))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 50, removed_col: str = "removed", count_col: str = "n_removed") -> DataFrame:
    """The rows of `docs` with their texts (in text_col) without later repeated runs, and two columns more, removed_col and count_col.

    A run is `min_run` words or more (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) that stand, in the same order, at an earlier place:
    in a document of a smaller id, or earlier in the same text; every such run goes. removed_col lists start and length of the deleted runs,
    counted in words; count_col is how many words they hold.

    Defined cases: a null text gives an empty one. A row with a null id is left as it is and is no source. Rows of equal id and
    text are one document and get the same result; rows of equal id and other text are ordered by a hash of their text.
    A text that is wholly a repeat becomes empty. Other columns stay as they are; those named as the new ones are replaced.
    """
    docs = docs.drop(removed_col, count_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row).withColumn("h", F.xxhash64("text"))
    k = min_run // 2 + 1
    w = min_run - k + 1
    places = _places(source.where("id IS NOT NULL").select("id", "h", "text"), docs.schema[id_col].dataType.simpleString(), k, w)
    asking = source.join(small(places), ["id", "h"], "left").select("row", "text", "places", "own")
    spans = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType())]))
    kinds = StructType([source.schema["row"], StructField("text", StringType()), StructField("removed", spans)])
    done = asking.where("places IS NOT NULL").mapInArrow(_delete(k, w), kinds).union(asking.where("places IS NULL").select("row", "text", F.array().cast(spans)))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r.length)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("removed").alias(removed_col), n_removed.alias(count_col))
