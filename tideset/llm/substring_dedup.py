"""Removal of words that stand in repeated windows, by super-k-mer partitioning.

A window is `window` consecutive words of one document. Its minimiser is the run of `gram` words in it with the least hash, the last of equals, so equal
windows have equal minimisers at equal places. Consecutive windows of one minimiser form a super-k-mer: the words from the first window's start to the last one's
end, at most `window` - `gram` + 1 windows, so a 64-bit mask tells which of them repeat.

Minimisers are counted first (a combined aggregate, so copies shrink where they lie): one that stands once repeats nothing, and where all super-k-mers of a minimiser are
alike, by 128 bits of hashes, all their windows repeat. Only of a minimiser that has different super-k-mers does one packed string of each travel to the minimiser's bucket, where
windows are sorted and counted by their bytes, each with its super-k-mer's count. Buckets are made as the strings need them. A minimiser with more than `most` different
strings (the rims of a passage that very many documents hold) is split over buckets; a window that a part holds once is then compared with
the other parts' windows by two independent hashes, a row for each window and part.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import Runs, cut, exact_hashes, sliced, texts, word_spans
from .line_dedup import minima


class SuperKmers:
    """The super-k-mers of a text: `first` and `last` window, minimiser `mini` and hash `whole` of each; `words`: those of the text."""

    def __init__(self, text: bytes, window: int, gram: int):
        self.packed = b" ".join(text.split())  # bytes split at \x20 and \x09-\x0D
        self.window = window
        hashes = exact_hashes(self.packed)
        self.words = len(hashes)
        self.windows = max(0, self.words - window + 1)
        self.first = self.last = np.zeros(0, np.int64)
        self.mini = self.whole = np.zeros(0, np.int64)
        if self.windows:
            runs = Runs(hashes)
            chosen = minima(runs.grams(gram), window - gram + 1)
            self.first = np.flatnonzero(np.diff(chosen, prepend=-1))
            self.last = np.append(self.first[1:], self.windows) - 1
            place = chosen[self.first]
            self.mini = runs.of(place, place + gram).view(np.int64)
            self.whole = runs.of(self.first, self.last + window).view(np.int64)

    def strings(self, which: np.ndarray) -> list[bytes]:
        """The packed strings of some super-k-mers."""
        start, end = word_spans(self.packed)
        return [self.packed[start[a] : end[b + self.window - 1]] for a, b in zip(self.first[which], self.last[which], strict=True)]

    def covered(self, whole: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Which words the windows cover that the masks of super-k-mers (named by their hashes) tell; -1 tells all."""
        edges = np.zeros(self.words + 1, np.int64)
        order = np.argsort(whole)
        at = np.minimum(np.searchsorted(whole, self.whole, sorter=order), len(whole) - 1)
        held = np.flatnonzero(whole[order[at]] == self.whole)
        masks = mask[order[at[held]]].view(np.uint64)
        size = self.last[held] - self.first[held] + 1
        row = np.repeat(np.arange(len(held)), size)
        bit = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = (self.first[held][row] + bit)[(masks[row] >> bit.astype(np.uint64)) & np.uint64(1) == 1]
        np.add.at(edges, start, 1)
        np.add.at(edges, start + self.window, -1)
        return np.cumsum(edges)[:-1] > 0


def _found(window: int, gram: int):
    """Arrow batches (k1, k2, text) to (k1, k2, mini, whole, n) of the different super-k-mers of each text, with how often each stands there."""

    def run(batches):
        import pyarrow as pa

        longs = pa.list_(pa.int64())
        for batch in sliced(batches):
            columns: list[list] = [[], [], []]
            for text in texts(batch):
                found = SuperKmers(text, window, gram)
                pairs, counts = np.unique(np.stack([found.mini, found.whole], 1), axis=0, return_counts=True) if found.windows else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
                for column, values in zip(columns, (pairs[:, 0], pairs[:, 1], counts), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *(pa.array(c, longs) for c in columns)], ["k1", "k2", "mini", "whole", "n"])

    return run


def _zipped(batches):
    """Arrow batches (k1, k2, row, text) with their texts compressed."""
    import pyarrow as pa
    import zstandard

    zip_one = zstandard.ZstdCompressor(level=3).compress
    for batch in sliced(batches):
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "row")), pa.array([zip_one(t) for t in texts(batch)], pa.binary())], ["k1", "k2", "row", "text"])


def _unzipped(batch):
    import zstandard

    unzip_one = zstandard.ZstdDecompressor().decompress
    return (unzip_one(t) for t in batch.column("text").to_pylist())


def _packed(window: int, gram: int):
    """Arrow batches (text, asked), the text compressed, to a row (mini, whole, n, part, parts, packed) for each super-k-mer asked for."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("mini", pa.int64()), ("whole", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("packed", pa.binary())])
        for batch in sliced(batches):
            for text, asked in zip(_unzipped(batch), batch.column("asked").to_pylist(), strict=True):
                found = SuperKmers(text, window, gram)
                at = {x: i for i, x in enumerate(found.whole.tolist())}
                which = np.array([at[x["whole"]] for x in asked], np.int64)
                rows = [{**x, "packed": packed} for x, packed in zip(asked, found.strings(which), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def repeated(packed: list[bytes], n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The windows of packed strings that stand n times each: (row, bit, count, bytes), sorted so that equal windows are neighbours; count is of all equal ones."""
    words = np.array([s.count(b" ") + 1 for s in packed])
    joined = b" ".join(packed)
    start, end = word_spans(joined)
    size = words - window + 1
    row = np.repeat(np.arange(len(packed)), size)
    bit = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = (np.cumsum(words) - words)[row] + bit
    hashes = Runs(exact_hashes(joined)).of(at, at + window)
    order = np.argsort(hashes, kind="stable")
    row, bit, at, hashes = row[order], bit[order], at[order], hashes[order]
    held = [joined[a:b] for a, b in zip(start[at].tolist(), end[at + window - 1].tolist(), strict=True)]
    starts = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
    # windows of one hash are compared by their bytes; if some differ, the bytes sort them
    apart = [a for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(held)], strict=True) if b - a > 1 and held[a:b].count(held[a]) < b - a]
    if apart:
        order = np.array(sorted(range(len(held)), key=lambda i: (int(hashes[i]), held[i])))
        row, bit, held = row[order], bit[order], [held[i] for i in order]
        starts = np.array([i for i in range(len(held)) if not i or held[i] != held[i - 1]])
    count = np.add.reduceat(n[row], starts)
    return row, bit, np.repeat(count, np.diff(starts, append=len(held))), held


def _counted(window: int):
    """A bucket's table (mini, whole, n, part, parts, packed) to rows (mini, whole, mask), and (w1, w2, alone, ...) of the windows of split minimisers."""

    def run(key, table):
        import pyarrow as pa

        mini, whole, n, part, parts = (table.column(c).to_numpy() for c in ("mini", "whole", "n", "part", "parts"))
        packed = table.column("packed").to_pylist()
        # repeated rows were asked for once each: they count once here
        once = np.unique(np.stack([mini, whole], 1), axis=0, return_index=True)[1]
        mini, whole, n, part, parts, packed = mini[once], whole[once], n[once], part[once], parts[once], [packed[i] for i in once]
        masks = np.zeros(len(once), np.uint64)
        group = np.unique(np.stack([mini, part], 1), axis=0, return_inverse=True)[1].ravel()
        split = parts > 1
        out = []
        for each in [np.flatnonzero(~split), *(np.flatnonzero(group == g) for g in np.unique(group[split]))]:
            if not len(each):
                continue
            row, bit, count, held = repeated([packed[i] for i in each], n[each], window)
            again = count > 1
            np.bitwise_or.at(masks, each[row[again]], np.uint64(1) << bit[again].astype(np.uint64))
            if split[each[0]]:
                first = [i for i in range(len(held)) if not i or held[i] != held[i - 1]]
                for i in first:
                    digest = blake2b(held[i], digest_size=16).digest()
                    own = each[row[i]]
                    out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), not again[i], int(mini[own]), int(whole[own]), int(bit[i])))
        marked = np.flatnonzero(masks)
        k = len(marked)
        columns = list(zip(*out, strict=True)) or [()] * 6
        none = [None] * k
        return pa.table(
            {
                "mini": pa.array([*mini[marked].tolist(), *columns[3]], pa.int64()),
                "whole": pa.array([*whole[marked].tolist(), *columns[4]], pa.int64()),
                "mask": pa.array([*masks[marked].view(np.int64).tolist(), *[None] * len(out)], pa.int64()),
                "w1": pa.array([*none, *columns[0]], pa.int64()),
                "w2": pa.array([*none, *columns[1]], pa.int64()),
                "alone": pa.array([*none, *columns[2]], pa.bool_()),
                "bit": pa.array([*none, *columns[5]], pa.int32()),
            }
        )

    return run


def _kept(window: int, gram: int):
    """Arrow batches (row, text, marks), the text compressed, to (row, text, n_words, n_removed)."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            kept, n_words, n_removed = [], [], []
            for text, marks in zip(_unzipped(batch), batch.column("marks").to_pylist(), strict=True):
                if not marks:
                    words = text.split()
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                    n_words.append(len(words))
                    n_removed.append(0)
                    continue
                found = SuperKmers(text, window, gram)
                gone = found.covered(np.array([m["whole"] for m in marks], np.int64), np.array([m["mask"] for m in marks], np.int64))
                words = found.packed.split(b" ")
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone)]).decode("utf-8", "replace"))
                n_words.append(found.words)
                n_removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["row", "text", "n_words", "n_removed"])

    return run


def _marks(named: DataFrame, zipped: DataFrame, window: int, gram: int, most: int, each: int) -> DataFrame:
    """(k1, k2, marks) of the texts of `named` (k1, k2, text) that hold repeated windows: marks lists (whole, mask) of their super-k-mers.

    All joins are of tables that grow with the texts and have no hints, so their form is one at any size, and Spark splits the rows of a common minimiser.
    """
    found = named.mapInArrow(_found(window, gram), "k1 long, k2 long, mini array<long>, whole array<long>, n array<long>")
    single = found.select("k1", "k2", F.explode(F.arrays_zip("mini", "whole", "n")).alias("x")).select("k1", "k2", "x.mini", "x.whole", "x.n")
    minis = single.groupBy("mini").agg(F.sum("n").alias("total"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("total > 1")
    minis = cut(minis.select("mini", (F.col("low") != F.col("high")).alias("mixed")))
    held = cut(single.join(minis, "mini"))  # the super-k-mers whose minimiser stands at several places
    alike = held.where("NOT mixed").select("k1", "k2", "whole", F.lit(-1).cast("long").alias("mask"))

    mixed = held.where("mixed").drop("mixed")
    strings = cut(mixed.groupBy("mini", "whole").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2")).alias("s")))
    parts = strings.groupBy("mini").agg(F.ceil(F.count("*") / most).cast("long").alias("parts"))
    dealt = strings.join(parts, "mini").withColumn("part", F.pmod("whole", "parts"))
    asked = cut(dealt.groupBy("s").agg(F.collect_list(F.struct("mini", "whole", "n", "part", "parts")).alias("asked")).select("s.k1", "s.k2", "asked"))
    total = strings.count()
    kinds = "mini long, whole long, n long, part long, parts long, packed binary"
    sent = zipped.select("k1", "k2", "text").join(asked, ["k1", "k2"]).select("text", "asked").mapInArrow(_packed(window, gram), kinds)
    bucket = F.pmod(F.xxhash64("mini", "part"), F.lit(max(1, math.ceil(total / each))))
    counted = cut(sent.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_counted(window), "mini long, whole long, mask long, w1 long, w2 long, alone boolean, bit int"))

    parted = counted.where("w1 IS NOT NULL")
    across = parted.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    late = parted.where("alone").join(across, ["w1", "w2"]).select("mini", "whole", F.expr("shiftleft(1L, bit)").alias("mask"))
    masks = cut(counted.where("mask IS NOT NULL").select("mini", "whole", "mask").union(late).groupBy("mini", "whole").agg(F.bit_or("mask").alias("mask")))
    marked = alike.union(mixed.join(masks, ["mini", "whole"]).select("k1", "k2", "whole", "mask"))
    return cut(marked.groupBy("k1", "k2").agg(F.collect_set(F.struct("whole", "mask")).alias("marks")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8, most: int = 4096, each: int = 8192, words_col: str = "n_words", removed_col: str = "n_removed") -> DataFrame:
    """The rows of `docs` with, in text_col, the words that no repeated window covers, joined by one space, and how many words the text had and lost.

    A window (words `[^\\x20\\x09-\\x0D]+`, as they are) is repeated if its sequence of words starts at another place too, in any document or its own: all its
    places go, the first too. Windows are judged on the texts as given. `most` is how many different super-k-mers of a minimiser a bucket takes, `each`
    about how many a bucket holds.

    Defined cases: a null text has no words and gives an empty one. Every row is a document of its own, so a repeated row repeats all windows of its twin,
    and null ids are ids like others (rows are told apart by id and text, and rows of equal ones get the same result). A text of fewer words than a
    window keeps all. Other columns stay as they are; those named as the new ones are replaced.
    """
    if not 0 < gram <= window < gram + 63:
        raise ValueError("a super-k-mer's windows must fit a mask of 63 bits")
    docs = docs.drop(words_col, removed_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = [F.xxhash64(F.lit(i), F.col(f"`{id_col}`"), text).alias(f"k{i}") for i in (1, 2)]
    source = docs.select(*key, text.alias("text"), row)
    kinds = StructType([*(source.schema[c] for c in ("k1", "k2", "row")), StructField("text", BinaryType())])
    zipped = source.select("k1", "k2", "row", "text").mapInArrow(_zipped, kinds)  # texts are shuffled twice, so they travel compressed
    # rows of equal id and text have one key: their super-k-mers count as often as they stand there
    marks = _marks(source.select("k1", "k2", "text"), zipped, window, gram, most, each)
    kinds = StructType([source.schema["row"], StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    done = zipped.join(marks, ["k1", "k2"], "left").select("row", "text", "marks").mapInArrow(_kept(window, gram), kinds)
    own = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*own, F.col("n_words").alias(words_col), F.col("n_removed").alias(removed_col))
