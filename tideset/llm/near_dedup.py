"""MinHash near-deduplication with odd sketches.

Each text's set of word shingles gets a MinHash sample and two odd sketches: bitmaps in which each sampled value flips one bit, so that the
population count of their XOR tells how many values differ. The coarse one folds the sample whose bands make the buckets into 256 bits; the
finer one folds up to 512 values (the least in each bin of one permutation) into 1024 bits, where the estimate has a standard deviation of 0.024.
Bands propose pairs, sketches rule out those more than 4 deviations from a link, and full sets confirm the rest. Texts with equal
sets form a class that takes part once.

Buckets never emit all their pairs:

1. Each bucket's members meet its member of the least id. That ties most groups of copies together, at one pair for each member.
2. A pair that is still apart meets in a bucket that holds several components. Such a bucket is cut into blocks, and each pair of blocks is a group of its own
   in which sketches are compared without rows for pairs; members of the bucket's largest component are not compared with each other. What the
   sketches leave returns as rows of single documents.
3. These documents meet again in the same groups with their full sets, and each group returns a spanning forest of its links.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, cut, grams, mix, sliced, small, texts, word_hashes

BITS = 256
BINS, FINE = 512, 1024


ATTRIBUTES = "id long, n long, hi long, lo long, bands array<long>, sketch array<long>, fine array<long>, samples long"


def _folded(values: np.ndarray, bits: int) -> np.ndarray:
    """The odd sketch of hashed values, as 64-bit words."""
    return np.packbits((np.bincount((values % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _finer(found: np.ndarray) -> tuple[np.ndarray, int]:
    """The finer odd sketch of a set of shingles, and how many values it folds."""
    ordered = np.sort(mix(found + np.uint64(5)))  # the upper bits are the bin, so the first of each bin is its least
    sample = ordered[np.flatnonzero(np.diff(ordered // np.uint64(2**64 // BINS), prepend=np.uint64(BINS)))]
    return _folded(mix(sample), FINE), len(sample)


def _signatures(k: int, bands: int, rows: int):
    """Arrow batches (id, text) to rows of `ATTRIBUTES`; the last four are null where a text has no words."""

    def run(batches):
        import pyarrow as pa

        seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        odd, ordinal = (seeds | np.uint64(1))[:, None], np.arange(bands * rows, dtype=np.uint64)
        longs = pa.list_(pa.int64())
        for batch in sliced(batches):
            size, hi, lo, told = [], [], [], []
            for text in texts(batch):
                found = np.unique(grams(word_hashes(text), k))
                size.append(len(found))
                hi.append(int(np.bitwise_xor.reduce(mix(found + np.uint64(7)), initial=np.uint64(len(found))).view(np.int64)))
                lo.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                if not len(found):
                    told.append((None, None, None, None))
                    continue
                least = np.full(bands * rows, np.uint64(2**64 - 1))
                for at in range(0, len(found), 4096):
                    np.minimum(least, (((found[None, at : at + 4096] ^ seeds[:, None]) * odd)).min(1), out=least)
                key = np.zeros(bands, np.uint64)
                for i in range(rows):
                    key = mix(key + least[i::rows])
                told.append((mix(key + np.arange(bands, dtype=np.uint64)).view(np.int64), _folded(mix(least + mix(ordinal + np.uint64(99))), BITS), *_finer(found)))
            keys, sketches, fine, samples = zip(*told, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, longs), pa.array(sketches, longs), pa.array(fine, longs), pa.array(samples, pa.int64())], ["id", "n", "hi", "lo", "bands", "sketch", "fine", "samples"])

    return run


def _sets(k: int):
    """Arrow batches (id, text) to (id, shingles)."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            sets = [np.unique(grams(word_hashes(text), k)).view(np.int64) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def most_flips(samples: int, similarity: float, deviations: float = 5.0) -> int:
    """The population count that the XOR of two odd sketches exceeds with negligible probability at `similarity` or above."""
    differing = samples * (1 - similarity)
    flips = 2 * differing
    expected = BITS / 2 * (1 - (1 - 2 / BITS) ** flips)
    spread = math.exp(-2 * flips / BITS) * 2 * math.sqrt(samples * similarity * (1 - similarity))
    return math.ceil(expected + deviations * math.hypot(spread, math.sqrt(expected * (1 - expected / BITS))))


def _expected(n, m, samples, samples2, similarity: float, deviations: float, exp, root, larger):
    """How many sampled values of two sets of n and m shingles differ at most at the similarity, but for `deviations` deviations.

    A bin that holds values of the union has its least value in both sets with the probability `similarity`, be the bins full or nearly
    empty; all sampled values but these flip a bit. The number of such bins follows that of the samples: half of it where bins are full,
    1 / (1 + similarity) where they hold whole sets. The allowance is `deviations` times the standard deviation at that similarity, of
    the sample (none if it is the whole set) and of the bitmap.
    """
    total, all_ = samples + samples2, n + m
    held = total * (1 - exp(-all_ / (1 + similarity) / BINS)) / (2 - exp(-n / BINS) - exp(-m / BINS))
    expected = larger(total - 2 * similarity * held, 0.0)
    of_bits = FINE / 4 * (exp(4 * expected / FINE) - 1) - expected
    of_sample = 4 * similarity * (1 - similarity) * held * larger(1 - total / all_, 0.0)
    return expected + 0.005 * total + deviations * root(of_bits + of_sample)


def _flips(x: str, y: str, bits: int) -> Column:
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, bits // 64)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def _near(similarity: float, deviations: float = 4.0) -> Column:
    """Whether the finer sketches of n, samples, fine and n2, samples2, fine2 admit the similarity."""
    n, m, samples, samples2 = (F.col(c).cast("double") for c in ("n", "n2", "samples", "samples2"))
    most = _expected(n, m, samples, samples2, similarity, deviations, F.exp, F.sqrt, lambda x, y: F.greatest(x, F.lit(y)))
    return _flips("fine", "fine2", FINE) <= FINE / 2 * (1 - F.exp(-2 / FINE * most))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).view(np.uint64)


def _groups(batches, by: tuple[str, ...] = ("key", "i", "j"), rows: int = 4096):
    """Arrow tables of whole groups of consecutive rows of equal `by`, of about `rows` rows or of one group."""
    import pyarrow as pa

    held, count, last = [], 0, None
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            held.append(part)
            count += part.num_rows
            if count < rows:
                continue
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in by]
            edge = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if len(edge):  # the last group may go on
                yield table.slice(0, edge[-1]).combine_chunks()
                held = table.slice(edge[-1]).to_batches()
                count = table.num_rows - int(edge[-1])
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(table):
    """Places (r, s) of all pairs to compare in a table of sorted groups, in steps: one of a left and one of a right block, in different components."""
    key, i, j, id_, component = (table.column(c).to_numpy() for c in ("key", "i", "j", "id", "component"))
    left, rest = table.column("left").to_numpy(), table.column("rest").to_numpy()
    rows = np.arange(len(key) - 1)
    for shift in range(1, len(key)):
        rows = rows[rows + shift < len(key)]
        other = rows + shift
        same = (key[rows] == key[other]) & (i[rows] == i[other]) & (j[rows] == j[other])
        rows = rows[same]
        if not len(rows):
            return
        other = rows + shift
        r, s = np.where(left[rows], rows, other), np.where(left[rows], other, rows)
        # two members of the rest meet as left and right, and as right and left
        met = (left[rows] != left[other]) & (component[r] != component[s]) & (~rest[s] | (id_[r] < id_[s]))
        if met.any():
            yield r[met], s[met]


def _sifted(similarity: float, most: int):
    """Arrow batches of sorted groups, with sketches, to the rows that are in some pair which the sketches admit."""

    def run(batches):
        import pyarrow as pa

        for table in _groups(batches):
            n, samples = table.column("n").to_numpy().astype(float), table.column("samples").to_numpy().astype(float)
            key, bands = table.column("key").to_numpy(), table.column("bands").chunk(0)
            bands = bands.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            sketch, fine = _matrix(table.column("sketch").chunk(0), BITS // 64), _matrix(table.column("fine").chunk(0), FINE // 64)
            taken = np.zeros(table.num_rows, bool)
            for r, s in _pairs(table):
                fits = (n[r] >= n[s] * similarity - 1e-6) & (n[s] >= n[r] * similarity - 1e-6)
                r, s = r[fits], s[fits]
                fits = np.bitwise_count(sketch[r] ^ sketch[s]).sum(1) <= most
                r, s = r[fits], s[fits]
                bound = _expected(n[r], n[s], samples[r], samples[s], similarity, 4.0, np.exp, np.sqrt, np.maximum)
                fits = np.bitwise_count(fine[r] ^ fine[s]).sum(1) <= FINE / 2 * (1 - np.exp(-2 / FINE * bound))
                r, s = r[fits], s[fits]
                shared = (bands[r] == bands[s]).argmax(1)
                fits = bands[r, shared] == key[r]  # a pair counts in the first of the buckets that it shares, all of which hold both components
                taken[r[fits]] = taken[s[fits]] = True
            kept = table.select(["key", "i", "j", "left", "rest", "id", "component"]).filter(pa.array(taken))
            yield from kept.to_batches()

    return run


def _linked(percent: int):
    """Arrow batches of sorted groups, with full sets, to a spanning forest (a, b) of each group's links."""

    def run(batches):
        import pyarrow as pa

        for table in _groups(batches):
            sets = table.column("shingles").combine_chunks()
            sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
            start, values = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
            size = np.diff(start)
            id_, component, key = (table.column(c).to_numpy() for c in ("id", "component", "key"))
            found, parent = [], {}

            def root(x, parent=parent):
                while parent.get(x, x) != x:
                    parent[x] = parent.get(parent[x], parent[x])
                    x = parent[x]
                return x

            for r, s in _pairs(table):
                fits = (size[r] * 100 >= size[s] * percent) & (size[s] * 100 >= size[r] * percent)
                for x, y in zip(r[fits].tolist(), s[fits].tolist(), strict=True):
                    # a link within what is tied already says nothing new
                    a, b = root((int(key[x]), int(component[x]))), root((int(key[y]), int(component[y])))
                    if a == b:
                        continue
                    common = len(np.intersect1d(values[start[x] : start[x + 1]], values[start[y] : start[y + 1]], assume_unique=True))
                    if 100 * common >= percent * (size[x] + size[y] - common):
                        parent[max(a, b)] = min(a, b)
                        found.append((int(id_[x]), int(id_[y])))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, bands: int = 24, rows: int = 4, block: int = 128) -> DataFrame:
    """One row (id_col, n_shingles, component_id, kept) for each row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text's set holds its distinct shingles of `k` words, the whole sequence
    if it has fewer, nothing if it has none. Two texts link if 100 * intersection >= percent * union of the full sets.
    A pair at a similarity of 0.75 meets in some band with probability 1 - (1 - 0.75 ** rows) ** bands, 0.9999 here.

    Ids are whole numbers, or texts of these; other ids stop the query with a cast error.

    Defined cases: a null or empty text links with nothing. Rows with equal ids are one document: a link of any of them links all.
    A row with a null id links with nothing, its component_id is null and it is kept. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = source.where("id IS NOT NULL")
    similarity, most = percent / 100, most_flips(bands * rows, percent / 100)  # of 256 bits; far fewer than unlike texts flip
    signed = cut(named.mapInArrow(_signatures(k, bands, rows), ATTRIBUTES))
    full = signed.where("n > 0")
    reps = cut(full.groupBy("hi", "lo").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch", "fine", "samples")]))
    classes = reps.select("hi", "lo", F.col("id").alias("rep"))

    # rows of one id that fall into several classes tie these together
    several = full.groupBy("id").agg(F.min(F.struct("hi", "lo")).alias("x"), F.max(F.struct("hi", "lo")).alias("y")).where("x <> y").select("id")
    ties = full.select("id", "hi", "lo").join(several, "id").join(classes, ["hi", "lo"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()

    def sets_of(ids: DataFrame) -> DataFrame:
        return named.join(small(ids), "id", "left_semi").select("id", "text").mapInArrow(_sets(k), "id long, shingles array<long>")

    # each member of a bucket with the bucket's first
    keyed = reps.select("id", F.explode("bands").alias("key")).distinct()
    hubs = cut(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub"))
    pairs = cut(keyed.join(hubs, "key").where("id <> hub").select("id", "hub").distinct())
    other = reps.select(F.col("id").alias("hub"), *[F.col(c).alias(f"{c}2") for c in ("n", "sketch", "fine", "samples")])
    sizes = (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent)
    fits = sizes & (_flips("sketch", "sketch2", BITS) <= most) & _near(similarity)
    pairs = cut(pairs.join(reps.select("id", "n", "sketch", "fine", "samples"), "id").join(other, "hub").where(fits).select(F.col("hub").alias("a"), F.col("id").alias("b")))
    sets = cut(sets_of(cut(pairs.select("a").union(pairs.select("b")).distinct().toDF("id"))))
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    links = both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")
    labels = cut(connected(links.union(ties)))

    # members of buckets that hold several components, dealt to pairs of blocks
    placed = cut(keyed.join(hubs.select("key"), "key", "left_semi").join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts"))
    held = cut(counts.where("parts > 1").select("key", F.col("top.component").alias("top"), F.ceil((F.col("m") - F.col("top.c")) / block).cast("int").alias("lefts"), F.ceil(F.col("m") / block).cast("int").alias("rights")))
    dealt = placed.join(held, "key").withColumn("rest", F.col("component") != F.col("top")).withColumn("hash", F.xxhash64("id", "key"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_right = F.transform(upto("lefts"), lambda i: F.struct(i.alias("i"), F.pmod("hash", "rights").cast("int").alias("j"), F.lit(False).alias("left")))
    as_left = F.transform(upto("rights"), lambda j: F.struct(F.pmod("hash", "lefts").cast("int").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    dealt = dealt.withColumn("x", F.explode(F.when(F.col("rest"), F.concat(as_right, as_left)).otherwise(as_right)))
    dealt = dealt.select("key", "x.i", "x.j", "x.left", "rest", "id", "component")
    grouped = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    kept = "key long, i int, j int, left boolean, rest boolean, id long, component long"
    sifted = cut(grouped(dealt.join(reps.select("id", "n", "bands", "sketch", "fine", "samples"), "id")).mapInArrow(_sifted(similarity, most), kept))
    sets = sets_of(cut(sifted.select("id").distinct()))
    found = grouped(sifted.join(sets, "id")).mapInArrow(_linked(percent), "a long, b long")
    labels = cut(connected(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)))

    members = signed.select("id", "n", "hi", "lo").join(classes, ["hi", "lo"], "left")
    component = F.coalesce("component", "rep", "id")
    # an id that has rows in several classes is labelled under each of them alike; its empty rows follow the id
    out = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
    null = source.where("id IS NULL").mapInArrow(_signatures(k, bands, rows), ATTRIBUTES)
    return out.union(null.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps: of each component the document with the smallest id, and rows with a null id.

    Rows with equal ids are one document, so they stay or go together.
    """
    copies = cut(near_duplicates(docs, id_col=id_col, **options).where("NOT kept").select(id_col).distinct())
    return docs.join(small(copies), id_col, "left_anti")
