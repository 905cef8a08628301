"""Near-duplicate vectors by spherical k-means cells.

Several codebooks of unit centres are fitted on a bounded sample. Every vector is put into the nearest cells of each codebook, 4 and more the more
cells there are (`enough`); within a cell, blocks of vectors are compared by matrix products in double precision. Of 20,000 simulated Gaussian pairs
at a cosine of 0.9 in 64 dimensions, with 2 codebooks of 4,096 cells, 197 share no cell with 4 probes, 6 with 6 and none with 8, which are taken there.
Beyond 4,096 cells a codebook has two levels: the second tells in which direction from a cell's centre a vector lies.

A cell that holds more than `block` vectors is cut into blocks, and each pair of blocks is a group of its own, so no task
gets more than two blocks at a time. A pair that meets in several cells counts in the first only, and a group returns one row for each of its vectors (how
many it links with, and the least id it hangs on there), never its pairs. Equal vectors form a class that takes part once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, cut, small


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codebook(sample: np.ndarray, cells: int, seed: int, rounds: int = 5) -> np.ndarray:
    """Centres of spherical k-means over unit vectors; fewer than `cells` if there are fewer vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[at : at + 4096] @ centres.T).argmax(1) for at in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.sqrt((sums * sums).sum(1))
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def enough(probes: int, cells: int) -> int:
    """`probes`, which are right for 40 cells, and one more for each fourfold number of cells: 6 with 200, 7 with 1,000, 8 with 4,096."""
    return probes + max(0, math.ceil(math.log(cells / 40, 4)))


def _matrix(column) -> np.ndarray:
    """A list column of vectors of one length as a matrix."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Book:
    """Centres of cells; with `inner` each is cut into finer cells by the direction in which a vector lies from the centre."""

    centres: np.ndarray
    inner: np.ndarray | None = None

    def cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of the cells that unit vectors are put into, a row for each vector."""
        near = _nearest(x, self.centres, enough(probes, len(self.centres)))
        if self.inner is None:
            return near
        out = []
        for column in near.T:
            found = _nearest(x - self.centres[column], self.inner, enough(probes, len(self.inner)))
            out.append((column[:, None] << 20) + found)
        return np.concatenate(out, 1)


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(centres))
    return np.argpartition(-(x @ centres.T), n - 1, 1)[:, :n]


def books_of(sample: np.ndarray, cells: int, most_cells: int, tables: int, probes: int) -> list[Book]:
    """Codebooks of about `cells` cells from a sample of unit vectors; of more than `most_cells` they have two levels."""
    books = []
    for seed in range(tables):
        book = Book(codebook(sample, min(cells, most_cells), seed))
        if cells > most_cells:
            near = _nearest(sample, book.centres, enough(probes, len(book.centres)))
            column = near[np.arange(len(sample)), np.random.default_rng(seed).integers(0, near.shape[1], len(sample))]
            book.inner = codebook(unit(sample - book.centres[column]), min(most_cells, math.ceil(cells / most_cells)), seed)
        books.append(book)
    return books


def _assign(books: list[Book], probes: int):
    """Arrow batches (rep, weight, vector) with the cells of each vector, ascending."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = unit(_matrix(part.column("vector")))
                found = np.sort(np.concatenate([book.cells(x, probes) + (i << 40) for i, book in enumerate(books)], 1), 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "weight", "vector")), pa.array(list(found), pa.list_(pa.int64()))], ["rep", "weight", "vector", "cells"])

    return run


def _first_shared(cell: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether `cell` is the least cell that rows of a and b share."""
    return ~((a[:, :, None] == b[:, None, :]) & (a < cell)[:, :, None]).any((1, 2))


def _compare(threshold: float):
    """An Arrow table (cell, i, j, block, rep, weight, vector, cells) of one group to rows (rep, links, root)."""

    def run(key, table):
        import pyarrow as pa

        cell, i, j = (k.as_py() for k in key)
        rep, weight, block = (table.column(c).to_numpy() for c in ("rep", "weight", "block"))
        x, cells = unit(_matrix(table.column("vector"))), _matrix(table.column("cells"))
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        ends = []
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            p, q = np.nonzero(x[own] @ x[right].T >= threshold)
            p, q = own[p], right[q]
            keep = rep[p] < rep[q] if i == j else np.ones(len(p), bool)
            p, q = p[keep], q[keep]
            step = max(1, (1 << 24) // cells.shape[1] ** 2)
            for start in range(0, len(p), step):
                s, t = p[start : start + step], q[start : start + step]
                first = _first_shared(cell, cells[s], cells[t])
                s, t = s[first], t[first]
                np.add.at(links, s, weight[t])
                np.add.at(links, t, weight[s])
                ends.append((rank[s].astype(np.int32), rank[t].astype(np.int32)))
        if ends:
            s, t = (np.concatenate(e) for e in zip(*ends, strict=True))
            while len(s):  # the least rank spreads along the links, and roots point to roots
                before = root.copy()
                np.minimum.at(root, s, root[t])
                np.minimum.at(root, t, root[s])
                root = root[root]
                if (root == before).all():
                    break
        found = np.flatnonzero(links)
        return pa.table({"rep": pa.array(rep[found]), "links": pa.array(links[found]), "root": pa.array(rep[order[root[rank[found]]]])})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int = 2, probes: int = 4, cell_size: int = 256, most_cells: int = 4096, sample_each: int = 32, block: int = 1024) -> DataFrame:
    """One row (id_col, n_links, component_id, kept) for each row of `vectors`; links are pairs with a cosine of `threshold` or more.

    The codebooks are fitted on a sample of about `sample_each` vectors for each cell (those of small hashes), sample_each * most_cells in all at most;
    every vector is indexed and compared. The number of cells is in proportion to the vectors: beyond `most_cells` each is cut into up to
    `most_cells` more, so that cells stay at `cell_size` vectors and a vector is copied equally often from there on.

    Ids are whole numbers, or texts of these; other ids stop the query with a cast error.

    Defined cases: vectors that are null, empty or zero or have null or non-finite components link with nothing. Vectors link only with
    vectors of their own length. Repeated rows link with each other like other equal vectors; rows of one id are in one component. A row with a null id
    links with nothing, has no component and is kept. Other columns are ignored.
    """
    session = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.col("id").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False)) & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = usable & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    held = rows.withColumn("usable", usable)
    hashed = held.where("usable").select("id", F.size("vector").alias("length"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"), "vector")
    keys = cut(hashed.select("id", "length", "h1", "h2"))
    classes = cut(keys.groupBy("length", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))
    several = keys.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    tied = keys.join(small(cut(several)), "id").join(classes, ["length", "h1", "h2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()

    found = None
    lengths = [(r["length"], r["n"]) for r in classes.groupBy("length").agg(F.count("*").alias("n")).collect()]  # the vectors' lengths; models give one or a few
    for length, n in lengths:
        own = hashed.where(F.col("length") == length)
        one = own.join(classes.where(F.col("length") == length).withColumnRenamed("rep", "id").select("id", "h1", "h2", "weight"), ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])
        # a class is named by a hash of its vector, since one id may have several vectors
        one = cut(one.select(F.col("h1").alias("rep"), "weight", "vector"))
        cells = max(1, math.ceil(n / cell_size))
        share = min(1.0, sample_each * min(cells, most_cells) / n)
        drawn = one.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) < math.ceil(share * 1_000_003)).select("rep", "vector").toArrow()
        drawn = drawn if drawn.num_rows else one.select("rep", "vector").limit(1).toArrow()  # a table of a few vectors
        order = np.argsort(drawn.column("rep").to_numpy())  # so that a codebook can be fitted again
        books = books_of(unit(_matrix(drawn.column("vector")))[order], cells, most_cells, tables, probes)
        placed = one.mapInArrow(_assign(books, probes), "rep long, weight long, vector array<double>, cells array<long>")
        placed = placed.withColumn("cell", F.explode("cells"))
        sizes = cut(placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
        dealt = placed.join(small(sizes), "cell")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", "cell"), F.col("blocks")).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j")))
        dealt = dealt.withColumn("pair", F.explode(pairs)).select("cell", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", "rep", "weight", "vector", "cells")
        part = dealt.groupBy("cell", "i", "j").applyInArrow(_compare(threshold), "rep long, links long, root long")
        found = part if found is None else found.union(part)
    found = cut(found if found is not None else session.createDataFrame([], "rep long, links long, root long"))
    counted = cut(found.groupBy("rep").agg(F.sum("links").alias("links")))
    names = classes.select(F.col("h1").alias("hash"), F.col("rep").alias("id"))
    edges = found.where("rep <> root").select("rep", "root").distinct()
    edges = edges.join(names.select(F.col("hash").alias("rep"), F.col("id").alias("a")), "rep").join(names.select(F.col("hash").alias("root"), F.col("id").alias("b")), "root").select("a", "b")
    labels = cut(connected(edges.union(tied)))

    member = keys.join(classes, ["length", "h1", "h2"]).join(counted.withColumnRenamed("rep", "h1"), "h1", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    linked = member.select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = held.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), "id").toDF("id", "n_links", "component_id")
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
