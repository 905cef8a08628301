"""Whitening of vectors by hierarchical merging of singular value decompositions.

An entry c counts as the whole number x = floor(1024 c) + 100000, so sums are exact. All that is returned is about x less its mean, in which the 100000 cancel, so
they are left out here, and small numbers keep their digits. Each partition reduces its vectors, batch by batch, to their number, exact sums,
mean, and the singular values and right singular vectors of its centred vectors, in full rank. Two such summaries merge into one: the rows of both (each
singular vector times its value) and one row more, the difference of the means times sqrt(n1 n2 / (n1 + n2)), are decomposed again; nothing is
cut off, so the merged summary has the covariance of all vectors to double precision. Spark merges `FAN` summaries in a task, round by round, until one is left, which
has as many numbers as dimensions squared, however many vectors there are. The error of the result is measured in the same way, on the whitened vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, FAN, BATCH = 1024, 16, 4096
_LARGEST = 2.0**40  # of an entry: beyond, sums might not fit a long
_SUMMARY = "length int, part long, n long, sums array<long>, mean array<double>, factor array<double>"


def decomposed(rows: np.ndarray) -> np.ndarray:
    """The right singular vectors of rows, each times its singular value: at most as many rows as columns, with the same inner products of columns."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


class Summary:
    """Number, exact sums (of whole numbers; else empty), mean and `decomposed` centred rows of vectors."""

    def __init__(self, n: int, sums: np.ndarray, mean: np.ndarray, factor: np.ndarray):
        self.n, self.sums, self.mean, self.factor = n, sums, mean, factor

    @classmethod
    def of(cls, rows: np.ndarray) -> Summary:
        n = len(rows)
        if rows.dtype == np.int64:
            sums = rows.sum(0)
            mean = sums / n
        else:
            sums, mean = np.zeros(0, np.int64), rows.mean(0)
        return cls(n, sums, mean, decomposed(rows - mean))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = other.mean - self.mean
        correction = np.sqrt(self.n / n * other.n) * apart
        sums = self.sums + other.sums
        mean = sums / n if len(sums) else self.mean + apart * (other.n / n)
        return Summary(n, sums, mean, decomposed(np.concatenate([self.factor, other.factor, correction[None]])))


def _by_length(column, scaled: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors of a list column, for each length but 0; `scaled`: as whole numbers floor(1024 c)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == length)
        for start in range(0, len(at), BATCH):
            own = at[start : start + BATCH]
            x = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), length)
            yield length, own, np.floor(SCALE * x).astype(np.int64) if scaled else x


def _arrow(rows: list[tuple[int, int, Summary]]):
    import pyarrow as pa

    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    return [
        pa.array([r[0] for r in rows], pa.int32()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2].n for r in rows], pa.int64()),
        pa.array([r[2].sums for r in rows], longs),
        pa.array([r[2].mean for r in rows], doubles),
        pa.array([r[2].factor.ravel() for r in rows], doubles),
    ]


_NAMES = ["length", "part", "n", "sums", "mean", "factor"]


def _summed(scaled: bool):
    """Arrow batches (length, vector) of a partition to one summary for each length."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held: dict[int, Summary] = {}
        for batch in batches:
            named = batch.column("length").to_numpy(zero_copy_only=False)
            for _, own, x in _by_length(batch.column("vector"), scaled):
                for name in np.unique(named[own]).tolist():
                    part = Summary.of(x[named[own] == name])
                    held[name] = held[name].merged(part) if name in held else part
        if held:
            yield pa.RecordBatch.from_arrays(_arrow([(name, TaskContext.get().partitionId(), s) for name, s in sorted(held.items())]), _NAMES)

    return run


def _merge(key, table):
    import pyarrow as pa

    found = None
    for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
        mean = np.array(row["mean"])
        one = Summary(row["n"], np.array(row["sums"], np.int64), mean, np.array(row["factor"]).reshape(-1, len(mean)))
        found = one if found is None else found.merged(one)
    return pa.table(_arrow([(key[0].as_py(), key[1].as_py(), found)]), names=_NAMES)


def summaries(vectors: DataFrame, scaled: bool) -> dict[int, Summary]:
    """The summary of all vectors (length, vector) of each length: partitions' summaries, merged `FAN` at a time in rounds of tasks."""
    parts = cut(vectors.select("length", "vector").mapInArrow(_summed(scaled), _SUMMARY))
    while parts.agg(F.max("part")).first()[0] or 0:
        named = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        parts = cut(named.groupBy("length", "part").applyInArrow(_merge, _SUMMARY))
    # one row for each length
    return {r["length"]: Summary(r["n"], np.array(r["sums"], np.int64), np.array(r["mean"]), np.array(r["factor"]).reshape(-1, len(r["mean"]))) for r in parts.collect()}


class Whitener:
    """The leading components of a summary of whole vectors: unit rows `axes`, their eigenvalues, and their shares of the trace."""

    def __init__(self, summary: Summary, most: int):
        s, v = np.linalg.svd(summary.factor, full_matrices=False)[1:]
        rank = int((s > s[:1] * max(summary.factor.shape[1], 8) * np.finfo(float).eps).sum()) if len(s) else 0
        k = min(most, rank)
        self.n, self.sums, self.mean = summary.n, summary.sums, summary.mean
        self.axes = v[:k] * np.where(v[np.arange(k), np.abs(v[:k]).argmax(1)] < 0, -1, 1)[:, None]
        self.eigenvalues = s[:k] ** 2 / summary.n
        self.explained = self.eigenvalues / ((s**2).sum() / summary.n)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S) ** 2 of each row, exact; None where no long holds it."""
        about = (((x - self.mean) * float(self.n)) ** 2).sum(1)
        wrapped = ((np.int64(self.n) * x - self.sums) ** 2).sum(1)  # right modulo 2 ** 64, so right where the sum fits a long
        out: list[int | None] = []
        for i, (near, value) in enumerate(zip(about.tolist(), wrapped.tolist(), strict=True)):
            if near < 0.999 * 2.0**63:
                out.append(value)
            else:
                exact = sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(x[i], self.sums, strict=True)) if near < 1.001 * 2.0**63 else 2**63
                out.append(exact if exact < 2**63 else None)
        return out


def _whiten(models: dict[int, Whitener]):
    """Arrow batches (id, length, vector) to (id, length, n, deviation, vector), the vector whitened."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for length, own, x in _by_length(batch.column("vector"), True):
                model = models[length]
                part = batch.take(pa.array(own))
                white = model.whitened(x)
                columns = [part.column("id"), pa.array([length] * len(own), pa.int32()), pa.array([model.n] * len(own), pa.int64()), pa.array(model.deviations(x), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "length", "n", "deviation", "vector"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row (id_col, component, n, deviation, whitened, explained, identity_error) for each vector and component of the largest variance.

    component counts from 1; n is how many vectors were fitted, which are all that remain; deviation the exact sum over dimensions of (n x - S) ** 2 for the sums
    S; whitened the centred vector's projection on the component over the square root of its eigenvalue; explained the eigenvalue's share of
    the trace; identity_error the largest entry, without its sign, of the whitened vectors' covariance less the identity.

    Defined cases: rows whose vector is null or has null or non-finite entries, or entries beyond 2 ** 40 (sums might not fit a long), are left out; vectors of length 0 have no
    components. Vectors of different lengths are fitted apart. Components without variance (equal vectors, fewer vectors than components) are left out. A deviation
    that no long holds is null. Repeated rows count each; a null id is kept as it is. Other columns are ignored.
    """
    session = vectors.sparkSession
    vector = F.col(f"`{vector_col}`")
    fine: Callable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= _LARGEST)
    rows = vectors.where(vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))).select(F.col(f"`{id_col}`").alias("id"), F.size(vector).alias("length"), vector.alias("vector"))
    models = {length: Whitener(summary, components) for length, summary in summaries(rows, scaled=True).items()}
    kind = vectors.schema[id_col].dataType.simpleString()
    white = cut(rows.mapInArrow(_whiten(models), f"id {kind}, length int, n long, deviation long, vector array<double>"))
    errors = {length: float(np.abs(s.factor.T @ s.factor / s.n - np.eye(len(s.mean))).max()) for length, s in summaries(white, scaled=False).items()}
    told = [(length, models[length].explained.tolist(), error) for length, error in errors.items()]
    told = session.createDataFrame(told, "length int, explained array<double>, identity_error double")  # a row for each length of vectors
    each = white.join(F.broadcast(told), "length").select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("vector", "explained")).alias("c", "x"))
    return each.select(F.col("id").alias(id_col), (F.col("c") + 1).cast("int").alias("component"), "n", "deviation", F.col("x.vector").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")
