"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the beginnings of its words (3 to 6 letters), hashed into a fixed number of slots; a term counts
once. The score is the logistic of w0 + sum w_i + sum over pairs <v_i, v_j>: the factors let pairs of terms (an insult with a group that is mentioned)
weigh more than their sum. Most weights are exactly zero (L1), so scoring looks only at words that the model knows.

The model is fitted on the driver on a bounded sample of labelled rows: at most `most_each` of each label, those of the least hash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import cut, sliced, texts, unused

SLOTS = 1 << 22
_WORD = re.compile(r"\w+")
_STEMS = (3, 4, 5, 6)


def terms(word: str) -> tuple[int, ...]:
    """The slots of a word's terms."""
    found = {f"w:{word}", *(f"{n}:{word[:n]}" for n in _STEMS if len(word) >= n)}
    return tuple(sorted(xxhash.xxh3_64_intdigest(x.encode()) % SLOTS for x in found))


def whole_word(word: str) -> int:
    """The slot of a word as a whole."""
    return xxhash.xxh3_64_intdigest(f"w:{word}".encode()) % SLOTS


def words_of(text: bytes) -> set[str]:
    return set(_WORD.findall(text.decode("utf-8", "replace").lower()))


class _Terms(dict):
    """word to slots, of the words met last; `only`: the slots that count."""

    MOST = 1 << 17  # some 30 MB

    def __init__(self, only: dict[int, int] | None = None):
        super().__init__()
        self.only = only

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.MOST:
            self.clear()
        found = terms(word)
        self[word] = found = found if self.only is None else tuple(self.only[x] for x in found if x in self.only)
        return found


@dataclass
class Model:
    """slots: the terms with a weight; w, v: their weights and factors; w0: the bias."""

    slots: np.ndarray
    w: np.ndarray
    v: np.ndarray
    w0: float

    def score(self, ids: np.ndarray) -> float:
        """The probability of label 1 for a text with these terms, numbered as in `slots`."""
        z = self.w0
        if len(ids):
            v = self.v[ids]
            z += self.w[ids].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, epochs: int = 30, l1: float = 0.3, l2: float = 0.01, rate: float = 0.1, seed: int = 7, paired: np.ndarray = ()) -> Model:
    """A factorization machine for texts given as slots: FTRL-proximal for the weights, AdaGrad for the factors, over all rows in batches.

    Terms have factors while their weight is not zero; those of `paired` always.
    """
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)), float(np.log(share / (1 - share))))
    begin = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    slots, ids = np.unique(np.concatenate(rows).astype(np.int64), return_inverse=True)
    n = len(slots)
    always = np.isin(slots, paired)
    rng = np.random.default_rng(seed)
    z, total = np.zeros(n), np.zeros(n)
    v, v_total = rng.normal(0, 0.05, (n, rank)), np.full((n, rank), 1e-8)
    w0, w0_total = float(np.log(labels.mean() / (1 - labels.mean()))), 1.0

    def weights() -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(total)) / rate + l2))

    for _ in range(epochs):
        shuffled = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            batch = shuffled[at : at + 64]
            spans = [np.arange(begin[r], begin[r + 1]) for r in batch]
            take = np.concatenate(spans)
            own, i = np.repeat(np.arange(len(batch)), [len(s) for s in spans]), ids[take]
            w = weights()
            live = (w[i] != 0) | always[i]
            sums = np.zeros((len(batch), rank))
            np.add.at(sums, own[live], v[i[live]])
            squares = np.zeros(len(batch))
            np.add.at(squares, own[live], (v[i[live]] ** 2).sum(1))
            out = w0 + np.bincount(own, w[i], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[batch]
            g = np.bincount(i, error[own], n)
            sigma = (np.sqrt(total + g * g) - np.sqrt(total)) / rate
            z += g - sigma * w
            total += g * g
            dv = np.zeros((n, rank))
            np.add.at(dv, i[live], error[own[live], None] * (sums[own[live]] - v[i[live]]))
            dv += l2 * v * (dv != 0)
            v_total += dv * dv
            v -= rate / 2 * dv / np.sqrt(v_total) * (dv != 0)
            w0_total += error.sum() ** 2
            w0 -= rate * error.sum() / np.sqrt(w0_total)
    w = weights()
    live = (w != 0) | always
    return Model(slots[live], w[live], v[live], w0)


def _slots_of(batches):
    import pyarrow as pa

    cache = _Terms()
    for batch in sliced(batches):
        held = [words_of(text) for text in texts(batch)]
        rows = [sorted({s for w in words for s in cache[w]}) for words in held]
        whole = [sorted({whole_word(w) for w in words}) for words in held]
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, ints), pa.array(whole, ints), batch.column("label")], ["id", "slots", "whole", "label"])


def _only(useful: np.ndarray, column: str):
    """Arrow batches (id, slots, whole, label) to (id, slots, label): the useful ones of a column, as their places in `useful`."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            rows = [np.searchsorted(useful, np.intersect1d(np.array(x, np.int64), useful)) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.int32())), batch.column("label")], ["id", "slots", "label"])

    return run


def _ratio(seen: np.ndarray, ones: np.ndarray, of: float, of_ones: float) -> np.ndarray:
    """Each cell's part of the log-likelihood ratio of a label against chance: `seen` rows, `ones` of them of label 1, where of_ones of all `of` rows are."""
    part = lambda x, share: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(seen * share, 1e-9)), 0.0)
    return 2 * (part(ones, of_ones / of) + part(seen - ones, 1 - of_ones / of))


def pairs_that_tell(rows: list[np.ndarray], labels: np.ndarray, n: int, evidence: float) -> np.ndarray:
    """Which of the terms 0..n-1 are in a pair that tells of the label together by `evidence` more than its two terms do one by one."""
    x = np.zeros((len(rows), n), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    ones = x[labels == 1]
    count, count1, all_, all1 = x.sum(0, dtype=float), ones.sum(0, dtype=float), len(rows), len(ones)
    alone = _ratio(count, count1, all_, all1) + _ratio(all_ - count, all1 - count1, all_, all1)
    found = np.zeros(n, bool)
    for at in range(0, n, 256):
        own = slice(at, at + 256)
        c11, p11 = (x[:, own].T @ x).astype(float), (ones[:, own].T @ ones).astype(float)
        c10, p10, c01, p01 = count[own, None] - c11, count1[own, None] - p11, count - c11, count1 - p11
        both = _ratio(c11, p11, all_, all1) + _ratio(c10, p10, all_, all1) + _ratio(c01, p01, all_, all1) + _ratio(all_ - c11 - c10 - c01, all1 - p11 - p10 - p01, all_, all1)
        tell = both - alone[own, None] - alone >= evidence
        tell[np.arange(len(c11)), at + np.arange(len(c11))] = False
        found |= tell.any(0)
    return found


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_each: int = 4000, evidence: float = 14.0, pair_words: int = 2048, pair_evidence: float = 40.0, **options) -> Model:
    """A model from the documents that `labels` covers, at most `most_each` of each label.

    Spark counts the sample's terms by label. Terms whose log-likelihood ratio against chance reaches `evidence` are fitted, and of the
    `pair_words` most frequent words those in a pair that tells by `pair_evidence` more than its words do one by one; so in long texts many
    weak terms don't outweigh a few strong ones, and the driver gets a few terms of each row.

    Labels other than 0 and 1, and null ids, are left out; of several labels of one id the largest counts. Repeated rows of one id and text count once.
    With fewer than two labels the model scores every text alike, with the share of label 1.
    """
    one = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    draw = lambda y: one.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most_each)
    chosen = draw(0).union(draw(1))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"])
    ints = ArrayType(IntegerType())
    kinds = StructType([found.schema["id"], StructField("slots", ints), StructField("whole", ints), StructField("label", IntegerType())])
    held = cut(found.select("id", "text", "label").mapInArrow(_slots_of, kinds))
    totals = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}
    zero, ones = totals.get(0, 0), totals.get(1, 0)
    if not zero or not ones:
        return fit([np.zeros(0, np.int64)] * (zero + ones), np.repeat([0.0, 1.0], [zero, ones]), **options)

    def taken(useful: np.ndarray, column: str) -> tuple[list[np.ndarray], np.ndarray]:
        """The rows' useful terms, and labels, in one order, so that a fit can be repeated."""
        kept = held.mapInArrow(_only(useful, column), StructType([kinds["id"], kinds["slots"], kinds["label"]])).toArrow().combine_chunks()
        order = np.lexsort((kept.column("label").to_numpy(), np.array([str(x) for x in kept.column("id").to_pylist()])))
        slots = kept.column("slots").combine_chunks()
        start, values = slots.offsets.to_numpy(), slots.values.to_numpy()
        return [values[start[i] : start[i + 1]].astype(np.int64) for i in order], kept.column("label").to_numpy()[order].astype(float)

    counted = lambda c: held.select(F.explode(c).alias("slot"), "label").groupBy("slot").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen * (zero + ones) / of)).otherwise(0.0)
    n, p = F.col("n").cast("double"), F.col("p").cast("double")
    ratio = 2 * (part(p, n * ones) + part(n - p, n * zero) + part(ones - p, (zero + ones - n) * ones) + part(zero - n + p, (zero + ones - n) * zero))
    alone = [r["slot"] for r in counted("slots").where(ratio >= evidence).select("slot").collect()]  # of a bounded sample
    frequent = np.array(sorted(r["slot"] for r in counted("whole").orderBy(F.desc("n"), "slot").limit(pair_words).collect()), np.int64)
    in_pairs = frequent[pairs_that_tell(*taken(frequent, "whole"), len(frequent), pair_evidence)]
    useful = np.union1d(np.array(alone, np.int64), in_pairs)
    rows, known = taken(useful, "slots")
    return fit([useful[x] for x in rows], known, paired=in_pairs, **options)


def _scores(model: Model, at: int):
    """Arrow batches (row) to (row, score), by the text that is the field number `at` of a row."""

    def run(batches):
        import pyarrow as pa

        cache = _Terms({int(s): i for i, s in enumerate(model.slots)})
        for batch in sliced(batches):
            out, row = [], batch.column(0)
            for text in texts(pa.RecordBatch.from_arrays([row.field(at)], ["text"])):
                ids = set()
                for word in words_of(text):
                    ids.update(cache[word])
                out.append(model.score(np.fromiter(ids, np.int64, len(ids))))
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.float64())], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of `docs` with their texts' probabilities of label 1 in `score_col` (a column of that name is replaced).

    Every text is read whole, and is sent to Python once, within its row. Null and empty texts have no terms and score the bias alone.
    """
    kept = docs.drop(score_col)
    names = [c.lower() for c in kept.columns]
    at = kept.columns.index(text_col) if text_col in kept.columns else names.index(text_col.lower()) if text_col.lower() in names else len(names)
    apart = [F.col(text_col).alias(unused(kept, "text"))] if at == len(names) else []  # a field of a struct
    inner = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns], *apart).alias("row"))
    scored = inner.mapInArrow(_scores(model, at), StructType([inner.schema["row"], StructField("score", DoubleType())]))
    return scored.select(*[F.col(f"row.`{c}`") for c in kept.columns], F.col("score").alias(score_col))


def remainder(id_: str | Column) -> Column:
    """crc32 of an id's text mod 5, by which rows are held out."""
    return F.pmod(F.crc32(F.col(id_).cast("string").cast("binary") if isinstance(id_, str) else id_.cast("string").cast("binary")), F.lit(5))
