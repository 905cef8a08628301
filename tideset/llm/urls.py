"""URL filtering: allow and block rules by host and path, and a logistic regression for what no rule decides.

The regression's terms are character n-grams of the host (between marks) and of the path, in which all digits are alike, hashed into a fixed number of
slots. It is trained on the driver from a small labelled table of URLs (`url_table`). Its score is a sum over terms, so a host's part is computed once for a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER, UPPER
from .url_table import ALLOW, BLOCK

SLOTS = 1 << 18
HOST_SIZES, PATH_SIZES = (2, 3, 4, 5), (3,)
_DIGITS = str.maketrans("123456789", "000000000")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def labelled_rows() -> list[tuple[str, int]]:
    """The small labelled table (url, label): 1 to block, 0 to allow."""
    return [*((u, 1) for u in BLOCK), *((u, 0) for u in ALLOW)]


def split_url(url: str | Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty for null and where there is no `://`."""
    rest = F.coalesce(F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule (verdict, pattern) that fits: its host or a subdomain, and a path that starts with the pattern's; else null.

    Rules are tried by the length of their pattern, then in the given order.
    """
    found = None
    for verdict, pattern in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = pattern.partition("/")
        own = own.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        struct = F.struct(F.lit(pattern).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, struct) if found is None else found.when(fits, struct)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def grams(text: str, kind: str, sizes: Sequence[int]) -> list[int]:
    """The slots of a text's distinct character n-grams; `kind` keeps those of host and path apart."""
    return [xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass"), seed=len(kind)) % SLOTS for g in {text[i : i + n] for n in sizes for i in range(len(text) - n + 1)}]


def host_terms(host: str) -> list[int]:
    return grams(f"^{host}$", "host", HOST_SIZES)


def path_terms(path: str) -> list[int]:
    return grams(path.translate(_DIGITS), "path.", PATH_SIZES)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def part(self, terms: list[int]) -> float:
        return float(self.weights[terms].sum()) if terms else 0.0


def fit(rows: list[tuple[str, str, int]], l2: float = 0.0002, steps: int = 1500, rate: float = 1.5) -> Model:
    """Logistic regression by gradient descent on (host, path, label); with one label only, the bias alone."""
    labels = np.array([y for _, _, y in rows], float)
    weights = np.zeros(SLOTS)
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(weights, float(np.log(share / (1 - share))))
    terms = [host_terms(h) + path_terms(p) for h, p, _ in rows]
    slots, ids = np.unique(np.concatenate([np.array(t, np.int64) for t in terms]), return_inverse=True)
    own = np.repeat(np.arange(len(rows)), [len(t) for t in terms])
    value = 1 / np.sqrt(np.array([max(len(t), 1) for t in terms]))[own]
    w, bias = np.zeros(len(slots)), 0.0
    for _ in range(steps):
        z = bias + np.bincount(own, w[ids] * value, len(rows))
        error = 1 / (1 + np.exp(-z)) - labels
        w -= rate * (np.bincount(ids, error[own] * value, len(slots)) / len(rows) * 4 + l2 * w)
        bias -= rate * error.mean()
    weights[slots] = w
    return Model(weights, bias)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", most: int = 10_000) -> Model:
    """A model from a table of URLs labelled 1 (block) or 0; at most `most` rows of it, those of the least hash."""
    host, path = split_url(url_col)
    label = F.col(label_col).cast("int")
    rows = labelled.where(label.isin(0, 1)).orderBy(F.xxhash64(url_col), url_col).limit(most).select(host.alias("host"), path.alias("path"), label.alias("label")).collect()
    return fit([tuple(r) for r in rows])


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table that the query uses (see `url_table`)."""
    return spark.createDataFrame(labelled_rows(), "url string, label int")


def _scores(model: Model):
    weights = model.weights.astype(np.float32)
    used = np.flatnonzero(weights)
    kept, bias = dict(zip(used.tolist(), weights[used].astype(float).tolist(), strict=True)), model.bias

    def run(batches):
        import pyarrow as pa

        hosts: dict[str, tuple[int, float]] = {}
        for batch in batches:
            out = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                known = hosts.get(host)
                if known is None:
                    if len(hosts) > 200_000:
                        hosts.clear()
                    terms = host_terms(host)
                    known = hosts[host] = (len(terms), sum(kept.get(t, 0.0) for t in terms))
                terms = path_terms(path)
                z = bias + (known[1] + sum(kept.get(t, 0.0) for t in terms)) / max(known[0] + len(terms), 1) ** 0.5
                out.append(1 / (1 + float(np.exp(-z))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), batch.column("path"), pa.array(out, pa.float64())], ["row", "host", "path", "score"])

    return run


def judge(pages: DataFrame, model: Model, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of `pages` with host, path, rule, score and verdict (columns of these names are replaced).

    A rule's verdict holds where one fits (see `matched_rule`); else `block` if the model's score is `threshold` or more, or `allow`.

    Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule, and is scored by the bias alone, like an empty URL.
    Repeated rows get equal results; an empty table gives no rows.
    """
    new = ["host", "path", "rule", "score", "verdict"]
    kept = pages.drop(*[c for c in new if c != url_col])
    host, path = split_url(url_col)
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row")
    inner = kept.select(row, host.alias("host"), path.alias("path"))
    scored = inner.mapInArrow(_scores(model), StructType([*inner.schema.fields, StructField("score", DoubleType())]))
    found = scored.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return found.select("row.*", "host", "path", F.col("found.rule").alias("rule"), "score", verdict.alias("verdict"))
