"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions alone.

Short test items are sought inside long documents. A whole document's MinHash says little about a short item in it, so the index is
partitioned by size: items fall into classes of q shingles, class c holding 2^(c-1) < q <= 2^c, and for class c a document is seen as
windows of 2^(c+1) shingles that overlap by half. Any stretch of 2^c shingles lies whole in some window, so the Jaccard similarity of an
item with the window around it is bounded below whatever the document's length. An item and a window that agree in one of `hashes`
MinHash values make a candidate; exact containment of the item's shingles in the whole document decides.

A window and an item can agree only in a shingle that is a minimum of some item. These few shingles are found first, by a join that
streams over the documents; MinHash values are then computed only for windows around them. That leaves the candidates the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, words


def _grams(w: Column, m: Column | int) -> Column:
    """Hashes of the runs of m words in the array w, in order; none if it is shorter.

    The words' hashes are bound to a lambda's variable, so that they are computed once and not for each run.
    """
    fixed = isinstance(m, int)
    size = F.lit(m) if fixed else m

    def runs(h: Column) -> Column:
        run = (lambda i: F.xxhash64(F.array(*[h[i + j] for j in range(m)]))) if fixed else (lambda i: F.xxhash64(F.slice(h, i + 1, size)))
        return F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), run)).otherwise(F.array().cast("array<long>"))

    return F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), runs)[0]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 75, hashes: int = 48) -> DataFrame:
    """One row (id_col, item_id_col, n_shared, n_item) for each document and item with 100 * n_shared >= percent * n_item.

    n_item counts the item's distinct shingles of `k` words (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; its whole sequence if it has fewer),
    n_shared those of them that the document has. At a containment of 0.75 the search misses an item with a probability of about 1e-4
    at worst (an item just over half the size of its class) and 1e-7 on average, at 1.0 practically never.

    Defined cases: null or empty texts of either side match nothing. Rows with a null id match nothing. Repeated rows and rows with equal
    ids count as one document (or item) with the shingles of all. Either table may be empty. Other columns are ignored.
    """
    i = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    i = i.select("item", words("text").alias("w")).where(F.size("w") > 0).withColumn("m", F.least(F.size("w"), F.lit(k)))
    shingles = cut(i.select("item", "m", F.explode(_grams(F.col("w"), F.col("m"))).alias("s")).distinct())
    counted = shingles.groupBy("item").agg(F.count("*").alias("q"), F.collect_set("s").alias("set"))
    sized = cut(counted.withColumn("c", F.ceil(F.log2("q")).cast("int")))
    names = [f"h{j}" for j in range(hashes)]
    minima = [F.min(F.struct(F.xxhash64("s", F.lit(j)), "s")).alias(names[j]) for j in range(hashes)]
    signed = shingles.join(small(sized.select("item", "c")), "item").groupBy("item", "m", "c").agg(*minima)
    index = cut(signed.select("item", "m", "c", F.posexplode(F.array(*names)).alias("j", "h")).select("item", "m", "c", "j", F.col("h.col1").alias("h"), F.col("h.s").alias("s")))
    sought = cut(index.select("m", "c", "s").distinct())
    lengths = [x.m for x in sought.select("m").distinct().orderBy("m").collect()]  # at most k numbers

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    session = docs.sparkSession
    empty = session.createDataFrame([], d.select("id").schema).select("id", F.lit(None).cast(items.schema[item_id_col].dataType).alias("item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("q"))
    shape = lambda df: df.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "n_shared", F.col("q").alias("n_item"))
    if not lengths:
        return shape(empty)

    def shingled(df: DataFrame, m: int, *keep: str) -> DataFrame:
        """df (id, text, ...) with g, the hashes of its runs of m words in order."""
        return df.select("id", _grams(words("text"), m).alias("g"), *keep)

    def around(m: int) -> DataFrame:
        """The windows of each class that hold a sought shingle: one row for each document that has any."""
        wanted = small(cut(sought.where(F.col("m") == m).select("c", "s")))
        hit = shingled(d, m).select("id", F.posexplode("g").alias("p", "s")).join(wanted, "s")
        last = (F.col("p") / F.pow(F.lit(2.0), F.col("c"))).cast("long")
        return hit.select("id", F.explode(F.array(F.struct("c", last.alias("x")), F.struct("c", (last - 1).alias("x")))).alias("w")).groupBy("id").agg(F.collect_set("w").alias("windows"))

    pairs = None
    for m in lengths:
        windows = cut(around(m))
        near = shingled(d.join(small(windows), "id"), m, "windows").select("id", "g", F.explode("windows").alias("w"))
        width = F.pow(F.lit(2.0), F.col("w.c")).cast("long")
        start, end = F.greatest(F.col("w.x") * width, F.lit(0)), (F.col("w.x") + 2) * width
        inside = near.select("id", "w", F.explode(F.slice("g", (start + 1).cast("int"), (end - start).cast("int"))).alias("s"))
        found = inside.groupBy("id", "w").agg(*[F.min(F.xxhash64("s", F.lit(j))).alias(names[j]) for j in range(hashes)])
        values = found.select("id", F.col("w.c").alias("c"), F.posexplode(F.array(*names)).alias("j", "h"))
        met = values.join(small(cut(index.where(F.col("m") == m).select("c", "j", "h", "item"))), ["c", "j", "h"]).select("id", "item").distinct()
        met = cut(met)
        candidates = met.join(small(sized.select("item", "q", "set")), "item")
        parts = shingled(d.join(small(met.select("id").distinct()), "id", "left_semi"), m).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("g")))).alias("g"))
        exact = candidates.join(cut(parts), "id").select("id", "item", F.size(F.array_intersect("set", "g")).cast("long").alias("n_shared"), "q")
        exact = exact.where(100 * F.col("n_shared") >= percent * F.col("q"))
        pairs = exact if pairs is None else pairs.union(exact)
    return shape(pairs)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` in which `contaminated` finds no item; rows with a null id stay."""
    leaks = cut(contaminated(docs, items, id_col=id_col, **options).select(id_col).distinct())
    return docs.join(small(leaks), id_col, "left_anti")
