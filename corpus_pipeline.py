"""The corpus pipeline: from raw documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. Stages work on whole texts
and on all that their predecessor kept. Those with Python workers let the session's Arrow batches take 4 MB at most (`small_batches`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideset.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from tideset.llm.common import cut, small_batches, unused
from tideset.llm.queries import table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a toxicity score below 0.5, by a model of the labelled documents (of those that op1 learns from).

    Null and empty texts score the model's bias and stay, unless most labelled rows are toxic; rows with null ids are scored too. Repeated rows
    get equal scores. Without labels of both kinds all documents score the share of toxic ones. Other columns stay as they are.
    """
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(toxicity.remainder("doc_id") != 0))
    score = unused(docs, "_score")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without runs of 50 words or more that stand at an earlier place; n_chars counts anew.

    Null texts become empty ones, texts that are wholly repeats too; rows with null ids stay as they are. Rows of equal id and text get the same
    result. Other columns stay as they are.
    """
    small_batches(spark)
    removed, count = unused(docs, "removed"), unused(docs, "n_removed")
    found = line_dedup.repeated_runs(docs, removed_col=removed, count_col=count)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Null and empty texts link with nothing and stay, rows with null ids too; rows of one id stay or go together. Other columns stay as they are.
    """
    small_batches(spark)
    return near_dedup.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item.

    Null and empty texts hold none, and rows with null ids stay; null or empty items are held by none. Other columns stay as they are.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids, each with its sequence and offset.

    Null and empty texts are the closing id alone; repeated rows are packed each. Other columns are left out.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("packing", sequence_packing),
]

#: SQL can express neither the model nor the approximate searches nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is kept in the shared checkpoint folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
