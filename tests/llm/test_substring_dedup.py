import random
import re
from collections import Counter

import numpy as np
import pytest
from support import rows

from tideset.llm import substring_dedup

from texts import AWKWARD, prose


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(docs, n=35):
    """(id, kept words joined, words, removed) of rows (id, text)."""
    held = [split(t) for _, t in docs]
    counts = Counter(tuple(w[j : j + n]) for w in held for j in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(docs, held, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if counts[tuple(w[j : j + n])] > 1:
                gone[j : j + n] = [True] * n
        out.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)))
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("most, each, window, gram", [(4096, 8192, 35, 8), (3, 7, 35, 8), (1, 1, 35, 8), (4, 50, 12, 3), (2, 9, 5, 5)])
def test_words_of_repeated_windows_go_and_nothing_else(spark, corpus, most, each, window, gram):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = rows(substring_dedup.without_repeats(docs, window=window, gram=gram, most=most, each=each))
    want = brute(corpus, window)
    assert got == want and sum(r[3] for r in want) > 500 and any(0 < r[3] < r[2] for r in want)


def test_a_passage_in_very_many_texts_is_split_over_buckets(spark):
    draw = random.Random(1)
    passage = prose(draw, 60)
    docs = [(i, f"{prose(draw, 20)} {passage if i % 3 else passage[: len(passage) // 2]}\n{prose(draw, 20)}") for i in range(300)]
    got = rows(substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), most=16, each=64))
    assert got == brute(docs)


def test_case_and_white_space(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(words)), (2, "\t\x0b".join(words)), (3, " ".join(words).upper()), (4, " ".join(words)), (5, "  " + "\n".join(words[:34])), (6, " ".join(words[:35] + ["x"] * 3))]
    got = rows(substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs) and {r[0]: r[3] for r in got} == {1: 40, 2: 40, 3: 0, 4: 0, 5: 0, 6: 35}


def test_awkward_rows(spark, awkward):
    got = rows(substring_dedup.without_repeats(spark.createDataFrame(awkward, AWKWARD)), "doc_id", "text", "n_words", "n_removed")
    assert got == brute([r[:2] for r in awkward])
    periodic = [(i, " ".join(["a", "b"][: 1 + i % 2] * 200)) for i in range(4)] + [(9, " ".join(["a"] * 34)), (10, "b " * 36)]
    assert rows(substring_dedup.without_repeats(spark.createDataFrame(periodic, "doc_id long, text string"), most=1, each=2)) == brute(periodic)
    clash = spark.createDataFrame([("a", "x y", 1, 2)], "row string, marks string, n_words int, k1 int")
    assert rows(substring_dedup.without_repeats(clash, "row", "marks")) == [("a", "x y", 2, 2, 0)]
    none = substring_dedup.without_repeats(spark.createDataFrame([], AWKWARD))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "id", "h", "row", "score", "source", "n_words", "n_removed"]


def test_windows_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    class Same(substring_dedup.Runs):
        def of(self, start, end):
            return np.zeros(len(start), np.uint64)

    packed, n = [b"a b c d", b"b c d", b"x y z"], np.array([1, 1, 2])
    plain = substring_dedup.repeated(packed, n, 3)
    monkeypatch.setattr(substring_dedup, "Runs", Same)
    for row, bit, count, held in (plain, substring_dedup.repeated(packed, n, 3)):
        assert sorted(zip(row.tolist(), bit.tolist(), count.tolist(), held, strict=True)) == [(0, 0, 1, b"a b c"), (0, 1, 2, b"b c d"), (1, 0, 2, b"b c d"), (2, 0, 2, b"x y z")]


def test_the_documents_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert rows(substring_dedup.without_repeats(docs)) == brute([tuple(r) for r in docs.collect()])
