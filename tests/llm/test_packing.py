import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideset.llm import packing

from texts import AWKWARD


def check(found, docs, capacity=1024):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in docs:
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append(ids)
    held = {}
    for r in found:
        held.setdefault(r["doc_id"], []).append(r)
    assert held.keys() == want.keys()
    for i, all_ids in want.items():
        if len(all_ids) == 1:
            at = 0
            for r in sorted(held[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(all_ids[0])
                assert r["ids_crc32"] == zlib.crc32(all_ids[0][at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(all_ids[0])
        else:
            assert sum(r["length"] for r in held[i]) == sum(map(len, all_ids))
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(len(x) for xs in want.values() for x in xs) / capacity


def test_every_id_lies_in_one_piece_and_padding_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    n, least = check(packing.pack(docs).collect(), [tuple(r) for r in docs.collect()])
    assert n <= 1.02 * least + 2


def test_ids_are_those_of_the_tokenizers_file_on_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    encode, other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._encoder(None, tuple(packing.SPECIAL.items()))
    texts = [t or "" for _, t in docs] + ["see <|endoftext|> here", "\u00a0\u2028x \t\r\n  y", "\U0001f469\u200d\U0001f4bb e\u0301 \ufb01", "'s 'LL 123456 \x00\x7f"]
    for text, own in zip(texts, encode.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.ids == other.encode(text, allowed_special="all")


def test_awkward_rows(spark, awkward):
    docs = [*awkward, (20, "see <|endoftext|> here", 1, None, "r", 0.5, "s")]
    check(packing.pack(spark.createDataFrame(docs, AWKWARD)).collect(), [r[:2] for r in docs])
    assert packing.pack(spark.createDataFrame([], AWKWARD)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_the_demand_and_come_near_the_bound(seed):
    draw = np.random.default_rng(seed)
    capacity = int(draw.integers(5, 60))
    demand = np.where(draw.random(capacity) < 0.6, draw.integers(0, 400, capacity), 0)
    used = packing.patterns(demand, capacity)
    held = sum((counts * times for counts, times in used), np.zeros(capacity, np.int64))
    assert (held == demand).all()
    assert all((counts * np.arange(1, capacity + 1)).sum() <= capacity for counts, _ in used)
    size = np.arange(1, capacity + 1)
    least = (demand * size).sum() / capacity
    for small in range(1, capacity // 2 + 1):  # sizes over half never share a sequence; the room beside them bounds what the others need
        alone, half, rest = size > capacity - small, (size > capacity / 2) & (size <= capacity - small), (size >= small) & (size <= capacity / 2)
        room = (demand * (capacity - size))[half].sum()
        least = max(least, demand[alone | half].sum() + max(0, ((demand * size)[rest].sum() - room) / capacity))
    assert sum(t for _, t in used) <= 1.02 * least + capacity / 2


def test_the_knapsack_is_that_of_all_multisets():
    draw = np.random.default_rng(4)
    for _ in range(20):
        values = draw.random(7) - 0.1
        best = {0: 0.0}
        for c in range(1, 15):
            best[c] = max([best[c - 1], *(best[c - s] + values[s - 1] for s in range(1, 8) if s <= c)])
        value, counts = packing.knapsack(values, 14)
        assert abs(value - best[14]) < 1e-12 and abs((counts * values).sum() - value) < 1e-12 and (counts * np.arange(1, 8)).sum() <= 14
