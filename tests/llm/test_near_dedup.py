import itertools
import random

import pytest
from support import rows

from tideset.llm import near_dedup

from texts import AWKWARD, roots, shingles


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = roots(sets, links)
    return sorted((i, len(s), found[i], found[i] == i) for i, s in sets.items())


def test_near_duplicates_are_those_of_all_pairs(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert rows(near_dedup.near_duplicates(docs)) == brute(corpus)
    kept = {i for i, _, _, k in brute(corpus) if k}
    assert {r["doc_id"] for r in near_dedup.one_of_each(docs).collect()} == kept


def test_a_large_group_of_near_copies(spark, corpus):
    base = corpus[0][1].split() + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base[:i % 50], f"z{i}", *base[i % 50 + 1 :]])) for i in range(300)] + [(1000 + i, " ".join(base)) for i in range(200)]
    assert rows(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


@pytest.mark.parametrize("block", [2, 5, 128])
def test_buckets_of_several_components_are_compared_in_blocks(spark, block):
    draw = random.Random(block)
    shared = [f"s{i}" for i in range(80)]
    docs = []
    for i in range(120):  # some link, some don't, and all are near the limit
        own = [f"z{i // 3}_{j}" for j in range(draw.randint(10, 24))] + [f"y{i}_{j}" for j in range(draw.randint(0, 6))]
        docs.append((i, " ".join(shared + own)))
    want = brute(docs)
    assert 10 < sum(k for *_, k in want) < 110
    assert rows(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=block)) == want


def test_awkward_rows(spark, awkward):
    got = rows(near_dedup.near_duplicates(spark.createDataFrame(awkward, AWKWARD)), "doc_id", "component_id", "kept")
    assert got == [(None, None, True)] * 2 + [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False), (7, 6, False), (8, 8, True), (9, 8, False), (10, 10, True), (11, 11, True)]
    kept = near_dedup.one_of_each(spark.createDataFrame(awkward, AWKWARD))
    assert kept.count() == 10 and kept.columns == [c.split()[0] for c in AWKWARD.split(", ")]
    assert near_dedup.near_duplicates(spark.createDataFrame([], AWKWARD)).count() == 0


@pytest.mark.parametrize("similarity", [0.5, 0.75, 0.9])
def test_odd_sketches_estimate_similarities(similarity):
    import numpy as np

    draw, samples = np.random.default_rng(3), 96
    outside = 0
    for _ in range(300):
        differing = int((draw.random(samples) >= similarity).sum())
        flips = (np.bincount(draw.integers(0, near_dedup.BITS, 2 * differing), minlength=near_dedup.BITS) & 1).sum()
        outside += flips > near_dedup.most_flips(samples, similarity)
    assert outside == 0


@pytest.mark.parametrize("n", [300, 700, 1000, 2000, 20_000])
def test_the_finer_sketch_lets_true_links_through(spark, n):
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(n)
    pairs, told = 60, []
    for similarity in (0.75, 0.77, 0.8, 0.85):
        for i in range(pairs):
            inside = i % 3 == 0  # one set holds the other
            both = int(np.ceil(n * (similarity if inside else 2 * similarity / (1 + similarity))))
            salt = int(draw.integers(1 << 40))
            x = [f"{salt}x{j}" for j in range(n)]
            y = x[:both] + ([] if inside else [f"{salt}y{j}" for j in range(n - both)])
            assert len(set(x) & set(y)) >= 0.75 * len(set(x) | set(y))
            batch = pa.RecordBatch.from_pydict({"id": [0, 1], "text": [" ".join(x), " ".join(y)]})
            a, b = next(near_dedup._signatures(1, 24, 4)([batch])).to_pylist()
            told.append((similarity, a["n"], a["samples"], a["fine"], b["n"], b["samples"], b["fine"]))
    df = spark.createDataFrame(told, "similarity double, n long, samples long, fine array<long>, n2 long, samples2 long, fine2 array<long>")
    assert df.where(~near_dedup._near(0.75)).groupBy("similarity").count().collect() == []


def test_the_finer_sketch_stops_unlike_texts(spark):
    import pyarrow as pa

    told = []
    for n in (300, 1000, 20_000):
        x, y = [f"x{j}" for j in range(n)], [f"x{j}" if j < n * 0.6 else f"y{j}" for j in range(n)]  # a similarity of 0.43
        a, b = next(near_dedup._signatures(1, 24, 4)([pa.RecordBatch.from_pydict({"id": [0, 1], "text": [" ".join(x), " ".join(y)]})])).to_pylist()
        told.append((n, a["samples"], a["fine"], n, b["samples"], b["fine"]))
    df = spark.createDataFrame(told, "n long, samples long, fine array<long>, n2 long, samples2 long, fine2 array<long>")
    assert df.where(near_dedup._near(0.75)).count() == 0
