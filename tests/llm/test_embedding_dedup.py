import numpy as np
from support import rows

from tideset.llm import embedding_dedup

from texts import roots


def brute(vectors, threshold=0.9):
    """vectors: (id, values), ids distinct."""
    held = {i: np.array(v, float) for i, v in vectors if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    links = []
    for a in held:
        for b in held:
            if a < b and len(held[a]) == len(held[b]) and held[a] @ held[b] / np.sqrt((held[a] @ held[a]) * (held[b] @ held[b])) >= threshold:
                links.append((a, b))
    found = roots([i for i, _ in vectors], links)
    return sorted((i, sum(i in link for link in links), found[i], found[i] == i) for i, _ in vectors)


def clustered(seed, n, size):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n // 5, size))
    out = [(i, (base[draw.integers(len(base))] + draw.choice([0, 0.1, 0.3, 0.5]) * draw.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]
    return out


def test_links_are_those_of_all_pairs(spark):
    data = clustered(1, 700, 24)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = rows(embedding_dedup.near_vectors(df, cell_size=32, block=40))
    assert got == brute(data)
    assert rows(embedding_dedup.near_vectors(df)) == got


def test_a_large_group_is_cut_into_blocks(spark):
    draw = np.random.default_rng(2)
    data = [(i, (np.ones(8) + 0.05 * draw.normal(size=8)).tolist()) for i in range(150)] + [(200 + i, draw.normal(size=8).tolist()) for i in range(50)]
    got = rows(embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), cell_size=16, block=10))
    assert got == brute(data)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1e-30, 2e-30]), (8, [1e30, 2e30]), (9, [1.0, 2.0, 0.0]), (10, [2.0, 4.0, 0.0]), (11, [-1.0, -2.0])]
    schema = "vec_id long, embedding array<double>, id int, rep int, cells string, label int"
    df = spark.createDataFrame([(*r, 1, 2, "c", 3) for r in data], schema)
    assert rows(embedding_dedup.near_vectors(df)) == brute(data)
    again = spark.createDataFrame([(i, v, 1, 2, "c", 3) for i, v in [(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [-3.0, 1.0]), (9, [-3.0, 1.0])]], schema)
    assert rows(embedding_dedup.near_vectors(again)) == [(None, 0, None, True), (5, 1, 5, True), (5, 1, 5, True), (5, 1, 5, True), (9, 1, 5, False)]
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def gaussian_pairs(n, cosine=0.9):
    draw = np.random.default_rng(4)
    x = embedding_dedup.unit(draw.normal(size=(n, 64)))
    z = draw.normal(size=(n, 64))
    return draw, x, cosine * x + (1 - cosine**2) ** 0.5 * embedding_dedup.unit(z - (z * x).sum(1, keepdims=True) * x)


def test_pairs_share_a_cell_among_many():
    cells = 1000
    draw, x, y = gaussian_pairs(10_000)
    sample = embedding_dedup.unit(draw.normal(size=(16 * cells, 64)))
    books = [embedding_dedup.codebook(sample, cells, seed, rounds=2) for seed in range(2)]

    def apart(probes):
        held = [np.concatenate([embedding_dedup._nearest(v, book, probes) + (i << 40) for i, book in enumerate(books)], 1) for v in (x, y)]
        return sum(not set(a) & set(b) for a, b in zip(*held, strict=True))

    assert apart(4) > 0 and apart(embedding_dedup.enough(4, cells)) <= 1


def test_pairs_share_a_cell_of_two_levels():
    draw, x, y = gaussian_pairs(3000)
    sample = embedding_dedup.unit(draw.normal(size=(8000, 64)))
    for cells in (1000, 64_000):
        books = embedding_dedup.books_of(sample, cells, 250, 2, 4)
        held = [np.concatenate([book.cells(v, 4) + (i << 40) for i, book in enumerate(books)], 1) for v in (x, y)]
        assert held[0].shape[1] < 100 and sum(not set(a) & set(b) for a, b in zip(*held, strict=True)) <= 3


def test_links_are_those_of_all_pairs_with_two_levels(spark):
    data = clustered(3, 600, 24)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert rows(embedding_dedup.near_vectors(df, cell_size=16, most_cells=8, block=40)) == brute(data)
