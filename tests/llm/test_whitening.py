import numpy as np
import pytest
from support import rows

from tideset.llm import whitening


def whole(v):
    return [int(np.floor(1024 * np.float64(c))) + 100_000 for c in v]


def brute(vectors, most=8):
    """{position: (n, deviation, {component: (|whitened|, explained)})} of vectors that hold no odd entries, by exact sums and an eigendecomposition."""
    x = [whole(v) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    about = np.array([[float(n * a - s) for a, s in zip(v, sums, strict=True)] for v in x]) / n
    e, axes = np.linalg.eigh(about.T @ about / n)
    e, axes = e[::-1], axes[:, ::-1]
    white = about @ axes[:, :most] / np.sqrt(np.maximum(e[:most], 1e-300))
    return [(n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), w, e[:most] / e.sum()) for v, w in zip(x, white, strict=True)]


def agree(found, ids, vectors, most=8):
    got = {(r["vec_id"], r["component"]): r for r in found.collect()}
    assert len(got) == len(ids) * most and {c for _, c in got} == set(range(1, most + 1))
    want = brute(vectors, most)
    signs = [np.sign(sum(got[i, c + 1]["whitened"] * w[2][c] for i, w in zip(ids, want, strict=True))) for c in range(most)]
    for i, (n, deviation, white, explained) in zip(ids, want, strict=True):
        for c in range(most):
            r = got[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["whitened"] == pytest.approx(signs[c] * white[c], abs=1e-7) and r["explained"] == pytest.approx(explained[c], rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in got.values()}) == 1


def test_merged_partitions_give_the_components_of_all_vectors(spark):
    draw = np.random.default_rng(1)
    data = (draw.normal(size=(900, 12)) * np.linspace(1, 4, 12) + draw.normal(size=12) * 50).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(data)], "vec_id long, embedding array<float>, part int, n string").repartition(40)
    agree(whitening.whiten(df), list(range(900)), data)


def test_the_embeddings_of_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    held = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    agree(whitening.whiten(df), [i for i, _ in held], [v for _, v in held])


def test_summaries_merge_without_loss():
    draw = np.random.default_rng(2)
    x = np.floor(draw.normal(size=(500, 9)) @ draw.normal(size=(9, 9)) * 1000).astype(np.int64) + draw.integers(0, 10**6, 9)
    parts, at = None, 0
    for size in (1, 3, 200, 8, 288):
        one = whitening.Summary.of(x[at : at + size])
        parts, at = one if parts is None else parts.merged(one), at + size
    centred = x - x.mean(0)
    assert parts.n == 500 and (parts.sums == x.sum(0)).all() and parts.factor.shape == (9, 9)
    assert np.allclose(parts.factor.T @ parts.factor, centred.T @ centred, rtol=1e-11, atol=1e-6 * np.abs(centred.T @ centred).max() * 1e-6)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 0.0, 0.0]), (104, []), (105, [1e300, 0.0, 0.0])]
    draw = np.random.default_rng(3)
    fine = [(i, draw.normal(size=3).tolist()) for i in range(30)]
    twice = [*fine, fine[4], (None, fine[5][1])]
    pairs = [(200 + i, draw.normal(size=2).tolist()) for i in range(5)]
    schema = "vec_id long, embedding array<double>, component int"
    found = whitening.whiten(spark.createDataFrame([(*r, 9) for r in odd + twice + pairs], schema))
    kept = found.collect()
    assert {r["vec_id"] for r in kept} == {i for i, _ in twice + pairs}
    want = {i: w for (i, _), w in zip(twice, brute([v for _, v in twice], 3), strict=True)}
    for r in kept:
        n, deviation = (5, None) if r["vec_id"] is not None and r["vec_id"] >= 200 else want[r["vec_id"]][:2]
        assert r["n"] == n and (deviation is None or r["deviation"] == deviation)
    assert sum(r["vec_id"] == 4 for r in kept) == 6 and sum(r["vec_id"] == 203 for r in kept) == 2
    # components without variance are none
    flat = whitening.whiten(spark.createDataFrame([(i, [1.0, float(i % 2), 2.0]) for i in range(6)], "vec_id long, embedding array<double>"))
    assert sorted({(r["component"], round(abs(r["whitened"]), 9), r["explained"]) for r in flat.collect()}) == [(1, 1.0, 1.0)]
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_deviations_that_no_long_holds_are_null(spark):
    for far, held in ((10**5, True), (10**6, False)):
        x = [[far * i / 1024.0] for i in range(-500, 501)]
        got = rows(whitening.whiten(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")), "vec_id", "deviation")
        want = [(i, d if d < 2**63 else None) for i, (_, d, *_) in enumerate(brute(x, 1))]
        assert got == want and (None in [d for _, d in got]) != (held and max(d for _, d, *_ in brute(x, 1)) < 2**63)
