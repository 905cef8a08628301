import random

import numpy as np
from support import rows

from tideset.llm import toxicity
from tideset.llm.queries import op1_factorization_machine_toxicity

from texts import AWKWARD

SF = "/root/testdata/sf0.1"


def test_held_out_labels_are_told(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    both = [r for r in op1_factorization_machine_toxicity(spark, SF).join(labels, "doc_id").collect() if r["held_out"] and r["toxic"] is not None]
    right = sum(r["predicted"] == r["toxic"] for r in both)
    caught = sum(r["predicted"] for r in both if r["toxic"])
    wrong = sum(r["predicted"] for r in both if not r["toxic"])
    assert len(both) > 500 and right >= 0.97 * len(both)
    # some labels of junk texts are noise
    assert caught >= 0.85 * sum(r["toxic"] for r in both) and wrong <= 0.02 * len(both)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in both)


def test_pairs_of_terms_matter():
    """Label 1 where one of two words stands without the other, which no sum of weights tells."""
    draw = random.Random(2)

    def sample():
        a, b = draw.random() < 0.5, draw.random() < 0.5
        found = {draw.choice("pqrstuvw") * 3 for _ in range(3)} | ({"insult"} if a else set()) | ({"group"} if b else set())
        return np.array(sorted({s for w in found for s in toxicity.terms(w)})), float(a != b)

    texts, labels = zip(*[sample() for _ in range(2000)], strict=True)
    model = toxicity.fit(list(texts), np.array(labels))
    number = {s: i for i, s in enumerate(model.slots.tolist())}
    right = [(model.score(np.array([number[s] for s in x.tolist() if s in number], np.int64)) >= 0.5) == y for x, y in (sample() for _ in range(400))]
    assert sum(right) > 0.95 * len(right)


def test_training_finds_words_that_tell_in_pairs_only(spark):
    """The same through train(), where neither word tells anything alone; scores agree with a plain sum over pairs."""
    draw = random.Random(4)

    def sample(i):
        a, b = draw.random() < 0.5, draw.random() < 0.5
        w = [draw.choice("pqrstuvw") * 3 for _ in range(6)] + ["insult"] * a + ["group"] * b
        draw.shuffle(w)
        return i, " ".join(w), int(a != b)

    df = spark.createDataFrame([sample(i) for i in range(3000)], "doc_id long, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 2400"), df.select("doc_id", "toxic"))
    out = toxicity.score(df.where("doc_id >= 2400"), model).collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in out) > 0.95 * len(out)
    number = {int(s): i for i, s in enumerate(model.slots)}
    for r in out[:200]:
        own = sorted({number[t] for w in set(r["text"].split()) for t in toxicity.terms(w) if t in number})
        z = model.w0 + sum(model.w[i] for i in own) + sum(float(model.v[i] @ model.v[j]) for i in own for j in own if i < j)
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_pairs_that_tell_are_those_of_a_plain_count():
    draw = np.random.default_rng(6)
    x = draw.random((400, 12)) < 0.4
    y = (x[:, 2] ^ x[:, 7]).astype(float)
    found = toxicity.pairs_that_tell([np.flatnonzero(r) for r in x], y, 12, 40.0)

    def tells(cells):
        total = 0.0
        for c in np.unique(cells):
            for label in (0, 1):
                seen, share = ((cells == c) & (y == label)).sum(), (y == label).mean()
                total += 2 * seen * np.log(seen / ((cells == c).sum() * share)) if seen else 0
        return total

    want = [any(i != j and tells(x[:, i] * 2 + x[:, j]) - tells(x[:, i]) - tells(x[:, j]) >= 40 for j in range(12)) for i in range(12)]
    assert found.tolist() == want and found[2] and found[7]


def test_awkward_rows(spark, awkward):
    df = spark.createDataFrame(awkward, AWKWARD)
    labels = [(None, 1), (4, 1), (6, 0), (6, 1), (7, 0), (8, None), (9, 7), (10, 0)]
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score(df, model)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == len(awkward)
    scores = {r["doc_id"]: r["score"] for r in out.collect()}
    assert scores[1] == scores[2] == scores[3] and all(0 <= s <= 1 for s in scores.values())
    none = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.5}
    alike = toxicity.train(df, spark.createDataFrame([(4, 1), (7, 1)], "doc_id long, toxic int"))
    assert len({r["score"] for r in toxicity.score(df, alike).collect()}) == 1
    assert toxicity.score(df.limit(0), none).count() == 0


def test_a_text_is_sent_to_python_once(spark, monkeypatch):
    def sizes(*_):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(batch.nbytes)] * batch.num_rows)], ["row", "score"])

        return run

    df = spark.createDataFrame([(1, "x" * 500_000, 5)], "doc_id long, Text string, n int").coalesce(1)
    monkeypatch.setattr(toxicity, "_scores", sizes)
    assert toxicity.score(df, None).first()["score"] < 600_000


def test_the_text_may_stand_anywhere(spark):
    model = toxicity.Model(np.array(sorted({s for s in toxicity.terms("insult")})), np.full(5, 1.0), np.zeros((5, 4)), -1.0)
    want = [1 / (1 + np.exp(-4)), 1 / (1 + np.exp(1))]
    df = spark.createDataFrame([(1, "an insult", "b"), (2, "praise", "insult")], "doc_id long, Text string, other string")
    for docs, name in ((df, "text"), (df.select("other", "Text"), "Text"), (df.select("Text"), "Text"), (df.selectExpr("doc_id", "struct(Text, other) AS s", "other AS text"), "s.Text")):
        out = toxicity.score(docs, model, text_col=name)
        assert out.columns == [*docs.columns, "score"] and np.allclose(sorted(r["score"] for r in out.collect()), sorted(want))
        assert rows(out.drop("score")) == rows(docs)


def test_the_words_kept_are_few():
    cache = toxicity._Terms()
    assert all(cache[f"w{i}"] == toxicity.terms(f"w{i}") for i in range(0, 300_000, 7)) and all(cache[f"v{i}"] for i in range(200_000))
    assert len(cache) <= 1 << 17


def test_the_remainder_is_that_of_the_text_of_the_id(spark):
    import zlib

    got = rows(spark.range(50).select("id", toxicity.remainder("id").alias("r")))
    assert got == [(i, zlib.crc32(str(i).encode()) % 5) for i in range(50)]
