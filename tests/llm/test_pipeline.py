import sys
from pathlib import Path

import pytest
from support import rows

from tideset.llm import decontaminate, toxicity

sys.path.insert(0, str(Path(__file__).parent.parent.parent))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_decontaminate import brute as leaks  # noqa: E402
from test_line_dedup import marked  # noqa: E402
from test_near_dedup import brute as groups  # noqa: E402
from test_packing import check  # noqa: E402
from texts import words  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_stage_does_its_work_on_all_that_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns, results = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
        results.append((name, [tuple(r) for r in before.select("doc_id", "text").collect()], docs))
    texts = {name: dict(rows(df, "doc_id", "text")) for name, _, df in results[:4]}

    before = dict(results[0][1])
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where(toxicity.remainder("doc_id") != 0))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert texts["toxicity"] == {i: t for i, t in before.items() if scores[i] < 0.5}

    assert texts["line_dedup"].keys() == texts["toxicity"].keys()
    marks = marked([(i, t or "") for i, t in texts["toxicity"].items()])
    for i, t in texts["line_dedup"].items():
        assert words(t) == [w for w, gone in zip(words(texts["toxicity"][i]), marks[i], strict=True) if not gone]
    assert rows(results[1][2].selectExpr("bool_and(n_chars = length(text)) AS ok")) == [(True,)]

    kept = {i for i, _, _, k in groups(sorted(texts["line_dedup"].items())) if k}
    assert texts["near_dedup"] == {i: t for i, t in texts["line_dedup"].items() if i in kept}
    dirty = {r[0] for r in leaks(sorted(texts["near_dedup"].items()), items)}
    assert texts["decontamination"] == {i: t for i, t in texts["near_dedup"].items() if i not in dirty}
    check(results[4][2].collect(), sorted(texts["decontamination"].items()))
    assert rows(corpus_pipeline.run(spark, SF)) == rows(results[4][2])


def test_all_stages_bear_awkward_rows_and_columns_of_any_name(spark, awkward):
    names = "doc_id long, text string, id int, h string, row string, score double, source string, n_chars long, _score double, removed string, n_removed long, kept string, component_id long, label int, found string, places string, REP long"
    docs = spark.createDataFrame([(*r, 3, 9.0, "x", -5, "k", 4, 1, "f", "p", 8) for r in awkward], names)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.select(*others).distinct().collect() == docs.select(*others).distinct().collect(), name
        ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out.select("doc_id").collect())
        gone = {5, 7, 9} if name == "near_dedup" else set()
        assert ids == sorted((i is not None, i or 0) for i, *_ in awkward if i not in gone), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("doc_id").agg({"length": "sum"}).count() == len({i for i, *_ in awkward})


def test_all_stages_bear_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    assert decontaminate.clean(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_stages_bound_the_bytes_of_arrow_batches(spark):
    def counted(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([sum(1 for _ in batches)])], ["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    wide = spark.range(40, numPartitions=1).selectExpr("repeat(string(id % 10), 1000000) AS text")
    try:
        for step, stage in corpus_pipeline.STAGES:
            if step != "decontamination":  # without Python workers
                for given in ("64m", "1g", "67108864"):
                    spark.conf.set(name, given)
                    stage(spark, docs, SF)
                    assert spark.conf.get(name) == f"{4 << 20}b", step
        assert wide.mapInArrow(counted, "n long").first()["n"] >= 8
        spark.conf.set(name, "1m")
        corpus_pipeline.sequence_packing(spark, docs, SF)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
