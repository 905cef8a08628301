import duckdb
import numpy as np
import pytest
from support import rows

from tideset.llm import line_dedup, queries
from tideset.llm.common import grams, word_hashes

from texts import AWKWARD, words


def marked(docs, n=50):
    """For each document the words in runs of n that stand at an earlier place."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        w = words(text)
        marks = [False] * len(w)
        for j in range(len(w) - n + 1):
            g = tuple(w[j : j + n])
            if g in seen:
                marks[j : j + n] = [True] * n
            seen.add(g)
        out[i] = marks
    return out


def test_runs_that_repeat_go_and_nothing_else(spark, corpus):
    got = {r["doc_id"]: r for r in line_dedup.repeated_runs(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    total = 0
    for i, marks in marked(corpus).items():
        gone = {p for s in got[i]["removed"] for p in range(s["start"], s["start"] + s["length"])}
        assert gone == {p for p, m in enumerate(marks) if m}
        w = words(dict(corpus)[i])
        assert words(got[i]["text"]) == [x for p, x in enumerate(w) if p not in gone]
        assert got[i]["n_removed"] == len(gone)
        total += sum(marks)
    assert total > 500


@pytest.mark.parametrize("part", [26, 40, 49])
def test_an_earlier_part_of_a_passage_does_not_hide_it(spark, part):
    passage = [f"p{i}" for i in range(55)]
    docs = [(i, " ".join([f"a{i}", *passage[3 : 3 + part], f"b{i}"])) for i in range(3)] + [(10 + i, " ".join([f"a{i}x", *passage, f"b{i}x"])) for i in range(4)]
    docs += [(20, " ".join(["and"] * 300)), (21, " ".join(["and"] * 80 + ["so"] + ["and"] * 60)), (22, " ".join(["a b"] * 90))]
    got = rows(line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_removed")
    assert got == sorted((i, sum(m)) for i, m in marked(docs).items())
    assert dict(got)[10] == 0 and dict(got)[11] == dict(got)[13] == 55


def test_every_repeated_word_of_the_documents_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = marked([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: sum(x["length"] for x in r["removed"]) for r in line_dedup.repeated_runs(docs).collect()}
    assert got == {i: sum(m) for i, m in want.items()} and sum(got.values()) > 40_000


def test_a_passage_planted_in_many_texts_stays_once(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    docs = [(i, f"a{i} b{i}\n{passage} c{i}\nd{i}") for i in range(40)]
    got = rows(line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "text")
    assert got[0] == docs[0] and got[1:] == [(i, f"a{i} b{i}\nc{i}\nd{i}") for i in range(1, 40)]
    short = [(i, f"a{i} {' '.join(f'p{j}' for j in range(49))} c{i}") for i in range(9)]
    assert rows(line_dedup.repeated_runs(spark.createDataFrame(short, "doc_id long, text string")), "doc_id", "text") == short


def test_awkward_rows(spark, awkward):
    df = spark.createDataFrame(awkward, AWKWARD)
    out = line_dedup.repeated_runs(df)
    assert out.columns == [*df.columns, "removed", "n_removed"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    texts = {i: t for i, t, *_ in awkward}
    assert [len(got[i]) for i in (None, 7)] == [2, 2] and all(r["n_removed"] == 0 for r in got[None])
    assert got[1][0]["text"] == "" and got[3][0]["text"] == " \n\t "
    assert got[4][0]["text"] == texts[4] and got[5][0]["text"] == "end" and got[5][0]["n_removed"] == 60_000
    assert got[6][0]["text"] == texts[6] and [r["text"] for r in got[7]] == ["", ""]
    assert got[11][0]["text"] == texts[11] and got[10][0]["source"] == "s"
    assert line_dedup.repeated_runs(spark.createDataFrame([], AWKWARD)).count() == 0


def test_selected_positions_are_the_minima_of_windows():
    draw = np.random.default_rng(1)
    for n in (0, 4, 5, 6, 50, 333):
        h = draw.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1)
        h[: n // 3] = h[0] if n else 0
        want = sorted({max(range(j, j + 5), key=lambda p: (-int(h[p] >> np.uint64(24)), p)) for j in range(n - 4)})
        assert line_dedup.select(h, 5).tolist() == want


def test_word_hashes_are_of_the_words_alone():
    texts = [b"", b" \n", b"Abc abC\tdef", "é ABC\x0b\x0c É".encode(), b"x" * 3_000_000, b"ab c " * 900_000]
    for text in texts:
        found = text.lower().split()
        hashes = word_hashes(text)
        assert len(hashes) == len(found)
        names = dict(zip(found, hashes.tolist(), strict=True))
        assert [names[w] for w in found] == hashes.tolist() and len(set(names.values())) == len(names)
    a, b = word_hashes(b"q r s t u v"), word_hashes(b"r s t u")
    assert grams(a, 4)[1] == grams(b, 4)[0] and len(grams(b, 9)) == 1 and len(grams(a[:0], 3)) == 0


def test_removed_words_are_those_of_the_sql(spark):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert rows(queries.line_dedup_words(spark, sf), "doc_id", "n_removed") == sorted(con.execute(queries.ORACLES["line_dedup_words"]).fetchall())
