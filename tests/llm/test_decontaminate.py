import random

from support import rows

from tideset.llm import decontaminate

from texts import AWKWARD, prose, shingles

ITEMS = "item_id long, text string, doc_id long"


def brute(docs, items):
    sets = {}
    for i, t in docs:
        if i is not None and t is not None:
            sets.setdefault(i, []).append(t)
    out = []
    for j, q in items:
        own = shingles(q)
        m = len(next(iter(own))) if own else 0
        for i, texts in sets.items():
            held = {g for t in texts for g in shingles(t, m) if len(g) == m} if m else set()
            if own and 100 * len(own & held) >= 75 * len(own):
                out.append((i, j, len(own & held), len(own)))
    return sorted(out)


def test_items_are_found_in_long_documents(spark, corpus):
    draw = random.Random(3)
    items = [(j, prose(draw, n)) for j, n in enumerate((1, 3, 5, 6, 9, 14, 25, 40, 70, 130))]
    docs = list(corpus)
    for j, q in items:
        w = q.split()
        docs.append((1000 + j, f"{prose(draw, 400)} {q.replace('a', 'A')} {prose(draw, 900)}"))
        docs.append((2000 + j, f"{prose(draw, 30)} {' '.join(w[: max(1, len(w) * 9 // 10)])} {prose(draw, 30)}"))
        docs.append((3000 + j, f"{prose(draw, 30)} {' '.join(w[: len(w) // 2])} {prose(draw, 30)}"))
    df = spark.createDataFrame([(j, q, 7) for j, q in items], ITEMS)
    got = rows(decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), df))
    assert got == brute(docs, items)
    assert {(1000 + j, j) for j, _ in items} <= {r[:2] for r in got}


def test_awkward_rows(spark, awkward):
    items = [(None, "x"), (1, None), (2, ""), (3, "x"), (3, "x"), (4, " ".join(awkward[5][1].split()[30_000:30_020])), (5, awkward[7][1])]
    df = spark.createDataFrame([(*r, 0) for r in items], ITEMS)
    docs = spark.createDataFrame(awkward, AWKWARD)
    assert rows(decontaminate.contaminated(docs, df), "doc_id", "item_id") == [(4, 4), (5, 4), (6, 5), (7, 5), (8, 3), (9, 3)]
    clean = decontaminate.clean(docs, df)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {None, 1, 2, 3, 10, 11}
    assert decontaminate.contaminated(docs, df.limit(0)).count() == 0 and decontaminate.clean(docs, df.limit(0)).count() == len(awkward)
    assert decontaminate.contaminated(docs.limit(0), df).count() == 0
