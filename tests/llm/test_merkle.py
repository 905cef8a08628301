import hashlib
import random
from itertools import groupby

from pyspark.sql import functions as F
from support import rows

from tideset.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """The root of a list of nodes, and for each the (before, after) siblings on its way."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run, place = nodes[i // 3 * 3 : i // 3 * 3 + 3], i % 3
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
        nodes, at = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def brute(docs, altered):
    """docs: rows of FIELDS; altered: rows as they are now."""
    none_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    held = sorted(((none_first(d[1]), none_first(d[0]), leaf(d), leaf(a), d[0]) for d, a in zip(docs, altered, strict=True)), key=lambda r: r[:4])
    groups = [list(g) for _, g in groupby(held, key=lambda r: r[0])]
    subs = [climb([r[2] for r in g]) for g in groups]
    root, between = climb([s for s, _ in subs])
    out = []
    for g, (subroot, inside), above in zip(groups, subs, between, strict=True):
        for (_, _, h, x, i), path in zip(g, inside, strict=True):
            way, folded = path + above, x
            for before, after in way:
                folded = digest(before, folded, after)
            out.append((i, h, subroot, root, digest(*[s for pair in way for s in pair]), folded, folded == root))
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def test_trees_of_several_buckets_and_layers(spark):
    draw = random.Random(3)
    sizes = {"big": 250, "b": 82, "c": 1, "d": 9, "e": 10, "é": 27, None: 28, "": 2, **{f"s{i:02d}": 1 for i in range(12)}}
    docs = [(i, source, draw.choice(["en", None]), draw.choice([None, 3]), f"line\n{draw.random()}") for i, source in enumerate(s for s, n in sizes.items() for _ in range(n))]
    draw.shuffle(docs)
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], SCHEMA + ", level int")
    found = merkle.manifest(df, altered={"text": F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))}, depth=2)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(docs, [(*d[:4], d[4].replace("\n", "") if d[0] % 2 == 0 else d[4]) for d in docs])
    assert rows(found) == want and {r[-1] for r in want} == {True, False}
    assert all(r[-1] for r in rows(merkle.manifest(df, depth=3)))


def test_a_group_longer_than_a_bucket(spark):
    docs = [(i, "s" if i % 50 else "t", "en", 1, f"x{i}") for i in range(3**merkle.DEPTH * 3 + 100)]
    assert rows(merkle.manifest(spark.createDataFrame(docs, SCHEMA))) == brute(docs, docs)


def test_awkward_rows(spark, awkward):
    docs = [(i, s, None, None, t) for i, t, *_ in awkward for s in (None, "s")]
    docs += [(None, None, None, None, None), (3, "s", "l", -5, "\n"), (-3, "", "", 0, "")]
    assert rows(merkle.manifest(spark.createDataFrame(docs, SCHEMA))) == brute(docs, docs)
    one = [(7, "s", None, 1, "a\u0000b")]
    found = rows(merkle.manifest(spark.createDataFrame(one, SCHEMA)))
    assert found == [(7, leaf(one[0]), leaf(one[0]), leaf(one[0]), digest(), leaf(one[0]), True)]
    none = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_ids_of_text(spark):
    docs = [(f"d{i}", "s", f"t{i % 3}") for i in range(20)]
    found = rows(merkle.manifest(spark.createDataFrame(docs, "name string, host string, body string"), ["body", "name"], "name", "host"), "name", "leaf", "verified")
    assert found == sorted((a, leaf((c, a)), True) for a, _, c in docs)
