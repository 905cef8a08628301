import hashlib
from collections import Counter

import pytest
from support import rows

from tideset.llm import sharding

from texts import AWKWARD


def filled(shards, slots):
    """The table, told plainly: each shard walks its permutation."""
    owner, walks = {}, []
    for name in shards:
        d = hashlib.md5(name.encode()).digest()
        at, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        walks.append([(at + i * skip) % slots for i in range(slots)])
        assert len(set(walks[-1])) == slots
    while len(owner) < slots:
        for i, walk in enumerate(walks):
            free = next((s for s in walk if s not in owner), None)
            if free is not None:
                owner[free] = i
    return [owner[s] for s in range(slots)]


def test_shards_take_turns():
    names = [f"n{i}" for i in range(5)]
    assert sharding.lookup_table(names, 101) == filled(names, 101)
    full = Counter(sharding.lookup_table([f"n{i}" for i in range(64)]))
    assert max(full.values()) - min(full.values()) <= 1
    assert Counter(sharding.lookup_table(["a", "b"], 1009, [1, 3]))[1] in (756, 757)


def test_a_new_shard_moves_little():
    before, after = (sharding.lookup_table([f"n{i}" for i in range(n)]) for n in (20, 21))
    moved = sum(a != b for a, b in zip(before, after, strict=True)) / len(before)
    assert 1 / 21 - 0.01 < moved < 2.5 / 21


@pytest.mark.parametrize("bad", [{"shards": []}, {"shards": ["a", "a"]}, {"shards": ["a"], "slots": 100}, {"shards": ["a", "b"], "slots": 101, "weights": [0, 0]}])
def test_bad_settings_are_told(bad):
    with pytest.raises(ValueError):
        sharding.lookup_table(**bad)


def test_awkward_rows(spark, awkward, tmp_path):
    names = [f"n{i}" for i in range(7)]
    df = spark.createDataFrame([(*r, 9) for r in awkward], AWKWARD + ", shard int")
    table = sharding.lookup_table(names, 101)
    out = sharding.shard(df, names, slots=101)
    assert out.count() == len(awkward) and set(out.columns) == {*df.columns, "slot"}
    for r in out.collect():
        key = str(r["doc_id"]) if r["doc_id"] is not None else "text:" + (r["text"] or "")
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    sharding.write_shards(out, str(tmp_path / "out"), files=2)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "doc_id", "shard") == rows(out, "doc_id", "shard")
    assert sharding.shard(df.limit(0), names, slots=101).count() == 0


def test_shards_are_written_whole_whatever_the_columns(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "IF(id % 4 = 0, NULL, id % 2) AS shard", "id % 3 AS _salt", "map('k', id) AS m")
    df = df.union(df)
    sharding.write_shards(df, str(tmp_path / "out"), files=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back.selectExpr("id", "shard", "_salt", "m['k']"), "id", "shard", "_salt", "m[k]") == rows(df.selectExpr("id", "shard", "_salt", "m['k']"), "id", "shard", "_salt", "m[k]")
    sharding.write_shards(df.limit(0), str(tmp_path / "none"))
    assert not [f for f in (tmp_path / "none").iterdir() if f.name.startswith("shard=")]
