import random

from pyspark.sql import functions as F
from support import rows

from tideset.operators import bitmaps, changes, greedy
from tideset.plans import Kept, Progress, cut, observed


def lives(seed, n=60):
    draw = random.Random(seed)
    return [(t, draw.randrange(4), draw.randrange(4), draw.randint(1, 9)) for t in range(1, n)] + [(n, 1, 2, 3), (n + 3, 1, 2, 2)]  # one life follows another


def test_the_feed_tells_every_change_of_every_step(spark):
    data = lives(3)
    stream = spark.createDataFrame(data, "t long, u long, v long, l long")
    edges, nodes, held, degree = [], [], {}, {}
    for n in range(1, 90):
        now, ends = {}, {}
        for t, u, v, life in data:
            if t <= n < t + life and u != v:
                now[u, v] = now.get((u, v), 0) + 1
                for x in (u, v):
                    ends[x] = ends.get(x, 0) + 1
        for e in sorted({*now, *held}):
            a, b = held.get(e, 0), now.get(e, 0)
            if a != b:
                edges.append((n, *e, b, "insert" if not a else "erase" if not b else "change"))
        nodes += [(n, x, "insert" if x in ends else "erase") for x in sorted({*ends, *degree}) if (x in ends) != (x in degree)]
        held, degree = now, ends
    feed = changes.edge_changes(stream)
    assert rows(feed, "n", "u", "v", "x", "change") == sorted(edges) and {e[-1] for e in edges} == {"insert", "change", "erase"}
    assert rows(changes.vertex_changes(stream), "n", "x", "change") == sorted(nodes)
    for step in (7, 33):
        want = sorted((u, v, sum(t <= step < t + life and (a, b) == (u, v) for t, a, b, life in data)) for u, v in {(u, v) for t, u, v, life in data if t <= step < t + life and u != v})
        assert rows(changes.at_step(feed, step, ["u", "v"], ["x"])) == want


def test_bitmaps_give_the_rewards_of_rows(spark):
    draw = random.Random(6)
    data = [(g, draw.randrange(8), draw.choice([0, 1, draw.randrange(100), 32_768 * draw.randrange(4) + draw.randrange(9), 10**9])) for g in range(3) for _ in range(90)]
    pairs = spark.createDataFrame(data, "snap int, v long, u long")
    cover = {}
    for g, v, u in data:
        cover.setdefault((g, v), set()).add(u)
    maps = bitmaps.bitmaps(pairs, ["snap"])
    assert rows(bitmaps.node_reward(maps, ["snap"])) == sorted((*k, len(c)) for k, c in cover.items())
    chosen = spark.createDataFrame([(2,), (5,), (99,)], "v long")
    own = {g: cover.get((g, 2), set()) | cover.get((g, 5), set()) for g in range(3)}
    assert rows(bitmaps.set_reward(maps, chosen, ["snap"])) == sorted((g, len(c)) for g, c in own.items())
    covered = bitmaps.union(maps.join(chosen, "v", "left_semi"), ["snap"])
    assert rows(bitmaps.gains(maps, covered, ["snap"])) == sorted((g, v, len(c - own[g])) for (g, v), c in cover.items())
    assert rows(bitmaps.max_coverage(pairs, 9), "snap", "rank", "v", "gain") == rows(greedy.max_coverage(pairs, 9), "snap", "rank", "v", "gain")


def test_kept_deltas_are_one_table(spark):
    kept = Kept(cut(spark.range(1)))
    for i in range(1, 23):
        kept.add(cut(spark.range(i, i + 1)))
    assert rows(kept.table()) == [(i,) for i in range(23)] and len(kept._parts) < 8


def test_figures_are_gathered_while_a_run_goes(spark, tmp_path):
    df, told = observed(spark.range(100).where("id % 3 = 0"), rows=F.count("*"), last=F.max("id"))
    df.write.parquet(str(tmp_path / "out"))
    assert told.get == {"rows": 34, "last": 99}
    for i in range(3):
        spark.range(10 * i, 10 * i + 5 + i).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    heard = Progress()
    spark.streams.addListener(heard)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("seen", F.count("*").alias("n"), F.max("id").alias("top"))
        query = stream.writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):  # events come by a queue of their own
            if sum(b["rows"] for b in heard.batches) >= 18:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    assert sum(b["rows"] for b in heard.batches) == 18 and {b["query"] for b in heard.batches} == {"watched"}
    assert sorted(b["metrics"]["seen"]["n"] for b in heard.batches if b["rows"]) == [5, 6, 7] and max(b["metrics"]["seen"]["top"] for b in heard.batches if b["rows"]) == 26
