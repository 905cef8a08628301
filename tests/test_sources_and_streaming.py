import gzip
import random

from support import rows

from tideset import sources
from tideset.operators import pruned_list
from tideset.streaming import alive_counts, run_stream


def test_text_streams_keep_the_order_of_their_lines(spark, tmp_path):
    data = [(random.Random(i).randrange(50), random.Random(i + 1).randrange(9), i % 7 + 1) for i in range(300)]
    with gzip.open(tmp_path / "s.tsv.gz", "wt") as f:
        f.write("# u v l\n" + "".join(f"{u}\t{v}\t{l}\n" for u, v, l in data))
    got = rows(sources.read_interactions(spark, str(tmp_path / "s.tsv.gz")))
    assert got == [(t, *r) for t, r in enumerate(data, 1)]
    with open(tmp_path / "two.tsv", "w") as f:
        f.write("".join(f"{u}\t{v}\n" for u, v, _ in data))
    assert rows(sources.read_interactions(spark, str(tmp_path / "two.tsv"), lifetimes=False)) == [(t, u, v, 1) for t, (u, v, _) in enumerate(data, 1)]


def test_graph_node_and_map_files(spark, tmp_path):
    (tmp_path / "g").write_text("1 2 0.5\n2 3 0.25\n")
    (tmp_path / "n").write_text("4\n7\n4\n")
    (tmp_path / "m").write_text("10\t4\n20\t7\n")
    assert rows(sources.read_weighted(spark, str(tmp_path / "g"))) == [(1, 2, 0.5), (2, 3, 0.25)]
    assert rows(sources.read_nodes(spark, str(tmp_path / "n"))) == [(4,), (7,)]
    assert rows(sources.read_map(spark, str(tmp_path / "m"))) == [(4, 10), (7, 20)]


def test_results_are_written_and_read_again(spark, tmp_path):
    series = spark.createDataFrame([(1, 2.5, 7)], "t long, value double, calls long")
    for k in (5, 10):
        sources.write_series(series, str(tmp_path / "r"), settings={"k": k, "eps": 0.2})
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r"))
    assert rows(back, "t", "value", "k") == [("1", "2.50", 5), ("1", "2.50", 10)]
    sources.write_nodes(spark.createDataFrame([([3, 1],)], "v array<long>"), str(tmp_path / "nodes"))
    assert rows(sources.read_nodes(spark, str(tmp_path / "nodes"))) == [(1,), (3,)]
    alive = spark.createDataFrame([(1, 2), (1, 2)], "u long, v long")
    sources.write_snapshot(alive, str(tmp_path / "a"))
    sources.write_snapshot(alive, str(tmp_path / "b"), distinct=True)
    assert (spark.read.csv(str(tmp_path / "a")).count(), spark.read.csv(str(tmp_path / "b")).count()) == (2, 1)


def test_streaming_gives_the_batch_rows(spark, tmp_path):
    draw = random.Random(6)
    data = [(draw.choice("ab"), t, draw.randrange(9), draw.randrange(6), draw.randint(1, 12)) for t in range(1, 121)]
    schema = "key string, t long, u long, v long, l long"
    for i in range(3):
        spark.createDataFrame(data[40 * i : 40 * i + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = run_stream(source, 3, 0.2).writeStream.format("memory").queryName("listed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = rows(pruned_list.run_list(spark.createDataFrame(data, schema), 3, 0.2, ["key"]))
    assert rows(spark.table("listed")) == want


def test_late_rows_are_told_and_change_nothing(spark, tmp_path):
    schema = "key string, t long, u long, v long, l long"
    for part in ([("a", 1, 1, 1, 5), ("a", 4, 2, 1, 5)], [("a", 3, 3, 1, 5), ("a", 5, 4, 1, 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = run_stream(source, 2, 0.2, idle="3600000").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["t"], r["value"]) for r in spark.table("late").collect() if r["t"] != 3) == [(1, 1), (4, 2), (5, 3)]
    assert [r["value"] for r in spark.table("late").collect() if r["t"] == 3] == [None]


def test_windows_of_arrivals(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(id * 30) AS ts, id % 2 AS v FROM range(20)").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, v long").parquet(str(tmp_path / "in"))
    query = alive_counts(source, "ts", "1 minute", "2 minutes").writeStream.outputMode("append").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counted").count() > 0 and {r["n"] for r in spark.table("counted").collect()} == {2}
