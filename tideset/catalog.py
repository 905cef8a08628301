"""Queries over the standard tables, one for each operator, and the SQL that gives the same rows where SQL can express them.

The stream is that of `events` (see `sources.from_events`). Snapshots lie at the middle of the stream, or on a grid of its twentieths.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import experiments
from .functions import activation
from .operators import baselines, bitmaps, changes, expiry_list, graphs, greedy, influence, lifetimes, pruned_list, registers, repair, rewards, sieve
from .plans import cut, observed, shared_path
from .sources import directed, from_events, from_orders, read_edges, read_interactions, read_map, read_nodes, read_weighted, write_nodes, write_series, write_snapshot
from .streaming import alive_counts, keep_sieve, live_rewards, run_stream, sieved

K, EPS, SKETCHES, LONG, MIXED, LANES = 5, 0.2, 200, 20, 3, 64


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.valid(from_events(spark, sf_dir), 100)


def _length(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


def _middle(spark: SparkSession, sf_dir: str) -> int:
    return _length(spark, sf_dir) // 2


def _grid(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    every = max(1, _length(spark, sf_dir) // 20)
    return every, 20 * every, every


def _alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.alive_at(_stream(spark, sf_dir), _middle(spark, sf_dir))


def _on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.alive_on(_stream(spark, sf_dir), *_grid(spark, sf_dir))


def _graph(spark: SparkSession, sf_dir: str, after: int = 0, longer: int = 1) -> DataFrame:
    """The directed rows alive at the middle (or `after` it), with lifetimes times `longer`."""
    rows = directed(_stream(spark, sf_dir)).withColumn("l", F.col("l") * longer)
    return lifetimes.alive_at(rows, _middle(spark, sf_dir) + after)


def _given(spark: SparkSession) -> DataFrame:
    return spark.range(0, 100, 10).select(F.col("id").alias("v"))


def stream_edges(spark, sf_dir):
    return _stream(spark, sf_dir)


def directed_edges(spark, sf_dir):
    return directed(_stream(spark, sf_dir))


def alive_edges(spark, sf_dir):
    return _alive(spark, sf_dir).select("t", "u", "v", "l")


def alive_size_per_step(spark, sf_dir):
    return lifetimes.size_per_step(_stream(spark, sf_dir))


def prefix_reward(spark, sf_dir):
    return rewards.reward_so_far(rewards.first_times(_stream(spark, sf_dir))).select("v", "n", F.col("reward").cast("long").alias("reward"))


def _steps(steps: DataFrame) -> DataFrame:
    return steps.groupBy("step").agg(F.count("*").alias("n_rows"), F.countDistinct("v").alias("n_affected"), F.max("t").alias("last_row"))


def batch_steps(spark, sf_dir):
    """Steps of 64 arrivals, and the row at which each ends."""
    return _steps(lifetimes.in_batches(_stream(spark, sf_dir), 64))


def batch_steps_to_end(spark, sf_dir):
    """The first ten steps of 30 arrivals: a run that is stopped."""
    return _steps(lifetimes.in_batches(_stream(spark, sf_dir), 30, end=10))


def venue_reward(spark, sf_dir):
    return rewards.node_reward(_alive(spark, sf_dir))


def max_singleton_per_step(spark, sf_dir):
    n = _length(spark, sf_dir)
    each = lifetimes.alive_on(_stream(spark, sf_dir), 1, n, 1)
    return rewards.node_reward(each, ["snap"]).groupBy("snap").agg(F.max("reward").alias("most"))


def set_reward(spark, sf_dir):
    return rewards.set_reward(_on_grid(spark, sf_dir), _given(spark), ["snap"])


def set_gain(spark, sf_dir):
    return rewards.gains(_alive(spark, sf_dir), _given(spark))


def given_set_eval(spark, sf_dir):
    last = lifetimes.alive_at(_stream(spark, sf_dir), _length(spark, sf_dir))
    return rewards.set_reward(last, _given(spark))


def largest_reward_so_far(spark, sf_dir):
    return rewards.largest_so_far(rewards.first_times(_stream(spark, sf_dir))).select("n", F.col("most").cast("long").alias("most"))


def threshold_ranges(spark, sf_dir):
    first = rewards.first_times(_stream(spark, sf_dir).withColumn("stream", F.lit(0)), ["stream"])
    return sieve.index_ranges(first, K, EPS, ["stream"]).select("i", "since", F.coalesce("until", F.lit(-1)).alias("until"))


def greedy_at(spark, sf_dir):
    picks = greedy.max_coverage(_alive(spark, sf_dir).withColumn("snap", F.lit(_middle(spark, sf_dir)).cast("long")), 10)
    return picks.select("snap", F.col("rank").cast("long").alias("rank"), "v", "gain", "calls")


def greedy_per_snapshot(spark, sf_dir):
    best = greedy.solution_value(greedy.max_coverage(_on_grid(spark, sf_dir), K))
    return best.select("snap", "value", F.array_join("nodes", ",").alias("nodes"), "calls")


def greedy_prefix(spark, sf_dir):
    grown = lifetimes.prefixes(_stream(spark, sf_dir), *_grid(spark, sf_dir))
    return greedy.solution_value(greedy.max_coverage(grown, K)).select("snap", "value")


def greedy_orders(spark, sf_dir):
    """The largest stream of the tables: customers and suppliers; the suppliers that reach most customers on each twentieth."""
    stream = cut(lifetimes.valid(from_orders(spark, sf_dir)))
    every = max(1, stream.count() // 20)
    return greedy.solution_value(greedy.max_coverage(lifetimes.alive_on(stream, every, 20 * every, every), K)).select("snap", "value")


def naive_calls(spark, sf_dir):
    return baselines.naive_calls(_on_grid(spark, sf_dir), K)


def random_baseline(spark, sf_dir):
    return baselines.random_value(_on_grid(spark, sf_dir), K, 3).select("snap", F.round("value", 6).alias("value"))


def _told(sets, ranges, first, points, by):
    """The best set with its nodes as text, and the gains weighed for all indices."""
    calls = sieve.gains_weighed(sets, ranges, points, K, by).groupBy(*by).agg(F.sum("calls").alias("calls"))
    best = sieve.best_set(sets, ranges, first, by)
    return best.join(calls, list(by)).select(*by, "value", F.col("i").cast("long").alias("i"), F.array_join("nodes", ",").alias("nodes"), "calls")


def _grown(spark, sf_dir):
    rows = cut(_stream(spark, sf_dir).withColumn("stream", F.lit(0)))
    return rewards.first_times(rows, ["stream"]), rows.select("stream", "v", F.col("t").alias("n"))


def sieve_prefix(spark, sf_dir):
    first, points = _grown(spark, sf_dir)
    sets, ranges = sieve.sieve(first, points, K, EPS, ["stream"])
    return _told(sets, ranges, first, points, ["stream"]).drop("stream")


def sieve_series(spark, sf_dir):
    first, points = _grown(spark, sf_dir)
    sets, ranges = sieve.sieve(first, points, K, EPS, ["stream"])
    return sieve.value_per_step(sets, ranges, first, ["stream"]).drop("stream")


def lifetime_reduction(spark, sf_dir):
    rows = cut(_on_grid(spark, sf_dir))
    first, points = rewards.first_times(rows, ["snap"]), rows.select("snap", "v", F.col("t").alias("n"))
    sets, ranges = sieve.sieve(first, points, K, EPS)
    return _told(sets, ranges, first, points, ["snap"])


def _lanes(stream: DataFrame, lanes: int) -> DataFrame:
    """The stream dealt to groups of venues."""
    return stream.withColumn("lane", F.pmod("v", F.lit(lanes)).cast("int"))


def pruned_list_series(spark, sf_dir):
    return pruned_list.run_list(_lanes(_stream(spark, sf_dir), LANES), K, EPS, ["lane"])


def pruned_list_batches(spark, sf_dir):
    """The list of the whole stream, not dealt by keys, after each of three batches; lifetimes are stretched to outlive a batch."""
    n = _length(spark, sf_dir)
    stream = cut(_stream(spark, sf_dir).withColumn("l", F.col("l") * max(1, n // 250)))
    kept = expiry_list.ExpiryList(spark, shared_path(spark, "list"), K, EPS, max(1, n // 20))
    for part in range(3):
        kept.take(stream.where((F.col("t") > part * n // 3) & (F.col("t") <= (part + 1) * n // 3)), part)
    return kept.told(spark).withColumn("nodes", F.array_join("nodes", ","))


def solution_quality(spark, sf_dir):
    """Each solver's value, and its share of greedy's, on the grid and by groups of venues."""
    values = experiments.solver_values(_lanes(_stream(spark, sf_dir), 4), *_grid(spark, sf_dir), K, EPS, by=["lane"])
    best = values.where("solver = 'greedy'").select("lane", "snap", F.col("value").alias("best"))
    return values.join(best, ["lane", "snap"]).select("lane", "snap", "solver", F.round("value", 6).alias("value"), F.round(F.col("value") / F.col("best"), 6).alias("share"))


def greedy_by_budget(spark, sf_dir):
    return experiments.greedy_by_budget(greedy.max_coverage(_on_grid(spark, sf_dir), 10))


def pruned_list_sweep(spark, sf_dir):
    """The pruned list of each group of venues over budgets, eps and longest lifetimes, at every 100th step."""
    return experiments.run_settings(_lanes(from_events(spark, sf_dir, 200), LANES), [(5, 0.2, 100), (10, 0.2, 100), (5, 0.1, 100), (5, 0.2, 200)], 100, by=["lane"])


def reach_size(spark, sf_dir):
    return rewards.node_reward(graphs.reach(graphs.edges(_graph(spark, sf_dir)))).select(F.col("v").alias("x"), "reward")


def reach_gain(spark, sf_dir):
    pairs = graphs.reach(graphs.edges(_graph(spark, sf_dir)))
    return rewards.gains(pairs, _given(spark)).select(F.col("v").alias("x"), "gain")


def greedy_reach(spark, sf_dir):
    rows = lifetimes.alive_on(directed(_stream(spark, sf_dir)), *_grid(spark, sf_dir))
    return greedy.solution_value(greedy.max_coverage(graphs.reach(graphs.edges(rows, ["snap"]), ["snap"]), K)).select("snap", "value")


def reduction_reach(spark, sf_dir):
    rows = cut(lifetimes.alive_on(directed(_stream(spark, sf_dir)), *_grid(spark, sf_dir)))
    first = cut(graphs.reach_times(rows, ["snap"]))
    points = first.select("snap", "v", F.col("ft").alias("n"))
    sets, ranges = sieve.sieve(first, points, K, EPS)
    return _told(sets, ranges, first, points, ["snap"])


def reach_of_set(spark, sf_dir):
    """How many nodes a set reaches together, exact and by the union of sketches (see `sketched_reach`)."""
    pairs = cut(graphs.reach(graphs.edges(_graph(spark, sf_dir, longer=LONG))))
    exact, union = rewards.set_reward(pairs, _given(spark)), rewards.sketched_reward(rewards.node_sketches(pairs), _given(spark))
    both = exact.withColumn("all", F.lit(0)).join(union.select(F.lit(0).alias("all"), F.col("reward").alias("sketched")), "all")
    return both.select("reward", (F.abs(F.col("sketched") - F.col("reward")) <= 1 + 3 * 1.04 / 64 * F.col("reward")).alias("close"))


def reach_gain_longer(spark, sf_dir):
    """Gains over a set on a graph whose rows live `LONG` times as long, as it grows with the stream."""
    return rewards.gains(graphs.reach(graphs.edges(_graph(spark, sf_dir, longer=LONG))), _given(spark)).select(F.col("v").alias("x"), "gain")


def affected_nodes(spark, sf_dir):
    before, after = (graphs.reach(graphs.edges(_graph(spark, sf_dir, i))) for i in (0, 1))
    return graphs.affected(before, after).select(F.col("v").alias("x"))


def scc(spark, sf_dir):
    return graphs.components(graphs.edges(_graph(spark, sf_dir, longer=MIXED)))


def scc_edges(spark, sf_dir):
    edges = cut(graphs.edges(_graph(spark, sf_dir, longer=MIXED)))
    return graphs.condensed(edges, graphs.components(edges))


def _graphs(spark, sf_dir):
    """The directed edges (snap, u, v) alive on the grid, with lifetimes times `MIXED`."""
    rows = directed(_stream(spark, sf_dir)).withColumn("l", F.col("l") * MIXED)
    return cut(graphs.edges(lifetimes.alive_on(rows, *_grid(spark, sf_dir)), ["snap"]))


def _registers(rows):
    return rows.select("snap", "x", F.col("register").cast("long").alias("register"), F.col("rank").cast("long").alias("rank"))


def reach_registers(spark, sf_dir):
    """The registers of what each node reaches on each snapshot, sent along edges."""
    return _registers(registers.propagated(_graphs(spark, sf_dir), ["snap"]))


def reach_registers_by_levels(spark, sf_dir):
    """The same, by one merge for each level of the condensation."""
    return _registers(registers.by_levels(_graphs(spark, sf_dir), ["snap"]))


def reach_estimate(spark, sf_dir):
    found = registers.estimated(registers.propagated(_graphs(spark, sf_dir), ["snap"]), ["snap", "x"])
    return found.select("snap", "x", F.round("reward", 6).alias("reward"))


def _given_nodes(spark):
    return _given(spark).withColumnRenamed("v", "x")


def reach_set_estimate(spark, sf_dir):
    found = registers.set_reward(registers.propagated(_graphs(spark, sf_dir), ["snap"]), _given_nodes(spark), ["snap"])
    return found.select("snap", F.round("reward", 6).alias("reward"))


def reach_gain_estimate(spark, sf_dir):
    found = registers.gains(cut(registers.propagated(_graphs(spark, sf_dir), ["snap"])), _given_nodes(spark), ["snap"])
    return found.select("snap", "x", F.round("gain", 6).alias("gain"))


def scc_levels(spark, sf_dir):
    """The level of each component of each snapshot: how many edges the longest way down from it has."""
    edges = _graphs(spark, sf_dir)
    scc = cut(graphs.components(edges, ["snap"]))
    found = graphs.levels(graphs.condensed(edges, scc, ["snap"]), scc.select("snap", F.col("scc").alias("x")), ["snap"])
    return found.select("snap", "x", F.col("level").cast("long").alias("level"))


def reach_size_by_levels(spark, sf_dir):
    return graphs.reach_by_levels(_graphs(spark, sf_dir), ["snap"])


def affected_by_batches(spark, sf_dir):
    """The nodes whose reach grows with each eighth of the directed stream, which is never forgotten."""
    every = max(1, _length(spark, sf_dir) // 8)
    stream = directed(_stream(spark, sf_dir)).withColumn("step", (F.floor((F.col("t") - 1) / every) + 1).cast("long"))
    return graphs.affected_by_batches(stream)


def sketched_reach(spark, sf_dir):
    """Exact and sketched rewards; `close` holds within three standard errors of 2 ** 12 registers, and one."""
    pairs = cut(graphs.reach(graphs.edges(_graph(spark, sf_dir, longer=LONG))))
    both = rewards.node_reward(pairs).join(rewards.sketched_reward(rewards.node_sketches(pairs)).withColumnRenamed("reward", "sketched"), "v")
    return both.select(F.col("v").alias("x"), "reward", (F.abs(F.col("sketched") - F.col("reward")) <= 1 + 3 * 1.04 / 64 * F.col("reward")).alias("close"))


def edge_probabilities(spark, sf_dir):
    return influence.multiplicities(_graph(spark, sf_dir, longer=LONG)).select("u", "v", "x", F.round(activation(F.col("x")), 6).alias("p"))


def node_degrees(spark, sf_dir):
    return influence.degrees(_graph(spark, sf_dir, longer=LONG))


def _sketches(spark, sf_dir, after: int = 0):
    graph = cut(influence.multiplicities(_graph(spark, sf_dir, after)))
    return influence.sketch_nodes(graph, SKETCHES), graph


def influence_sketches(spark, sf_dir):
    return _sketches(spark, sf_dir)[0]


def sketch_weights(spark, sf_dir):
    return influence.sketch_weights(*_sketches(spark, sf_dir))


def sketch_budget(spark, sf_dir):
    """The sketches that a budget of beta = 2 asks for, more than are drawn at first, and their weights."""
    graph = cut(influence.multiplicities(_graph(spark, sf_dir)))
    return influence.sketch_weights(influence.enough_sketches(graph, 2.0, SKETCHES), graph)


def influence_maximization(spark, sf_dir):
    held = _sketches(spark, sf_dir)[0]
    pairs = held.select(F.lit(0).alias("all"), F.col("x").alias("v"), F.col("s").alias("u"))
    return greedy.max_coverage(pairs, 10, ["all"]).select(F.col("rank").cast("long").alias("rank"), F.col("v").alias("x"), "gain")


def influence_estimate(spark, sf_dir):
    held, graph = _sketches(spark, sf_dir)
    return influence.influence(held, nodes=graphs.nodes(graph)).select("x", F.round("influence", 6).alias("influence"))


def sketch_update(spark, sf_dir):
    """The rows that sketches gain and lose when the graph moves on by one step."""
    before, after = (_sketches(spark, sf_dir, i)[0] for i in (0, 1))
    gained = after.join(before, ["s", "x"], "left_anti").select("s", "x", F.lit("gained").alias("change"))
    return gained.union(before.join(after, ["s", "x"], "left_anti").select("s", "x", F.lit("lost").alias("change")))


def sketch_repair(spark, sf_dir):
    """The rows that sketches gain and lose over four moves of ten steps each, by repair of those that the changes touch."""
    rows = cut(directed(_stream(spark, sf_dir)).withColumn("l", F.col("l") * LONG))
    edges, vertices = cut(changes.edge_changes(rows)), cut(changes.vertex_changes(rows))
    slots = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("user_id")).first()[0] + 1
    at, told = _middle(spark, sf_dir), []
    kept = repair.KeptSketches(changes.at_step(edges, at, ["u", "v"], ["p"]), SKETCHES, slots)
    for step in range(1, 5):
        now = changes.at_step(edges, at + 10, ["u", "v"], ["p"])
        moved = kept.move(now, changes.between(edges, at, at + 10, ["u", "v"], F.col("p")), changes.between(vertices, at, at + 10, ["x"], F.lit(1)))
        told.append(moved.select(F.lit(step).alias("step"), "s", "x", "change"))
        at += 10
    return reduce(DataFrame.union, told)


def influence_of_set(spark, sf_dir):
    held, graph = _sketches(spark, sf_dir)
    return influence.influence(held, _given(spark).withColumnRenamed("v", "x"), nodes=graphs.nodes(graph)).select(F.round("influence", 6).alias("influence"))


def seeds_reach(spark, sf_dir):
    """Seeds by influence sketches on each snapshot of the grid, and how many nodes these reach together on the last one."""
    grid = _grid(spark, sf_dir)
    rows = cut(lifetimes.alive_on(directed(_stream(spark, sf_dir)), *grid).select("snap", "t", "u", "v"))
    graph = cut(influence.multiplicities(rows, ["snap"]))
    held = influence.sketch_nodes(graph, SKETCHES, ["snap"])
    seeds = greedy.max_coverage(held.select("snap", F.col("x").alias("v"), F.col("s").alias("u")), K).select("snap", "v")
    last = graphs.reach(graphs.edges(rows.where(F.col("snap") == grid[1])))
    reached = seeds.join(last, "v").groupBy("snap").agg(F.countDistinct("u").alias("reached"))
    return seeds.groupBy("snap").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("seeds")).join(reached, "snap", "left").select("snap", "seeds", F.coalesce("reached", F.lit(0)).alias("reached"))


def edge_changes(spark, sf_dir):
    """The inserts, changes of probability and erasures of edges at every step of the stream."""
    feed = changes.edge_changes(directed(_stream(spark, sf_dir)))
    return feed.withColumn("p", F.round("p", 6))


def vertex_changes(spark, sf_dir):
    return changes.vertex_changes(directed(_stream(spark, sf_dir)))


def edges_from_changes(spark, sf_dir):
    """The live pairs at the middle of the stream, from the feed of changes up to there."""
    feed = changes.edge_changes(directed(_stream(spark, sf_dir)))
    return changes.at_step(feed, _middle(spark, sf_dir), ["u", "v"], ["x", "p"]).withColumn("p", F.round("p", 6))


def bitmap_set_reward(spark, sf_dir):
    return bitmaps.set_reward(bitmaps.bitmaps(_on_grid(spark, sf_dir), ["snap"]), _given(spark), ["snap"])


def bitmap_set_gain(spark, sf_dir):
    """Gains over the given set of every venue on the grid."""
    maps = cut(bitmaps.bitmaps(_on_grid(spark, sf_dir), ["snap"]))
    covered = bitmaps.union(maps.join(_given(spark), "v", "left_semi"), ["snap"])
    return bitmaps.gains(maps, covered, ["snap"])


def bitmap_greedy(spark, sf_dir):
    picks = bitmaps.max_coverage(_on_grid(spark, sf_dir), K)
    return picks.select("snap", F.col("rank").cast("long").alias("rank"), "v", "gain")


def replayed_sets(spark, sf_dir):
    """Greedy's sets through text files, and their rewards on snapshots that are built again: what was told beside what is found."""
    at = shared_path(spark, "sets")
    picks = cut(greedy.max_coverage(_on_grid(spark, sf_dir), K))
    picks.select("snap", "v").write.option("sep", "\t").csv(at)
    saved = spark.read.schema("snap long, v long").option("sep", "\t").csv(at)
    told = picks.groupBy("snap").agg(F.sum("gain").alias("told"))
    return told.join(rewards.set_reward(_on_grid(spark, sf_dir), saved, ["snap"]), "snap", "left").select("snap", "told", F.coalesce("reward", F.lit(0)).alias("found"))


def observed_run(spark, sf_dir):
    """A run of greedy over the grid, and what was gathered while it wrote: live rows, snapshots, calls."""
    rows, told = observed(_on_grid(spark, sf_dir), live=F.count("*"), last=F.max("snap"))
    best, made = observed(greedy.solution_value(greedy.max_coverage(cut(rows), K)), snapshots=F.count("*"), calls=F.sum("calls"))
    best.write.parquet(shared_path(spark, "observed"))
    figures = {**told.get, **made.get}
    return spark.createDataFrame([tuple(figures[c] for c in ("live", "last", "snapshots", "calls"))], "live long, last long, snapshots long, calls long")


def _written(df: DataFrame, name: str, sep: str = "\t", **options: str) -> str:
    at = shared_path(df.sparkSession, name)
    df.write.options(sep=sep, **options).csv(at)
    return at


def text_stream(spark, sf_dir):
    """A stream of three columns through compressed text, whose lines number it anew."""
    return read_interactions(spark, _written(_stream(spark, sf_dir).orderBy("t").select("u", "v", "l"), "stream", compression="gzip"))


def text_pairs(spark, sf_dir):
    """A stream of two columns through text; each row lives one step."""
    return read_interactions(spark, _written(_stream(spark, sf_dir).orderBy("t").select("u", "v"), "pairs"), lifetimes=False)


def text_weighted(spark, sf_dir):
    graph = influence.multiplicities(_graph(spark, sf_dir, longer=LONG)).select("u", "v", F.round("p", 9).alias("p"))
    return read_weighted(spark, _written(graph, "weighted", " "))


def text_graph(spark, sf_dir):
    """The distinct edges of a snapshot that was written with its repeats, and how often they stand there."""
    at, once = shared_path(spark, "snapshot"), shared_path(spark, "graph")
    alive = cut(_graph(spark, sf_dir, longer=LONG))
    write_snapshot(alive, at)
    write_snapshot(alive, once, distinct=True)
    repeats = read_edges(spark, at, distinct=False).groupBy("u", "v").agg(F.count("*").alias("n"))
    return read_edges(spark, once).join(repeats, ["u", "v"])


def text_nodes(spark, sf_dir):
    """Greedy's nodes through a file of ids, and their names from a file of `name id`."""
    at = shared_path(spark, "nodes")
    write_nodes(greedy.solution_value(greedy.max_coverage(_on_grid(spark, sf_dir), K)), at, "nodes")
    names = _written(_stream(spark, sf_dir).select((F.col("v") + 1000).alias("value"), F.col("v").alias("key")).distinct(), "names")
    return influence.renamed(read_nodes(spark, at), read_map(spark, names), "v").select(F.col("v").alias("name"))


def text_series(spark, sf_dir):
    """Result series of two budgets, side by side in one folder, read again."""
    at = shared_path(spark, "series")
    for k in (K, 2 * K):
        best = greedy.solution_value(greedy.max_coverage(_on_grid(spark, sf_dir), k))
        write_series(best.select("snap", "value", "calls"), at, settings={"solver": "greedy", "k": k})
    back = spark.read.options(sep="\t", header=True).csv(at)
    return back.select("solver", F.col("k").cast("long").alias("k"), F.col("snap").cast("long").alias("snap"), "value", F.col("calls").cast("long").alias("calls"))


def streamed_windows(spark, sf_dir):
    """Arrivals for each venue and hour by Structured Streaming, of the hours that the watermark has closed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    rows = source.select(F.col("ts").cast("timestamp").alias("ts"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("v"))
    at = shared_path(spark, "windows")
    counted = alive_counts(rows, "ts", "10 minutes", "1 hour").writeStream.outputMode("append").format("parquet").option("checkpointLocation", shared_path(spark, "state"))
    counted.trigger(availableNow=True).start(at).awaitTermination()
    return spark.read.schema("start timestamp, `end` timestamp, v long, n long").parquet(at).select(F.unix_seconds("start").alias("start"), "v", "n")


def streamed_rewards(spark, sf_dir):
    """Each venue's reward as rows come and die, by Structured Streaming: the first half of the stream, and, after a restart, the second. Steps before the last arrival."""
    stream, half, last = cut(_stream(spark, sf_dir)), _middle(spark, sf_dir), _length(spark, sf_dir)
    at, out, state = (shared_path(spark, name) for name in ("rows", "rewards", "state"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (F.col("t") <= half, F.col("t") > half):
            stream.where(part).write.mode("append").parquet(at)
            rows = spark.readStream.schema("t long, u long, v long, l long").parquet(at)
            run = live_rewards(rows).writeStream.outputMode("append").format("parquet").option("checkpointLocation", state)
            run.trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema("v long, n long, reward long").parquet(out).where(F.col("n") < last)


def streamed_sieve(spark, sf_dir):
    """The sieve kept over four micro-batches of equal counts, with a restart before each: the best set at the end of each batch."""
    stream, n = cut(_stream(spark, sf_dir).withColumn("stream", F.lit(0))), _length(spark, sf_dir)
    at, kept, state = (shared_path(spark, name) for name in ("rows", "sieve", "state"))
    for part in range(4):
        stream.where((F.col("t") > part * n // 4) & (F.col("t") <= (part + 1) * n // 4)).write.mode("append").parquet(at)
        rows = spark.readStream.schema("t long, u long, v long, l long, stream int").parquet(at)
        keep_sieve(rows, kept, state, K, EPS).awaitTermination()
    return sieved(spark, kept).select("n", "value", "i", F.array_join("nodes", ",").alias("nodes"))


def streamed_list(spark, sf_dir):
    """The pruned list of each group of venues by Structured Streaming with keyed state."""
    at = shared_path(spark, "arrivals")
    _lanes(_stream(spark, sf_dir), LANES).write.parquet(at)
    rows = spark.readStream.schema("t long, u long, v long, l long, lane int").parquet(at)
    out = shared_path(spark, "listed")
    listed = run_stream(rows, K, EPS, key_col="lane").writeStream.outputMode("append").format("parquet").option("checkpointLocation", shared_path(spark, "state"))
    listed.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("lane int, t long, value long, nodes array<long>, calls long, n_sieves int").parquet(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        stream_edges, directed_edges, alive_edges, alive_size_per_step, prefix_reward, batch_steps, batch_steps_to_end, venue_reward, max_singleton_per_step, set_reward, set_gain, given_set_eval,
        largest_reward_so_far, threshold_ranges, greedy_at, greedy_per_snapshot, greedy_prefix, greedy_orders, naive_calls, random_baseline, sieve_prefix, sieve_series,
        lifetime_reduction, pruned_list_series, pruned_list_batches, solution_quality, greedy_by_budget, pruned_list_sweep, reach_size, reach_gain, greedy_reach, reduction_reach, affected_nodes, scc, scc_edges, sketched_reach,
        reach_registers, reach_registers_by_levels, reach_estimate, reach_set_estimate, reach_gain_estimate, scc_levels, reach_size_by_levels, affected_by_batches,
        streamed_rewards, edge_changes, vertex_changes, edges_from_changes, bitmap_set_reward, bitmap_set_gain, bitmap_greedy, replayed_sets, observed_run,
        edge_probabilities, node_degrees, influence_sketches, sketch_weights, sketch_budget, influence_maximization, influence_estimate, sketch_update, sketch_repair,
        reach_of_set, reach_gain_longer, influence_of_set, seeds_reach, text_stream, text_pairs, text_weighted, text_graph, text_nodes, text_series, streamed_windows, streamed_sieve, streamed_list,
    )
}
