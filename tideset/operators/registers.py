"""Distinct-count sketches that travel along edges: how many nodes a node reaches, without a table of pairs.

A node's sketch is up to 2 ** bits registers, as rows (x, register, rank) of those that are set. A hash of each node names a register and a rank; a node
that reaches y has at least y's rank in y's register. So registers are the state of a closure: they go along reverse edges by a maximum
for each register, and only nodes with a register that grew pass it on. Nothing larger than nodes times registers is kept, however many pairs there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import Kept, cut, small
from . import graphs

_HASHED = 60  # bits of the hash: 15 hexadecimal digits of an md5


def own_registers(nodes: DataFrame, by: Sequence[str] = (), bits: int = 8) -> DataFrame:
    """(by, x, register, rank) that each node (by, x) sets for itself: the low bits of its hash, and the place of the first bit set above."""
    number = F.conv(F.substring(F.md5(F.col("x").cast("string")), 1, _HASHED // 4), 16, 10).cast("long")
    hashed = nodes.select(*by, "x", number.alias("_h")).distinct()
    rest = F.shiftright("_h", bits)
    rank = _HASHED - bits + 1 - F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))
    return hashed.select(*by, "x", F.col("_h").bitwiseAND((1 << bits) - 1).alias("register"), rank.cast("int").alias("rank"))


def _largest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("rank").alias("rank"))


def propagated(graph: DataFrame, by: Sequence[str] = (), bits: int = 8) -> DataFrame:
    """(by, x, register, rank) of every node of `graph` (by, u, v): the largest ranks among the nodes that it reaches, itself included.

    A round sends the registers that grew one edge back, and keeps those above what is held. Only the held registers that a round could change are looked at.
    """
    by = list(by)
    keys = [*by, "x", "register"]
    back = cut(graphs.edges(graph, by).select(*by, F.col("v").alias("x"), F.col("u").alias("_up")))
    fresh = cut(own_registers(graphs.nodes(back.select(*by, F.col("x").alias("v"), F.col("_up").alias("u")), by), by, bits))
    known = Kept(fresh)
    while True:
        sent = cut(_largest(fresh.join(back, [*by, "x"]).select(*by, F.col("_up").alias("x"), "register", "rank"), keys))
        held = _largest(known.table().join(small(sent.select(*keys)), keys, "left_semi"), keys).withColumnRenamed("rank", "_held")
        fresh = cut(sent.join(held, keys, "left").where("_held IS NULL OR rank > _held").select(*keys, "rank"))
        if fresh.isEmpty():
            return _largest(known.table(), keys)
        known.add(fresh)


def by_levels(graph: DataFrame, by: Sequence[str] = (), bits: int = 8) -> DataFrame:
    """The rows of `propagated`, in reverse topological order: components share their registers, and each level of their graph is merged once."""
    by = list(by)
    scc, order = graphs.condensation(graph, by)
    own = own_registers(scc.select(*by, "x"), by, bits).join(scc, [*by, "x"]).select(*by, F.col("scc").alias("x"), "register", "rank")
    merged = graphs.merged_by_levels(order, _largest(own, [*by, "x", "register"]), ["register"], "rank", by)
    return merged.withColumnRenamed("x", "scc").join(scc, [*by, "scc"]).select(*by, "x", "register", "rank")


def _estimate(inverse: Column, held: Column, bits: int) -> Column:
    """The count that registers tell: inverse is the sum of 2 ** -rank over all registers, held how many of them are set."""
    m = 1 << bits
    alpha = {4: 0.673, 5: 0.697, 6: 0.709}.get(bits, 0.7213 / (1 + 1.079 / m))
    raw = alpha * m * m / inverse
    return F.when((raw <= 2.5 * m) & (held < m), m * F.log(m / (m - held))).otherwise(raw)


def _inverse(rank: str) -> Column:
    return F.pow(F.lit(2.0), -F.col(rank))


def estimated(registers: DataFrame, by: Sequence[str] = ("x",), bits: int = 8) -> DataFrame:
    """(by, reward): how many nodes the registers of each `by` stand for; of several nodes of one `by`, together."""
    merged = _largest(registers, [*by, "register"])
    held = F.count("*")
    return merged.groupBy(*by).agg(_estimate(F.sum(_inverse("rank")) + ((1 << bits) - held), held, bits).alias("reward"))


def set_reward(registers: DataFrame, chosen: DataFrame, by: Sequence[str] = (), bits: int = 8) -> DataFrame:
    """(by, reward): how many nodes the nodes of `chosen` (x) reach together; nodes that the graph does not know reach none."""
    return estimated(registers.join(chosen.select("x").distinct(), "x", "left_semi"), by, bits)


def gains(registers: DataFrame, chosen: DataFrame, by: Sequence[str] = (), bits: int = 8) -> DataFrame:
    """(by, x, gain): what each node adds to the reward of `chosen` (x), all in one job.

    A node's registers change the sums of the set's where they are larger, so each is met once with the set's, of which there are at most 2 ** bits for each `by`.
    """
    by = list(by)
    m = 1 << bits
    base = cut(_largest(registers.join(chosen.select("x").distinct(), "x", "left_semi"), [*by, "register"]).withColumnRenamed("rank", "_base"))
    total = base.groupBy(*by).agg(F.sum(_inverse("_base") - 1).alias("_less"), F.count("*").alias("_set"))
    less = F.when(F.col("_base").isNull(), _inverse("rank") - 1).when(F.col("rank") > F.col("_base"), _inverse("rank") - _inverse("_base")).otherwise(0.0)
    met = registers.join(small(base), [*by, "register"], "left")
    each = met.groupBy(*by, "x").agg(F.sum(less).alias("_more"), F.count(F.when(F.col("_base").isNull(), 1)).alias("_new"))
    if by:
        each = each.join(total, by, "left")
    else:
        row = total.first()  # one row
        each = each.withColumns({"_less": F.lit(row["_less"]).cast("double"), "_set": F.lit(row["_set"]).cast("long")})
    less, held = F.coalesce("_less", F.lit(0.0)), F.coalesce("_set", F.lit(0))
    before = F.when(held == 0, 0.0).otherwise(_estimate(m + less, held, bits))
    return each.select(*by, "x", (_estimate(m + less + F.col("_more"), held + F.col("_new"), bits) - before).alias("gain"))
