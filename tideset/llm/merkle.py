"""A Merkle manifest of a dataset: a leaf for each row, a tree of runs of three for each group, and one tree over the groups' roots.

The rows are numbered by a range sort, so each has a place in its group, and the places are cut into aligned buckets of 3 ** `depth`: a bucket is a whole
subtree of `depth` levels (fewer only where the group has one bucket). Executors take a pack of buckets as an Arrow table and run the level
queries on it in DuckDB: string_agg of the digests of a run in order, and its sha256. Bucket roots are leaves of the next layer, bucketed in the same way, until a
group has one node; the groups' roots are the last tree's leaves.

Proofs never travel with rows: for each bucket Spark gathers the outer path once (a row for each level above the bucket) and cogroups it with the
bucket's rows, and the bucket's task folds and hashes each row's whole path. A group may hold any share of the rows, since no task takes more than a pack.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans import numbered
from .common import cut, small

ARITY, DEPTH = 3, 7
_DIGEST = 64  # characters of a digest in hex


def digest(values: Sequence[Column]) -> Column:
    """The sha256 (lowercase hex) of values one after the other: `-` for null, else the length in bytes of UTF-8, a colon, and the value as text."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def levels_of(n: Column) -> Column:
    """How many levels a tree over n leaves has: the least l with 3 ** l >= n."""
    return sum(((F.lit(ARITY**p) < n).cast("int") for p in range(39)), F.lit(0))


def _connection():
    import duckdb

    if "con" not in _HELD:  # one for each worker process
        _HELD["con"] = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    return _HELD["con"]


_HELD: dict = {}


def _levels(con, nodes) -> int:
    """From an Arrow table (k, b, i, levels, h) the tables level_1, level_2, ... of runs: s the digests of a run in order, h their digest. Returns how many."""
    con.register("nodes", nodes)
    con.execute("CREATE OR REPLACE TEMP TABLE level_0 AS SELECT k, b, i, levels, h, '' AS s FROM nodes")
    con.unregister("nodes")
    most = con.execute("SELECT coalesce(max(levels), 0) FROM level_0").fetchall()[0][0]
    for level in range(1, most + 1):
        con.execute(
            f"CREATE OR REPLACE TEMP TABLE level_{level} AS SELECT k, b, i, levels, sha256(s) AS h, s FROM ("
            f"SELECT k, b, i // {ARITY} AS i, levels, string_agg(h, '' ORDER BY i) AS s FROM level_{level - 1} WHERE levels >= {level} GROUP BY k, b, i // {ARITY}, levels)"
        )
    return most


def _beside(at: str, level: int) -> tuple[str, str]:
    """SQL of the siblings before and after the node above leaf `at` in its run r.s."""
    place = f"(({at} // {ARITY ** (level - 1)}) % {ARITY})"
    return f"substr(r.s, 1, {_DIGEST} * {place})", f"substr(r.s, {_DIGEST} * {place} + {_DIGEST + 1})"


def _tops(key, table):
    """The root of each bucket of a pack: (k, b, n, h)."""
    con = _connection()
    most = _levels(con, table)
    con.register("sizes", table.select(["k", "b", "n"]))
    tops = " UNION ALL ".join(f"SELECT k, b, h FROM level_{level} WHERE levels = {level}" for level in range(most + 1))
    return con.sql(f"SELECT k, b, n, h FROM ({tops}) JOIN (SELECT DISTINCT k, b, n FROM sizes) USING (k, b)").to_arrow_table()


def _paths(width: int):
    def run(key, table):
        """The siblings of each node of a pack on its way to its bucket's root: (k, r, level, left, right)."""
        con = _connection()
        most = _levels(con, table)
        parts = ["SELECT k, CAST(0 AS BIGINT) AS r, CAST(0 AS INTEGER) AS level, '' AS left_, '' AS right_ FROM level_0 WHERE FALSE"]
        for level in range(1, most + 1):
            before, after = _beside("n.i", level)
            parts.append(f"SELECT n.k, n.b * {width} + n.i, {level}, {before}, {after} FROM level_0 n JOIN level_{level} r ON r.k = n.k AND r.b = n.b AND r.i = n.i // {ARITY**level}")
        return con.sql(" UNION ALL ".join(parts)).to_arrow_table().rename_columns(["k", "r", "level", "left", "right"])

    return run


def _proved(schema):
    def run(key, rows, outer):
        """A pack's rows (id, k, b, i, levels, h, x) and its buckets' outer paths (k, b, level, left, right) to what `manifest` returns; level -1 of a path holds the group's root."""
        import pyarrow as pa

        con = _connection()
        rows = rows.append_column("row", pa.array(range(rows.num_rows), pa.int64()))
        most = _levels(con, rows)
        con.register("outer_paths", outer)
        con.execute('CREATE OR REPLACE TEMP TABLE outside AS SELECT k, b, row_number() OVER (PARTITION BY k, b ORDER BY level) - 1 AS place, "left" AS l, "right" AS r FROM outer_paths')
        con.register("given", rows.select(["row", "k", "b", "i", "x"]))
        con.execute("CREATE OR REPLACE TEMP TABLE folded AS SELECT row, k, b, i, x AS f, '' AS p FROM given")
        for level in range(1, most + 1):
            before, after = _beside("d.i", level)
            con.execute(
                f"CREATE OR REPLACE TEMP TABLE folded AS SELECT d.row, d.k, d.b, d.i, CASE WHEN r.s IS NULL THEN d.f ELSE sha256({before} || d.f || {after}) END AS f, "
                f"CASE WHEN r.s IS NULL THEN d.p ELSE d.p || {before} || {after} END AS p FROM folded d LEFT JOIN level_{level} r ON r.k = d.k AND r.b = d.b AND r.i = d.i // {ARITY**level}"
            )
        beyond = con.execute("SELECT coalesce(max(place), 0) FROM outside").fetchall()[0][0]
        for place in range(1, beyond + 1):
            con.execute(
                "CREATE OR REPLACE TEMP TABLE folded AS SELECT d.row, d.k, d.b, d.i, CASE WHEN o.k IS NULL THEN d.f ELSE sha256(o.l || d.f || o.r) END AS f, "
                f"CASE WHEN o.k IS NULL THEN d.p ELSE d.p || o.l || o.r END AS p FROM folded d LEFT JOIN (SELECT * FROM outside WHERE place = {place}) o ON o.k = d.k AND o.b = d.b"
            )
        found = con.sql("SELECT sha256(p) AS proof, f, o.l AS subroot FROM folded d JOIN outside o ON o.k = d.k AND o.b = d.b AND o.place = 0 ORDER BY row").to_arrow_table()
        for name in ("outer_paths", "given"):
            con.unregister(name)
        columns = [rows.column("id"), rows.column("h"), found.column("subroot"), found.column("proof"), found.column("f")]
        return pa.table(columns, names=schema)

    return run


def _dealt(nodes: DataFrame, total: int, depth: int) -> DataFrame:
    """nodes (k, r, h, n, ...) with their bucket b, place i in it, the levels of its tree and the pack that takes it."""
    width = ARITY**depth
    placed = nodes.withColumns({"b": F.floor(F.col("r") / width).cast("long"), "i": F.pmod("r", F.lit(width)).cast("long"), "levels": F.least(F.lit(depth), levels_of(F.col("n"))).cast("int")})
    return placed.withColumn("pack", _pack(total, width))


def _pack(total: int, width: int) -> Column:
    """Packs take a bucket each on average, or many small ones."""
    return F.pmod(F.xxhash64("k", "b"), F.lit(1 + total // width))


_NODES = ["k", "b", "i", "levels", "h", "n"]
_TOPS, _PATHS = "k long, b long, n long, h string", "k long, r long, level int, left string, right string"


def _climb(nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The root (k, h) of each group of nodes (k, r, h, n), and the siblings (k, r, level, left, right) of each node on its way there."""
    nodes = cut(nodes)
    dealt = _dealt(nodes, nodes.count(), depth)
    tops = cut(dealt.select("pack", *_NODES).groupBy("pack").applyInArrow(_tops, _TOPS))
    paths = cut(dealt.select("pack", *_NODES).groupBy("pack").applyInArrow(_paths(ARITY**depth), _PATHS))
    if tops.where("b > 0").isEmpty():
        return tops.select("k", "h"), paths
    roots, upper = _climb(tops.select("k", F.col("b").alias("r"), "h", F.ceil(F.col("n") / ARITY**depth).cast("long").alias("n")), depth)
    above = dealt.select("k", "r", "b").join(small(upper.withColumnRenamed("r", "b")), ["k", "b"]).select("k", "r", (F.col("level") + depth).alias("level"), "left", "right")
    return roots, cut(paths.union(above))


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", altered: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """One row (id_col, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of `docs`.

    leaf: `digest` of `fields`. In a group (by group_col) leaves ascend by id; each run of three, the last of fewer, becomes its digest, level by level, until one node
    is left, the subroot; the subroots, ordered by group, give the root in the same way. proof_sha256: the digest of the siblings on the way from leaf to root.
    `altered` gives columns that are not as they were when the manifest was made: folded_root is made from the leaf of these and the siblings of the manifest, and
    verified tells whether it is the root. A bucket holds 3 ** `depth` leaves.

    Defined cases: nulls are values of their own (a null group is the first group, null ids come first in a group); rows of equal id are ordered by
    their leaves, and wholly equal rows have a leaf each. An empty table gives no rows. Other columns have no part in it.
    """
    altered = altered or {}
    own = [F.col(f"`{c}`") for c in fields]
    other = [altered.get(c, F.col(f"`{c}`")) for c in fields]
    leaves = docs.select(F.col(f"`{group_col}`").cast("string").alias("g"), F.col(f"`{id_col}`").alias("id"), digest(own).alias("h"), digest(other).alias("x"))
    placed = cut(numbered(cut(leaves), ["g", "id", "h", "x"]))
    out = StructType([StructField(id_col, docs.schema[id_col].dataType), *(StructField(c, StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])
    result = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    if placed.isEmpty():
        return docs.sparkSession.createDataFrame([], StructType(out.fields[:1])).select(id_col, *[F.lit(None).cast("boolean" if c == "verified" else "string").alias(c) for c in result])
    groups = cut(placed.groupBy("g").agg(F.min("t").alias("k"), F.count("*").alias("n")))
    held = placed.join(small(groups.withColumnRenamed("g", "g_")), F.col("g").eqNullSafe(F.col("g_"))).select("id", "h", "x", "k", "n", (F.col("t") - F.col("k")).alias("r"))
    total = placed.count()
    dealt = _dealt(held, total, depth)
    tops = cut(dealt.select("pack", *_NODES).groupBy("pack").applyInArrow(_tops, _TOPS))
    subroots, inside = _climb(tops.select("k", F.col("b").alias("r"), "h", F.ceil(F.col("n") / ARITY**depth).cast("long").alias("n")), depth)
    subroots = cut(numbered(subroots, ["k"], "r").withColumn("r", F.col("r") - 1))
    roots, between = _climb(subroots.select(F.lit(0).cast("long").alias("k"), "r", "h", F.lit(subroots.count()).cast("long").alias("n")), depth)
    root = roots.first()["h"]

    # the outer path of each bucket: the group's root, the levels from bucket to group, the levels from group to root
    buckets = tops.select("k", "b")
    whole = subroots.join(small(between.drop("k")), "r").select("k", (F.col("level") + 1000).alias("level"), "left", "right")
    outer = buckets.join(small(subroots.select("k", "h")), "k").select("k", "b", F.lit(-1).alias("level"), F.col("h").alias("left"), F.lit("").alias("right"))
    outer = outer.union(inside.select("k", F.col("r").alias("b"), "level", "left", "right")).union(buckets.join(small(cut(whole)), "k").select("k", "b", "level", "left", "right"))
    outer = outer.withColumn("pack", _pack(total, ARITY**depth))
    rows = dealt.select("pack", "id", "k", "b", "i", "levels", "h", "x")
    proved = rows.groupBy("pack").cogroup(outer.groupBy("pack")).applyInArrow(_proved(out.names), out)
    return proved.select(id_col, "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
