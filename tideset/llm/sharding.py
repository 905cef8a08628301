"""Sharding by a permutation-filled lookup table, in DataFrame functions alone on the path of the rows.

Each shard ranks the slots of a prime-sized table by a permutation of its own; the shards take turns, each claiming the best slot on
its list that is still free, until all slots are taken. A key hashes to a slot. Shards get nearly equal numbers of slots, and adding
or removing one moves few others. The table has at most `MOST_SLOTS` entries, so broadcasting it is safe at any number of rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

SLOTS = 65_537
MOST_SLOTS = 1_000_003


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """The shard number of each slot. `weights`: slots that each shard claims in a turn, 1 by default."""
    weights = weights or [1] * len(shards)
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if slots > MOST_SLOTS or slots < len(shards) or slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at least the number of shards and at most {MOST_SLOTS}")
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("weights must be as many as shards, none below 0 and one above")
    digests = [hashlib.md5(x.encode()).digest() for x in shards]
    at = [int.from_bytes(d[:8]) % slots for d in digests]
    skip = [int.from_bytes(d[8:]) % (slots - 1) + 1 for d in digests]
    owner, free = [-1] * slots, slots
    while True:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                owner[at[i]] = i
                free -= 1
                if not free:
                    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, by the first 60 bits of its text's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def shard(df: DataFrame, shards: list[str], key_col: str = "doc_id", spread_col: str | None = "text", slots: int = SLOTS, weights: list[int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """The rows of `df` with two more columns: the key's slot and that slot's shard number.

    Defined cases: a null key is spread by the text of `spread_col` (none, or null: the empty text); rows with equal keys, repeated rows too,
    share a shard. Columns of `df` named as the new ones are replaced. An empty table stays empty.
    """
    table = ",".join(map(str, lookup_table(shards, slots, weights)))
    owners = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias(slot_col, shard_col)).select(F.col(slot_col).cast("long"), F.col(shard_col).cast("int"))
    rest = F.lit("") if spread_col is None else F.concat(F.lit("text:"), F.coalesce(F.col(spread_col), F.lit("")))
    keyed = df.drop(shard_col).withColumn(slot_col, slot(F.coalesce(F.col(key_col).cast("string"), rest), slots))
    return keyed.join(F.broadcast(owners), slot_col)


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", files: int = 8) -> None:
    """Write each shard to a folder of its own in about `files` files; the salt keeps a large shard from being one task's.

    Defined cases: rows with a null shard get the folder that Spark names for null; an empty table writes no folder of a shard. A column `_salt` of `df` stays.
    The salt is a hash of the row but for maps, so a task that runs again deals its rows as before; many equal rows of one shard share a file.
    """
    salt = unused(df, "_salt")
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(files)))
    salted.repartition(shard_col, salt).drop(salt).write.partitionBy(shard_col).parquet(path)
