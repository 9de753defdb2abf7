"""Placement of keys on shards by a permutation-filled lookup table, native.

Every shard prefers the slots of a prime-sized table in an order of its own, a permutation
given by an offset and a step. The shards take turns, each claiming the first slot of its
order that is still free, until the table is full. All hold the same number of slots, give
or take one, and when a shard joins or leaves most slots keep their owner.

The table depends on the shards' names alone and has a fixed size, so it is filled before
the job and broadcast: placing a key is one hash and one look-up, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liveset.llm.common import Carried

#: 32 shards with about a hundred slots each: shares differ by one slot in a hundred.
SHARDS = tuple(f"shard-{i:05d}" for i in range(32))
SLOTS = 3301
MOST_SLOTS = 1 << 20
ADDED = ("slot", "shard")


def fill(shards: tuple[str, ...], slots: int) -> list[int]:
    """Owner (index in ``shards``) of every slot. The order of a shard starts at the first 15
    hex digits of its name's MD5 and steps by digits 17 to 31."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not len(shards) <= slots <= MOST_SLOTS or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError("the number of slots must be prime, no smaller than that of shards, and at most MOST_SLOTS")
    digests = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at = [int(d[:15], 16) % slots for d in digests]
    step = [int(d[16:31], 16) % (slots - 1) + 1 for d in digests]
    owner, free, turn = [-1] * slots, slots, 0
    while free:
        while owner[at[turn]] >= 0:
            at[turn] = (at[turn] + step[turn]) % slots
        owner[at[turn]] = turn
        free, turn = free - 1, (turn + 1) % len(shards)
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key's text, from the first 15 hex digits of its MD5. Null is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_of(spark: SparkSession, shards: tuple[str, ...], slots: int) -> DataFrame:
    """``slot``, ``shard``: the filled table as rows."""
    packed = F.lit(b"".join(i.to_bytes(4, "big") for i in fill(shards, slots)))
    owner = F.conv(F.hex(F.substring(packed, (F.col("id") * 4 + 1).cast("int"), F.lit(4))), 16, 10).cast("int")
    return spark.range(slots).select(F.col("id").cast("int").alias("slot"), F.get(F.array(*map(F.lit, shards)), owner).alias("shard"))


def place(df: DataFrame, key: Column, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (a shard's name) of ``key``; columns of these names
    are replaced. Every row is placed: null keys are placed as the empty text, equal keys
    together. An empty table stays empty."""
    carried = Carried(df, (), ADDED)
    keyed = df.select(*carried.packed, slot_of(key, slots).alias("slot"))
    return keyed.join(F.broadcast(table_of(df.sparkSession, shards, slots)), "slot").select(*carried.columns(), *ADDED)


def write_shards(placed: DataFrame, path: str, parts_a_shard: int = 8) -> None:
    """One folder a shard. Rows of a shard are dealt by a hash of the whole row over several
    tasks, so a key that fills a shard does not fill a task."""
    part = F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(parts_a_shard))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)
