"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (an offset and a skip from a digest of
its name). Shards take turns; each claims its most preferred free slot until the table is full. The table has a
fixed size that doesn't depend on the data, so it is broadcast, and a row finds its shard by one hash and one
lookup. Adding or removing a shard moves few slots besides those that must move.

Defined results: a null key hashes like any value and so has one shard; repeated rows land together; an empty
table gives an empty result; columns of the input other than the key are kept by ``write_shards`` and ignored by
``place``, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
#: Slots for each shard; the table's size is the next prime.
SLOTS_PER_SHARD = 100


def next_prime(n: int) -> int:
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fill(names: list[str], size: int) -> list[int]:
    """The shard's number for each slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and distinct")
    if size < len(names) or next_prime(size) != size:
        raise ValueError("the table's size must be a prime that is no less than the number of shards")
    digests = [hashlib.sha256(name.encode()).digest() for name in names]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digests]
    slots = [-1] * size
    for turn in range(size):
        shard = turn % len(names)
        while slots[at[shard]] >= 0:
            at[shard] = (at[shard] + skip[shard]) % size
        slots[at[shard]] = shard
    return slots


def slot_of(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def lookup(spark: SparkSession, names: list[str], size: int | None = None) -> DataFrame:
    """The table as rows of (slot, shard); ``size`` rows, however large the data."""
    slots = fill(names, size or next_prime(SLOTS_PER_SHARD * len(names)))
    text = ",".join(map(str, slots))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select(
        F.col("slot").cast("int"), F.col("shard").cast("int")
    )


def place(df: DataFrame, key: str, names: list[str] | None = None, size: int | None = None) -> DataFrame:
    """(key, slot, shard) for each row of ``df``."""
    names = names or [f"shard-{k:05d}" for k in range(SHARDS)]
    size = size or next_prime(SLOTS_PER_SHARD * len(names))
    keyed = df.select(F.col(key)).withColumn("slot", slot_of(F.col(key), size))
    return keyed.join(F.broadcast(lookup(df.sparkSession, names, size)), "slot").select(key, "slot", "shard")


def write_shards(df: DataFrame, key: str, path: str, names: list[str] | None = None, files_per_shard: int = 8) -> None:
    """Writes ``df`` with one folder for each shard; a second hash deals a shard's rows to several files."""
    names = names or [f"shard-{k:05d}" for k in range(SHARDS)]
    size = next_prime(SLOTS_PER_SHARD * len(names))
    table = lookup(df.sparkSession, names, size).withColumnsRenamed({"slot": "_slot", "shard": "_shard"})
    placed = df.withColumn("_slot", slot_of(F.col(key), size)).join(F.broadcast(table), "_slot").drop("_slot")
    salt = F.pmod(F.hash(F.col(key)), F.lit(files_per_shard))
    placed.repartition(len(names) * files_per_shard, "_shard", salt).write.partitionBy("_shard").parquet(path)
