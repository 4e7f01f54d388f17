"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots of the table, a prime; its size is fixed and does not follow the data.
SLOTS = 65537


def _draw(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:12], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of every slot.

    Each shard prefers the slots in the order offset + j * skip, a permutation because ``slots`` is prime. Shards take turns, each
    claiming its next preferred free slot, until all are taken; so shards hold nearly equal numbers of slots, and a shard that
    comes or goes moves few slots of the others.
    """
    if not shards:
        raise ValueError("there must be a shard")
    if len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, and no more than slots")
    if slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime above 2")
    at = [_draw(s, "offset") % slots for s in shards]
    skip = [_draw(s, "skip") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    left = slots
    while True:
        for shard in range(len(shards)):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + skip[shard]) % slots
            table[slot] = shard
            at[shard] = (slot + skip[shard]) % slots
            left -= 1
            if not left:
                return np.array(table, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 12 hex digits of the MD5 of its text, modulo the slots. A null key is the empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with _slot and _shard added: every row by its key, in the scan, from a broadcast table of ``slots`` rows.

    Equal keys meet in one shard; a null key is placed as the empty text. Nothing is shuffled, whatever the keys; an empty table
    gives no rows; all other columns stay, but for any called _slot, _shard or _at.
    """
    table = lookup_table(shards, slots)
    schema = T.StructType([T.StructField("_at", T.IntegerType()), T.StructField("_shard", T.StringType())])
    rows = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], schema)
    return df.drop("_slot", "_shard", "_at").withColumn("_slot", slot_of(F.col(key), slots)).join(F.broadcast(rows), F.col("_slot") == F.col("_at")).drop("_at")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files: int = 1) -> None:
    """One folder of Parquet files for each shard, each shard dealt over ``files`` tasks by a second hash of the key."""
    placed = place(df, key, shards).withColumn("_file", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(files)))
    placed.repartition(len(shards) * files, "_shard", "_file").drop("_slot", "_file").write.mode("overwrite").partitionBy("_shard").parquet(path)
