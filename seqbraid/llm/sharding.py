"""Shard placement through a permutation-filled lookup table, with DataFrame functions only.

Every shard has a preference order over the slots of a prime-sized table:
slot_j = (offset + j * skip) mod size. The shards take turns, each claiming its next
free slot, until the table is full. A key goes to the shard in slot hash(key) mod
size, a look-up in a broadcast table of `size` rows. Shares differ by at most one
slot, and removing a shard moves few keys of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = 256


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _draw(name: str, salt: str, modulus: int) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16) % modulus


def fill_table(names: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that holds each slot.

    `size` must be prime, so that every preference order visits all slots, and at
    least the number of shards. Names must be distinct.
    """
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct and not empty")
    if not _is_prime(size) or size < len(names):
        raise ValueError("the table size must be a prime of at least the number of shards")
    at = [_draw(name, "offset", size) for name in names]
    skip = [_draw(name, "skip", size - 1) + 1 for name in names]
    owner = [-1] * size
    free = size
    while free:
        for shard in range(len(names)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % size
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, names: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """slot, shard, shard_name: `size` rows, a bound that does not depend on the data."""
    rows = [(slot, shard, names[shard]) for slot, shard in enumerate(fill_table(names, size))]
    return spark.createDataFrame(rows, "slot long, shard int, shard_name string")


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key; 60 bits of the MD5 of its text, so that any engine can repeat it.

    A null key is placed like an empty text.
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def place(
    df: DataFrame, key: Column, names: Sequence[str], size: int = TABLE_SIZE
) -> DataFrame:
    """`df` with slot, shard and shard_name added; columns of these names are replaced.

    Equal keys, and repeated rows, go to the same shard. No row moves: the only
    exchange is the broadcast of the table.
    """
    table = lookup_table(df.sparkSession, names, size)
    mine = df.drop("slot", "shard", "shard_name").withColumn("slot", slot_of(key, size))
    return mine.join(F.broadcast(table), "slot", "inner")


def write_sharded(
    df: DataFrame, key: Column, names: Sequence[str], path: str, files_per_shard: int = 1
) -> None:
    """Write one folder per shard. A shard is spread over `files_per_shard` tasks by key hash."""
    placed = place(df, key, names)
    split = F.pmod(F.xxhash64(key), F.lit(files_per_shard))
    placed.repartition(len(names) * files_per_shard, F.col("shard"), split).write.partitionBy(
        "shard"
    ).parquet(path)
