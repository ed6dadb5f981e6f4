"""Sharding by a permutation-filled look-up table, in DataFrame functions only.

Every shard has its own preference order of the slots of a table of prime size. The shards take turns
claiming their next free slot until none is left. A key's hash gives its slot, the slot its shard. The
table depends on the shards' names alone, and a shard that joins or leaves moves few other slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime of more than a hundred slots per shard keeps shares within about one per cent.
TABLE_SIZE = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> list[int]:
    """Shard number of each slot. Work and result are bounded by the table's size, not by any data."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("Between one and `size` shards of different names are needed.")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("The table's size must be prime, so that every skip visits every slot.")
    start = [_number(f"{s}/offset") % size for s in shards]
    skip = [_number(f"{s}/skip") % (size - 1) + 1 for s in shards]
    at, table, left = [0] * len(shards), [-1] * size, size
    while left:
        for i in range(len(shards)):
            while table[slot := (start[i] + at[i] * skip[i]) % size] >= 0:
                at[i] += 1
            table[slot] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key by the leading 60 bits of its MD5; a null key counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """The look-up table as (slot, shard): `size` rows, whatever the data."""
    numbers = ",".join(map(str, fill_table(shards, size)))
    names = F.array(*[F.lit(s) for s in shards])
    return (spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "number"))
            .select("slot", F.element_at(names, F.col("number").cast("int") + 1).alias("shard")))


def assign(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """All rows with `slot` and `shard`; columns of these names give way to the results.

    Equal keys share a shard. The table is broadcast: its size is a parameter.
    """
    keep = [f"`{c}`" for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*keep, slot_of(df[f"`{key}`"], size).alias("slot"))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot", "left").select(*keep, "slot", "shard")
