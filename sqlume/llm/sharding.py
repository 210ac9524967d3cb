"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Each shard has a preference order over the slots of a prime-sized table (an offset and a stride from its name's
hash). Shards take turns claiming their next free preferred slot until the table is full, so every shard gets an
almost equal share and adding or removing a shard moves few keys. The table has a fixed size, so it is broadcast;
placing a key is one hash and one lookup.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlume.llm.common import free_name

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard that owns each slot. Its size is fixed, whatever the data."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    if size < 3 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime above 2")
    at = [_hash(f"offset:{s}") % size for s in shards]
    skip = [_hash(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def shard(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with its key's slot and the owning shard's number.

    Null keys count as the empty string; repeated rows and equal keys share a shard; an empty table stays empty.
    All columns of df stay, the key too, whatever their names: a new column whose name is taken gets an underscore more.
    """
    spark = df.sparkSession
    slot_col = free_name(df, slot_col)
    shard_col = free_name(df.withColumn(slot_col, F.lit(0)), shard_col)
    table = spark.sql(f"SELECT posexplode(from_json('{json.dumps(lookup_table(tuple(shards), size))}', 'array<int>')) AS (`{slot_col}`, `{shard_col}`)")
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    slot = (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")
    df = df.withColumn(slot_col, slot)
    return df.join(F.broadcast(table), slot_col).select(*[F.col(f"`{c}`") for c in (*df.columns, shard_col)])


def oracle(key: str, table: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> str:
    """The same placement in DuckDB's SQL."""
    owners = json.dumps(lookup_table(tuple(shards), size))
    return (
        f"WITH t AS (SELECT {owners}::INTEGER[] AS owner), k AS (SELECT {key}, CAST(CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot FROM {table}) "
        f"SELECT {key}, slot, owner[slot + 1] AS shard FROM k, t"
    )
