"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size (an offset and a step from two hashes
of its name; any step visits all slots of a prime table). Shards take turns, each claiming its first slot that is
still free, until the table is full. So shards differ by one slot at most, and adding or removing a shard moves
little more than its own share of keys. A row goes to the shard at slot hash(key) mod size. The table depends on
the list of shards alone and has a fixed size, so it is broadcast and a row is placed in constant time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, about a thousand slots for each of the 64 shards of the registered query.
TABLE_SIZE = 65537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (place in ``shards``) of every slot. ``size`` must be a prime of at least ``len(shards)``.

    The result does not depend on the order of ``shards``, as turns go by name.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, and at least one")
    if size < max(2, len(shards)) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is no prime of at least {len(shards)}")
    turns = sorted(range(len(shards)), key=shards.__getitem__)
    at = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for k in turns:
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 15 hex digits of the MD5 of its text, modulo ``size``. A null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(size)


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows (slot, shard), made by SQL functions of one literal."""
    literal = ",".join(map(str, fill_table(shards, size)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(literal), ",")).alias("slot", "shard"))
    return rows.select(F.col("slot").cast("bigint").alias("slot"), F.col("shard").cast("int").alias("shard"))


def place(df: DataFrame, key: Column, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with slot (long) and shard (int, the place in ``shards``); columns of these names are replaced.

    A projection and a broadcast join with the fixed table, so no shuffle, and hot keys cannot skew it. Repeated
    rows and rows with the same key share a shard; null keys go where empty text goes; an empty table gives an
    empty one. To spread one hot source, take a key that is finer than it, as the registered query does.
    """
    clean = df.drop("slot", "shard").withColumn("slot", slot_of(key, size))
    return clean.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot", "left")


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes a placed table by shard. Rows of a shard stay spread over the tasks that read them, so a hot shard does not meet in one."""
    placed.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
