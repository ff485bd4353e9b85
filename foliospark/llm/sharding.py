"""Shards by a lookup table that permutations of its slots fill.

Every shard has its own order of preference over the slots of a table of prime
size: an offset and a step, both hashed from its name, run through all slots.
Shards take turns, each claiming the first slot of its order that is still free,
until the table is full; a shard of weight two has two turns a round. Shares
then differ by one slot a turn, and when a shard comes or goes most slots stay
where they were. The table has ``TABLE_SIZE`` slots whatever the data, so it is
broadcast; a row's shard is one hash and one lookup.

All of it is DataFrame functions: the table is an array constant spread into
rows, not a Python function over data.

Defined results: a null key is hashed as the empty text. Equal keys, also of
repeated rows, get equal shards; salt columns can be named to spread the rows of
a hot key. An empty table gives no rows. Columns named like the results are
replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537  # a prime, about a thousand slots for each of 64 shards


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def name_hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill_table(
    shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None
) -> list[int]:
    """The shard number in each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need different names, one at least")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime of at least one slot a shard")
    weights = weights or [1] * len(shards)
    if min(weights) < 0 or not any(weights):
        raise ValueError("weights must not be negative, nor all 0")
    slots = [-1] * size
    place = [name_hash(s, "offset") % size for s in shards]
    step = [name_hash(s, "step") % (size - 1) + 1 for s in shards]
    turns = [k for k, w in enumerate(weights) for _ in range(w)]
    left = size
    while left:
        for shard in turns:
            at = place[shard]
            while slots[at] >= 0:
                at = (at + step[shard]) % size
            slots[at] = shard
            place[shard] = (at + step[shard]) % size
            left -= 1
            if not left:
                break
    return slots


def lookup_table(spark: SparkSession, slots: list[int], shards: list[str]) -> DataFrame:
    """Rows (slot, shard, shard_name), one for each slot."""
    numbers = F.split(F.lit(",".join(map(str, slots))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return (
        spark.range(1)
        .select(F.posexplode(numbers).alias("slot", "shard"))
        .select(
            F.col("slot").cast("long").alias("slot"),
            F.col("shard").cast("int").alias("shard"),
        )
        .withColumn("shard_name", F.element_at(names, F.col("shard") + 1))
    )


def slot_of(keys: list[str], size: int):
    """The slot of a row: 60 bits of the MD5 of its keys, modulo the table size."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")) % size


def assign(
    df: DataFrame,
    shards: list[str],
    keys: list[str],
    size: int = TABLE_SIZE,
    weights: list[int] | None = None,
) -> DataFrame:
    """Add ``slot``, ``shard`` and ``shard_name`` to each row."""
    table = lookup_table(df.sparkSession, fill_table(shards, size, weights), shards)
    rows = df.drop("slot", "shard", "shard_name").withColumn("slot", slot_of(keys, size))
    return rows.join(F.broadcast(table), "slot")


def write_shards(df: DataFrame, path: str, salts: int = 8) -> None:
    """Write assigned rows as one folder per shard, each by up to ``salts`` tasks."""
    salt = F.pmod(F.xxhash64("slot"), F.lit(salts))
    df.repartition("shard", salt).write.partitionBy("shard").parquet(path)
