"""Placement by a permutation-filled lookup table, in DataFrame functions only.

Every shard has its own permutation of the slots of a prime-sized table. The shards take turns; in its turn a
shard claims the first slot of its permutation that is still free, until the table is full. Shares then differ by
one slot at most, and adding or removing a shard moves few slots between the others. The table has a fixed size;
it is broadcast, and a row is placed by one lookup of its key's digest.
"""

import hashlib
import math

from pyspark.sql import Column, DataFrame, functions as F

from embgauge.llm.shared import free_name

#: Slots in a table, at most: what is broadcast stays under about 16 MB.
MOST_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))


def digest(text: str) -> int:
    """The first 60 bits of the MD5 of a string; ``slot_of`` has the same in Spark."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int) -> list[str]:
    """The shard of each slot. The order of ``shards`` does not matter; names must differ."""
    if not is_prime(slots) or not len(set(shards)) == len(shards) <= slots <= MOST_SLOTS or not shards:
        raise ValueError("slots must be a prime up to MOST_SLOTS, and shards distinct, at least one and no more than slots")
    names = sorted(shards)
    start = [digest(f"{name}:offset") % slots for name in names]
    step = [digest(f"{name}:skip") % (slots - 1) + 1 if slots > 2 else 1 for name in names]
    table: list[str | None] = [None] * slots
    left = slots
    while left:
        for k, name in enumerate(names[:left] if left < len(names) else names):
            while table[start[k]] is not None:
                start[k] = (start[k] + step[k]) % slots
            table[start[k]] = name
            left -= 1
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: its digest modulo the table's size. A null key is an empty one."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, shards: list[str], key_col: str, slots: int = 65537) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` as its last columns; no row moves.

    Equal keys share a slot; null keys are placed like empty ones. An empty table stays empty. All columns of ``df``
    stay; where one has the name of a new column, the new one's gets underscores (``slot_``).
    """
    spark = df.sparkSession
    table = lookup_table(shards, slots)
    slot, shard = (free_name(df.columns, c) for c in ("slot", "shard"))
    at = free_name([*df.columns, slot, shard], "at")
    known = spark.createDataFrame(list(enumerate(table)), f"{at} int, {shard} string")
    # at most MOST_SLOTS short rows
    placed = df.withColumn(slot, slot_of(F.col(key_col), slots))
    return placed.join(F.broadcast(known), F.col(slot) == F.col(at)).drop(at)
