"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table (an offset and
a step derived from its name; any step is coprime to a prime, so the order visits every slot).
Shards take turns, each claiming the first slot of its order that is still free, until the table
is full: slot counts differ by at most one, and adding or removing a shard moves few slots.
A row's shard is one lookup of ``hash(key) mod size``.

The table has exactly ``size`` rows whatever the data, which is the bound that allows it to be
broadcast; the placement itself is a narrow projection of the key with no shuffle.

Defined cases: a null key hashes like any other value (all null keys share one slot); equal keys
share a shard; an empty table gives no rows; with one shard every row goes to it. Repeated shard
names are refused, as is a size that is not prime or smaller than the number of shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """(offset, step) of a shard's slot order: slot j of the order is (offset + j*step) mod size."""
    h = hashlib.sha256(name.encode()).digest()
    offset = int.from_bytes(h[:8], "big") % size
    step = int.from_bytes(h[8:16], "big") % (size - 1) + 1 if size > 2 else 1
    return offset, step


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index into ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be non-empty and distinct")
    if not _is_prime(size) or size < len(shards):
        raise ValueError(f"table size {size} must be a prime of at least {len(shards)}")
    orders = [preference(s, size) for s in shards]
    nxt = [o for o, _ in orders]
    owner = np.full(size, -1, dtype=np.int32)
    free = size
    while free:
        for i, (_, step) in enumerate(orders):
            slot = nxt[i]
            while owner[slot] >= 0:
                slot = (slot + step) % size
            owner[slot] = i
            nxt[i] = (slot + step) % size
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: str | Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE,
          slot_out: str = "slot", shard_out: str = "shard") -> DataFrame:
    """Add the slot and the shard name of every row (columns of the same name are replaced)."""
    spark: SparkSession = df.sparkSession
    owner = lookup_table(shards, size)
    names = np.array(shards, dtype=object)
    slots = spark.createDataFrame(
        pd.DataFrame({slot_out: np.arange(size, dtype=np.int32), shard_out: names[owner]}),
        f"`{slot_out}` int, `{shard_out}` string")
    keep = [c for c in df.columns if c.lower() not in (slot_out.lower(), shard_out.lower())]
    keyed = df.select(*[F.col(f"`{c}`") for c in keep], slot_of(F.col(f"`{key}`"), size).alias(slot_out))
    return keyed.join(F.broadcast(slots), slot_out).select(*keep, slot_out, shard_out)


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8, shard: str = "shard") -> None:
    """Write one folder per shard. Each shard is dealt over ``files_per_shard`` tasks by the
    slot number, so no shard has to pass through a single task."""
    salt = F.pmod(F.xxhash64(F.col("slot"), F.lit(1)), F.lit(files_per_shard))
    placed.repartition(F.col(shard), salt).write.partitionBy(shard).parquet(path)
