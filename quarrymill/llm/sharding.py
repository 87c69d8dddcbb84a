"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table (an
offset and a step drawn from a hash of its name). The shards take turns, and at
each turn a shard claims the first slot of its permutation that is still free,
until the table is full: every shard gets an equal share within one slot, and
when a shard leaves or joins few slots change hands. A row goes to the shard
that owns the slot of its key's hash, so placement is one hash and one lookup.

The table has ``table_size`` rows whatever the input is, so it is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import table

TABLE_SIZE = 65_537
SHARDS = 256


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation of 0..size-1 (size is prime, so any step from 1 on visits every slot)."""
    raw = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(raw[:8], "big") % size, int.from_bytes(raw[8:16], "big") % (size - 1) + 1


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The owner of each slot, as an index into ``shards``; the shards take turns in the order given.

    Raises ValueError without shards, with more shards than slots, with a repeated name or a size that is no prime.
    """
    if not shards or len(shards) > size or len(set(shards)) != len(shards) or not is_prime(size):
        raise ValueError("needs distinct shards and a prime table size of at least their number")
    prefs = [preference(x, size) for x in shards]
    nxt, owner, free = [0] * len(shards), [-1] * size, size
    while True:
        for k, (offset, step) in enumerate(prefs):
            while owner[slot := (offset + nxt[k] * step) % size] >= 0:
                nxt[k] += 1
            owner[slot], nxt[k], free = k, nxt[k] + 1, free - 1
            if not free:
                return owner


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (long), ``shard`` (int, index into ``shards``) and ``shard_name``.

    Equal keys share a shard; a null key has the slot of the null hash. No row is lost or added, an empty table
    stays empty. Columns of ``df`` with the names of the new ones are replaced.
    """
    spark = df.sparkSession
    rows = [(i, k, shards[k]) for i, k in enumerate(fill_table(shards, size))]
    lookup = spark.createDataFrame(rows, "slot long, shard int, shard_name string")
    slotted = df.drop("slot", "shard", "shard_name").withColumn("slot", F.pmod(F.xxhash64(F.col(key)), F.lit(size)))
    return slotted.join(F.broadcast(lookup), "slot", "left").select(*[c for c in slotted.columns if c != "slot"], "slot", "shard", "shard_name")


def write_shards(df: DataFrame, path: str, key: str, shards: Sequence[str], size: int = TABLE_SIZE, parts: int = 8) -> None:
    """Writes one folder a shard (shard_name=...). Rows of a shard are dealt over ``parts`` tasks by their slot, so no shard meets in one task."""
    placed = assign_shards(df, key, shards, size)
    dealt = placed.repartition(F.col("shard"), F.pmod(F.col("slot"), F.lit(parts)))
    dealt.drop("slot", "shard").write.partitionBy("shard_name").parquet(path)


def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document: doc_id, slot, shard, shard_name."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, "doc_id", [f"shard-{i:04d}" for i in range(SHARDS)])
