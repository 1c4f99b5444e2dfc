"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, from two hashes of its name. The
shards take turns; each claims the first slot of its permutation that is still free, until the table is
full. Slots are then spread evenly (the counts differ by one at most) and adding or removing a shard moves
few others. A document's slot is a hash of its key modulo the table size, so placement is one look-up in a
broadcast table whose size is fixed by a parameter, not by the data: no shuffle, no hot key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import doc_key, table

SHARDS = 64
#: A prime of over a hundred slots for each shard.
SLOTS = 65_537
#: The table is broadcast; a larger one is refused.
MOST_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot."""
    if not _is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"the table size must be a prime of at most {MOST_SLOTS}, not {slots}")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards need different names and a table with a slot for each")
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """The first 60 bits of the key's MD5, modulo the table size; a null key counts as the word null."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % F.lit(slots)


def shard_names(shards: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(shards)]


def slot_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(_slot, _shard), a row for each slot."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("_slot", "_shard")).select(F.col("_slot").cast("long"), F.col("_shard").cast("int"))


def place(docs: DataFrame, key: Column, shards: list[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``docs`` with the slot and the shard number of every row.

    Every row is kept and placed: rows with equal keys share a shard, a null key has a slot like any other,
    empty input gives empty output. Columns of the input that are called ``slot`` or ``shard`` are replaced.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (slot.lower(), shard.lower())]
    keyed = docs.select(F.struct(*own).alias("_row"), slot_of(key, slots).alias("_slot"))
    placed = keyed.join(F.broadcast(slot_table(docs.sparkSession, shards, slots)), "_slot", "left")
    return placed.select("_row.*", F.col("_slot").alias(slot), F.col("_shard").alias(shard))


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Stage: all columns of the documents plus slot and shard. Rows without an id go by their text."""
    return place(docs, doc_key(F.col("doc_id"), F.col("text")), shard_names(SHARDS))


def op10_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return place(docs, doc_key(F.col("doc_id"), F.col("text")), shard_names(SHARDS)).select("doc_id", "slot", "shard")
