"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table
(``offset + j * skip`` modulo the size, both from the shard's name).  The
shards take turns, each claiming its next preferred slot that is still
free, until the table is full.  So slot counts differ by one at most, and
adding or removing a shard moves few keys.  The table is a parameter-sized
array (``slots`` entries whatever the corpus), broadcast as one row; a
document is placed by one hash and one array read, with no shuffle.

Cases.  The key is the document id; a null id is placed by its text, a null
text counting as empty.  Repeated rows and equal keys go to the same shard.
An empty table gives an empty result.  Input columns called ``slot`` or
``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537       # a prime, well above the number of shards
SHARDS = 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(n_shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of every slot."""
    if not 0 < n_shards <= slots or any(slots % p == 0 for p in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime, at least the number of shards")
    at = [_number(f"offset-{s}") % slots for s in range(n_shards)]
    skip = [_number(f"skip-{s}") % (slots - 1) + 1 for s in range(n_shards)]
    owner, free = [-1] * slots, slots
    while free:
        for s in range(n_shards):
            while owner[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            owner[at[s]] = s
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digits = F.substring(F.md5(key.cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every row of ``docs`` with its ``slot`` and ``shard``."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]
    owners = spark.createDataFrame([(lookup_table(n_shards, slots),)], "__owners array<int>")
    placed = docs.select(*keep, slot_of(key, slots).alias("slot"))
    return (placed.join(F.broadcast(owners))
            .withColumn("shard", F.get("__owners", F.col("slot"))).drop("__owners"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, slots: int = SLOTS) -> None:
    """Write one folder per shard.  Each shard is dealt over several tasks by
    the slot, so that none holds a whole shard of a large corpus."""
    (shard_documents(docs, n_shards, slots).repartition("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def oracle(n_shards: int = SHARDS, slots: int = SLOTS) -> str:
    owners = ",".join(map(str, lookup_table(n_shards, slots)))
    return f"""
WITH t AS (SELECT [{owners}] AS owners),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS slot
      FROM documents)
SELECT doc_id, slot, CAST(owners[slot + 1] AS INTEGER) AS shard FROM d, t"""
