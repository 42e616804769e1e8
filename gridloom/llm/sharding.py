"""Consistent sharding with a permutation-filled lookup table (DataFrame functions only).

Each shard has a preference order over the slots of a prime-sized table: an
offset and a stride from its name's hash.  Shards take turns claiming their
next free slot until the table is full, so shares differ by one slot at most,
and adding or removing a shard moves few slots.  A key's slot is a hash modulo
the table size; a broadcast of the table (its size is a parameter of at most
``MAX_SLOTS``) places it in constant time, without a shuffle.

Defined results: a null key has the slot of the empty string, so it is placed
too; repeated rows are placed alike; an empty input gives an empty result.
Added columns replace nothing: a clash with an existing name is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SLOTS = 1 << 20


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int) -> list[int]:
    """Index of the shard that owns each slot."""
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"the table needs a prime number of slots up to {MAX_SLOTS}")
    if not shards or len(shards) > slots or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, and no more of them than slots")
    offset = [_hash(f"offset:{s}") % slots for s in shards]
    stride = [_hash(f"stride:{s}") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for shard in range(len(shards)):
            while owner[offset[shard]] >= 0:
                offset[shard] = (offset[shard] + stride[shard]) % slots
            owner[offset[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the key's MD5, modulo the table size; the same in any SQL engine."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = 16381) -> DataFrame:
    """df with ``slot`` (int) and ``shard`` (its owner's name)."""
    if clash := {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    table = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(fill_table(shards, slots))], "slot int, shard string")
    return df.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot", "left").select(*df.columns, "slot", "shard")


SHARDS, SLOTS = [f"shard-{i:03d}" for i in range(64)], 16381


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id", SHARDS, SLOTS)


ORACLE = f"""
WITH t AS (SELECT {fill_table(SHARDS, SLOTS)} AS owner),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, printf('shard-%03d', owner[slot + 1]) AS shard FROM d, t
"""
