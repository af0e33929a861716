"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has its own permutation of the table's slots (a start and a stride
from its name; the size is prime, so any stride reaches every slot). Shards take
turns, each claiming the first slot of its permutation that is still free, until
all are taken: shares differ by one slot at most, and when a shard comes or goes
few other slots change hands. Rows look their shard up under a hash of their key:
one broadcast of SIZE small rows, whatever the input, and no shuffle.

Defined results: a null key is placed as the empty string; equal keys go to one
shard; the table's columns are added as slot and shard, replacing columns of
those names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...], size: int = SIZE) -> list[int]:
    """The shard's index for each slot."""
    if not is_prime(size):
        raise ValueError(f"the table's size must be prime, {size} is not")
    if not 0 < len(set(shards)) == len(shards) <= size:
        raise ValueError("between one shard and as many as there are slots, each named once")
    at = [_number(f"start {s}") % size for s in shards]
    stride = [_number(f"stride {s}") % (size - 1) + 1 for s in shards]
    slots, taken = [-1] * size, 0
    while True:
        for k in range(len(shards)):
            while slots[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % size
            slots[at[k]] = k
            taken += 1
            if taken == size:
                return slots


def slot_of(key: Column, size: int = SIZE) -> Column:
    """60 bits of the key's MD5, modulo the size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """df with its rows' slot and shard."""
    rows = [(i, shards[k]) for i, k in enumerate(lookup_table(tuple(shards), size))]
    lookup = F.broadcast(df.sparkSession.createDataFrame(rows, "slot int, shard string"))
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return df.select(*kept, slot_of(F.col(key), size).alias("slot")).join(lookup, "slot").select(*kept, "slot", "shard")


def op5_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return place(docs.select("doc_id", "source", "n_chars"), "doc_id")


def oracle() -> str:
    slots = ", ".join(map(str, lookup_table(SHARDS)))
    return f"""
WITH t AS (SELECT unnest(generate_series(0, {SIZE - 1})) AS slot, unnest([{slots}]) AS k),
d AS (SELECT doc_id, source, n_chars, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SIZE})::INTEGER AS slot FROM documents)
SELECT doc_id, source, n_chars, slot, 'shard-' || lpad(k::VARCHAR, 3, '0') AS shard FROM d JOIN t USING (slot)
"""


QUERIES = {"op5_placement": op5_placement}
ORACLES = {"op5_placement": oracle()}
