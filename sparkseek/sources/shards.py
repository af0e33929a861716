"""Placement of documents on shards, and summaries by which shards are skipped.

A shard is a partition of a table. Scores use the whole collection's statistics,
so they are the same however documents are placed; summaries only save reading.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Fixed values of the 32-bit FNV-1a hash.
FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193


def fnv1a32(text: Column) -> Column:
    """FNV-1a over a text's UTF-16 units, as the values of shard routing are fixed."""

    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(unit) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))

    def char(h: Column, c: Column) -> Column:
        cp = F.ascii(c).cast("long")
        high = F.lit(0xD800) + F.shiftright(cp - 0x10000, 10)
        low = F.lit(0xDC00) + (cp - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(cp < 0x10000, step(h, cp)).otherwise(step(step(h, high), low))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(FNV_START).cast("long"), char)


#: Fixed values of the finalizer of the 32-bit murmur3 hash.
FINAL_1, FINAL_2 = 0x85EBCA6B, 0xC2B2AE35


def _times32(h: Column, factor: int) -> Column:
    """The lower 32 bits of a product, by halves: no long overflows."""
    upper = (F.shiftright(h, 16) * factor).bitwiseAND(F.lit(0xFFFF)) * 65_536
    return (upper + h.bitwiseAND(F.lit(0xFFFF)) * factor).bitwiseAND(F.lit(0xFFFFFFFF))


def mixed32(h: Column) -> Column:
    """A 32-bit hash (as a long) with all bits spread, for Bloom filters of words."""
    for shift, factor in ((16, FINAL_1), (13, FINAL_2)):
        h = _times32(h.bitwiseXOR(F.shiftright(h, shift)), factor)
    return h.bitwiseXOR(F.shiftright(h, 16))


def shard_of(doc_id: Column, shards: int) -> Column:
    return F.pmod(fnv1a32(doc_id), F.lit(shards)).cast("int")


def route(docs: DataFrame, shards: int, key: str = "id") -> DataFrame:
    """docs with `shard`."""
    return docs.withColumn("shard", shard_of(F.col(key).cast("string"), shards))


def write_sharded(docs: DataFrame, path: str, shards: int, key: str = "id") -> None:
    """One folder a shard; rows of a shard may lie in several files, so a large
    shard is no single task's."""
    route(docs, shards, key).write.mode("overwrite").partitionBy("shard").parquet(path)


def packed_partitions(docs: DataFrame, by: str, most: int = 5_000) -> DataFrame:
    """by, n, shard: small partitions share a shard of about `most` documents.

    A partition's shard follows from how many documents lie in the partitions
    before it, by name; one larger than `most` has a shard to itself.
    """
    from .numbering import numbered

    sizes = docs.groupBy(by).agg(F.count("*").alias("n"))
    rows = numbered(sizes, "place", [F.col(by)])
    from pyspark.sql import Window

    # Sums of blocks of places, then within a block: no window spans all partitions' rows.
    block = F.floor(F.col("place") / 65_536)
    rows = rows.withColumn("block", block)
    blocks = rows.groupBy("block").agg(F.sum("n").alias("bn"))
    starts = blocks.select("block", F.coalesce(F.sum("bn").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(starts), "block").select(by, "n", F.floor((before + F.col("start")) / most).cast("long").alias("shard"))


# -- summaries -----------------------------------------------------------------------------


def number_ranges(docs: DataFrame, shard: str, props: list[str]) -> DataFrame:
    """shard, then the least and greatest value of each number."""
    return docs.groupBy(shard).agg(*[f(p).alias(f"{n}_{p}") for p in props for n, f in (("min", F.min), ("max", F.max))])


def may_match(ranges: DataFrame, prop: str, op: str, value) -> DataFrame:
    """The shards some document of which can pass the comparison."""
    low, high = F.col(f"min_{prop}"), F.col(f"max_{prop}")
    test = {
        "gt": lambda: high > value, "gte": lambda: high >= value, "lt": lambda: low < value, "lte": lambda: low <= value,
        "eq": lambda: (low <= value) & (high >= value), "between": lambda: (low <= value[1]) & (high >= value[0]),
    }
    return ranges.where(test[op]())


def cones(rows: DataFrame, shard: str, size: int) -> DataFrame:
    """shard, centroid, angle: a cone that holds all of a shard's vectors (v).

    The centroid is the scaled sum of the unit vectors, the angle the largest to
    it; a shard whose vectors are all zero has the widest cone.
    """
    unit = V.let(V.magnitude(F.col("v")), lambda m: F.when(m > 0, F.transform("v", lambda x: x.cast("double") / m)))
    units = rows.select(shard, unit.alias("u"))
    sums = units.groupBy(shard).agg(*[F.sum(F.get("u", i)).alias(f"s{i}") for i in range(size)], F.max(F.col("u").isNull().cast("int")).alias("has_zero"))
    sums = sums.select(shard, F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(size)]).alias("s"), "has_zero").withColumn("_m", V.magnitude(F.col("s")))
    centres = sums.select(shard, F.transform("s", lambda x: F.when(F.col("_m") > 0, x / F.col("_m")).otherwise(0.0)).alias("centroid"), "has_zero", (F.col("_m") > 0).alias("_ok"))
    widest = units.where("u IS NOT NULL").join(F.broadcast(centres), shard).groupBy(shard).agg(F.max(F.acos(V.clamped(V.dot(F.col("u"), F.col("centroid"))))).alias("a"))
    return centres.join(widest, shard, "left").select(shard, "centroid", F.when(F.col("_ok") & F.col("a").isNotNull(), F.col("a")).otherwise(math.pi).alias("angle"), (F.col("has_zero") == 1).alias("has_zero"))


def upper_bound(query: list[float], centroid: Column, angle: Column, has_zero: Column) -> Column:
    """No vector of the cone is more similar to the query than this."""
    to = F.acos(V.clamped(V.dot(centroid, V.literal(query))))
    best = F.cos(F.greatest(F.lit(0.0), to - angle))
    return F.when(angle >= math.pi, 1.0).when(has_zero, F.greatest(best, F.lit(0.0))).otherwise(best)


def probed(bounds: DataFrame, query: list[float], similarity: float, most: int, shard: str = "shard") -> DataFrame:
    """Of the surviving shards the `most` whose centroids are nearest: fewer reads, and
    matches in other shards are not found."""
    near = surviving(bounds, query, similarity).withColumn("nearness", V.dot(F.col("centroid"), V.literal(query)))
    return near.orderBy(F.desc(F.round("nearness", 9)), shard).limit(max(1, most))


def surviving(bounds: DataFrame, query: list[float], similarity: float) -> DataFrame:
    """The shards that can hold a vector so similar, with their bound."""
    return bounds.withColumn("bound", upper_bound(query, F.col("centroid"), F.col("angle"), F.col("has_zero"))).where(F.col("bound") >= similarity)
