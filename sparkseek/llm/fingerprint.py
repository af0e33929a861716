"""Threshold-scaled document fingerprints, in DataFrame functions alone.

A fingerprint keeps the hash of every shingle (five words, or the whole of a
shorter text) that lies in the lowest 1 / SCALE of the hash space. A text none of
whose hashes lies there keeps its least one, which drops out when sketches with
others are merged. So the sketch of a union is the merged sketch, and containment
can be estimated between documents of any two sizes.

A fingerprint is text: the kept hashes in order, 16 hexadecimal digits each.

Defined results: null counts as the empty text, whose fingerprint is '' (alike 1
to another empty one, 0 to any other); the next document of the last is the
first; with one document it is its own next; a null doc_id is the least; rows
that share a doc_id follow each other in an order given by their texts' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SCALE = 8
SHINGLE = 5


#: Java's and C's ASCII white space.
_SPACE = " \t\n\x0b\f\r"


def with_sketch(rows: DataFrame, text: str, out: str, scale: int = SCALE, shingle: int = SHINGLE) -> DataFrame:
    """rows with the sketch of a text column: sorted distinct kept hashes.

    Each step is a column of its own: what a lambda refers to is then a field, not
    an expression that is worked out again for every element.
    """
    lowest = F.lit(-(1 << 63) + (1 << 64) // scale)
    rows = rows.withColumn("_trimmed", F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_SPACE)))
    rows = rows.withColumn("_words", F.when(F.col("_trimmed") != "", F.split("_trimmed", r"[ \t\n\x0B\f\r]+")).otherwise(F.array().cast("array<string>"))).drop("_trimmed")
    n = F.size("_words")
    chained = F.transform(F.slice("_words", 1, n - (shingle - 1)), lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, shingle)]))
    # A shorter text is one shingle: its words in a row.
    every = F.when(n >= shingle, chained).otherwise(F.transform(F.slice("_words", 1, F.least(n, F.lit(1))), lambda w: F.xxhash64(F.array_join("_words", " "))))
    rows = rows.withColumn("_every", every).withColumn("_low", F.filter("_every", lambda h: h < lowest))
    kept = F.when((F.size("_low") > 0) | (F.size("_every") == 0), F.col("_low")).otherwise(F.array(F.array_min("_every")))
    return rows.withColumn(out, F.array_sort(F.array_distinct(kept))).drop("_words", "_every", "_low")


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two sketches: shared by all kept hashes."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both texts' shingles."""
    lowest = F.lit(-(1 << 63) + (1 << 64) // scale)
    every = F.array_sort(F.array_union(a, b))
    low = F.filter(every, lambda h: h < lowest)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(every, 1, 1))


#: Documents a block: blocks are windows, so this bounds what a task sorts. Beyond
#: BLOCK_ROWS x MOST_BLOCKS documents blocks grow instead, and their windows spill.
BLOCK_ROWS = 500
MOST_BLOCKS = 100_000


def in_blocks(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs (with id0, no nulls) dealt into blocks of neighbouring ids, descending.

    The first documents of a block are guests (guest > 0) at the end of the block
    before, as the very first are at the end of the last. So each block has all
    that comes after its own rows, and rows are shuffled once.
    """
    ids = docs.select("id0")
    blocks = min(max(1, -(-ids.count() // block_rows)), MOST_BLOCKS)
    cuts, n = F.array().cast("array<bigint>"), F.lit(0)
    if blocks > 1:
        shares = F.expr(f"array({','.join(f'{k / blocks!r}D' for k in range(1, blocks))})")
        found = ids.agg(F.array_distinct(F.percentile_approx("id0", shares, max(10_000, 20 * blocks))).alias("c"))
        cuts, n = F.coalesce(found.scalar(), cuts), F.coalesce(found.select(F.size("c")).scalar(), n)
    top = ids.agg(F.max("id0").alias("top")).scalar()
    # A column of cuts is used once, so that Spark puts the array where it is used; else
    # every row would take a copy along.
    # How many cuts are below an id, by halves.
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_BLOCKS.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda at, s: at + F.when(F.get("cuts", at + s - 1) < F.col("id0"), s).otherwise(0))
    placed = docs.withColumn("cuts", cuts).withColumn("below", below).drop("cuts")
    placed = placed.withColumn("cuts", cuts).withColumn("first", F.get("cuts", F.col("below"))).drop("cuts")
    placed = placed.withColumn("block", n - F.col("below")).withColumn("top", F.col("id0") == top).withColumn("n", n)
    seats = F.array_compact(
        F.array(
            F.struct(F.col("block"), F.lit(0).alias("guest")),
            F.when(F.col("first") == F.col("id0"), F.struct((F.col("block") - 1).alias("block"), F.lit(1).alias("guest"))),
            F.when(F.col("top"), F.struct(F.col("n").alias("block"), F.lit(2).alias("guest"))),
        )
    )
    return placed.withColumn("seat", F.explode(seats)).drop("block").select(*docs.columns, "seat.block", "seat.guest").repartition("block")


def edited_pairs(docs: DataFrame, scale: int = SCALE, shingle: int = SHINGLE) -> DataFrame:
    """Each document beside its edited text and its next document's sketch."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id0"), "text")
    rows = with_sketch(in_blocks(base), "text", "sketch", scale, shingle).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("block").orderBy("guest", F.desc("id0"), F.desc("h"))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where("guest = 0")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    both = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    return with_sketch(both.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch", scale, shingle)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLES: dict[str, str] = {}
