"""Two other rankers: by shared sentences, and by the place of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.index import Index, field_text

MOST_SENTENCES = 20
BUCKETS = 15


def sentence_postings(index: Index, prop: str) -> DataFrame:
    """seq, term, n (sentences with it), mask (of sentences), total."""
    text = field_text(index.docs, prop, index.schema.fields[prop])
    parts = F.split(F.coalesce(text, F.lit("")), r"[.?!]")
    rows = index.docs.where(F.col(prop).isNotNull()).select("seq", F.posexplode(parts).alias("s", "sentence"))
    rows = rows.select("seq", "s", F.array_distinct(index.analyzer.words(F.col("sentence"), prop)).alias("w"))
    # A sentence of one word or none does not move the count on.
    before = F.coalesce(F.sum((F.size("w") > 1).cast("int")).over(Window.partitionBy("seq").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("bit", F.least(before, F.lit(MOST_SENTENCES)).cast("int"))
    total = F.sum(F.size("w")).over(Window.partitionBy("seq"))
    rows = rows.withColumn("total", total).select("seq", "bit", "total", F.explode("w").alias("term"))
    early = F.col("bit") < MOST_SENTENCES
    bit = F.when(early, F.call_function("shiftleft", F.lit(1), F.col("bit"))).otherwise(0)
    sums = rows.groupBy("seq", "term", "total").agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"), F.bit_or(bit).alias("mask"))
    # The bit of late sentences is the lowest bit of the count: each sets it.
    n = F.when(F.col("b") == 0, F.col("a")).otherwise(F.col("a") + 1 + F.col("a") % 2 + 2 * (F.col("b") - 1))
    return sums.select("seq", "term", "total", n.alias("n"), "mask")


def by_sentences(index: Index, term: str, props: list[str], exact: bool = False, tolerance: int = 0, boost: dict | None = None) -> DataFrame:
    """seq, score: occurrences squared over length, whole words one more, and twice
    the sentences that a word shares with the words before it.

    Whatever their order, words share sentences with those before them as often as
    their sentences' number is above that of their union: a plain aggregate.
    """
    from .expand import matches

    tokens = list(dict.fromkeys(index.analyzer.tokens(term))) or [""]
    found = None
    for prop in props:
        rows = sentence_postings(index, prop)
        hit = F.lit(False)
        for t in tokens:
            hit = hit | matches(t, exact, tolerance)
        score = (F.col("n") * F.col("n") / F.col("total") + F.col("term").isin(tokens).cast("int")) * float((boost or {}).get(prop, 1))
        part = rows.where(hit).select("seq", score.alias("s"), "mask")
        found = part if found is None else found.unionAll(part)
    shared = F.sum(F.bit_count("mask")) - F.bit_count(F.bit_or("mask"))
    return found.groupBy("seq").agg((F.sum("s") + 2 * shared).alias("score"))


def by_position(index: Index, term: str, props: list[str], boost: dict | None = None) -> DataFrame:
    """seq, score: words near a field's start count 14, at its end 0; prefixes match."""
    tokens = list(dict.fromkeys(index.analyzer.tokens(term)))
    out = None
    for prop in props:
        words = F.array_distinct(index.analyzer.words(field_text(index.docs, prop, index.schema.fields[prop]), prop))
        rows = index.docs.where(F.col(prop).isNotNull()).select("seq", words.alias("w")).select("seq", F.size("w").alias("n"), F.posexplode("w").alias("i", "term"))
        place = F.when(F.col("n") < BUCKETS, F.col("i")).otherwise(F.floor(F.col("i") * BUCKETS / F.col("n")))
        weight = (BUCKETS - 1 - place) * float((boost or {}).get(prop, 1))
        hits = sum((F.col("term").startswith(t).cast("int") for t in tokens), F.lit(0))
        part = rows.select("seq", (weight * hits).alias("w"), hits.alias("h")).where("h > 0").select("seq", "w")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("seq").agg(F.sum("w").cast("double").alias("score"))
