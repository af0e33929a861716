"""Merging of several scored lists of one collection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SeekError
from ..functions.scoring import prioritize
from ..sources.numbering import numbered


def prioritized(lists: list[DataFrame], boost: float = 1.0, threshold: float = 1.0, keywords: int = 1) -> DataFrame:
    """seq, score of lists (seq, score): a repeat raises a score to old * 1.5 + new.

    threshold 1 keeps all, 0 those in `keywords` lists (all, of one keyword); in
    between, after the last of these so large a share of the others.
    """
    if boost == 0:
        raise SeekError("INVALID_BOOST_VALUE", boost)
    rows = None
    for i, df in enumerate(lists):
        one = df.select("seq", F.struct(F.lit(i).alias("i"), (F.col("score") * boost).alias("s")).alias("r"))
        rows = one if rows is None else rows.unionAll(one)
    # A document has at most one entry a list.
    sums = rows.groupBy("seq").agg(F.array_sort(F.collect_list("r")).alias("r"))
    sums = sums.select("seq", prioritize(F.transform("r", lambda x: x["s"])).alias("score"), F.size("r").alias("n"))
    if threshold == 1 or (threshold == 0 and keywords == 1):
        return sums.select("seq", "score")
    if threshold == 0:
        most = sums.agg(F.max("n")).scalar()
        return sums.where((F.col("n") == keywords) & (most == keywords)).select("seq", "score")
    # The best-matched documents come first; those with all keywords lead unless
    # some document has even more matches.
    total, whole, more = sums.agg(F.count("*"), F.count_if(F.col("n") == keywords), F.count_if(F.col("n") > keywords)).first()
    last = whole - 1 if whole and not more else 0
    keep = min(total, last + math.ceil(round(threshold * (total - last), 9)))
    placed = numbered(sums, "_n", [-F.col("n"), -F.round("score", 9), F.col("seq")])
    return placed.where(F.col("_n") <= keep).select("seq", "score")
