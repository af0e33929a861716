"""Retrieval measures: gain, precision, recall, reciprocal rank.

runs: query, doc, rank (1 the best); qrels: query, doc, rel. A document without a
judgement counts as 0; a query without a result still counts, with 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(runs: DataFrame, qrels: DataFrame, k: int = 10, k_long: int = 100) -> DataFrame:
    """query, ndcg, map, recall, precision, mrr; null where a query has nothing to find.

    ndcg, precision and mrr are cut at k, map and recall at k_long.
    """
    judged = qrels.groupBy("query", "doc").agg(F.max("rel").alias("rel"))
    found = runs.where(F.col("rank") <= max(k, k_long)).join(judged, ["query", "doc"], "left").select("query", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))
    hit = (F.col("rel") > 0).cast("int")
    so_far = F.sum(hit).over(Window.partitionBy("query").orderBy("rank"))
    found = found.withColumn("hits", so_far)
    in_k = F.col("rank") <= k
    sums = found.groupBy("query").agg(
        F.sum(F.when(in_k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rank") <= k_long, hit * F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(F.col("rank") <= k_long, hit).otherwise(0)).alias("found"),
        F.sum(F.when(in_k, hit).otherwise(0)).alias("found_k"),
        F.min(F.when(in_k & (F.col("rel") > 0), F.col("rank"))).alias("first"),
    )
    # Only the k best judgements make the ideal: the numbering is cut before it is shuffled.
    best = judged.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel")))).where(F.col("r") <= k)
    ideal = best.groupBy("query").agg(F.sum(F.col("rel") / F.log2(F.col("r") + 1)).alias("ideal"))
    relevant = judged.groupBy("query").agg(F.sum((F.col("rel") > 0).cast("int")).alias("relevant"))
    rows = relevant.join(ideal, "query").join(sums, "query", "left").na.fill(0, ["dcg", "precisions", "found", "found_k"])
    any_ = F.col("relevant") > 0
    return rows.select(
        "query",
        F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).alias("ndcg"),
        F.when(any_, F.col("precisions") / F.col("relevant")).alias("map"),
        F.when(any_, F.col("found") / F.col("relevant")).alias("recall"),
        (F.col("found_k") / k).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def evaluate(runs: DataFrame, qrels: DataFrame, k: int = 10, k_long: int = 100) -> DataFrame:
    """One row: the means of the measures over the queries that have them."""
    names = ("ndcg", "map", "recall", "precision", "mrr")
    return per_query(runs, qrels, k, k_long).agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])
