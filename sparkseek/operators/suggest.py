"""Completion of a partial query from the words of matching documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Bm25
from ..sources.index import Index
from .bm25 import TextQuery, events, query_tokens, searched
from .expand import matched


def suggest(index: Index, term: str, properties="*", prefix: bool | str = True, tolerance: int = 0, threshold: float = 0, boost=None, relevance: Bm25 = Bm25(), allowed: DataFrame | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """suggestion, score, count.

    In each document a word of the query stands for its best match; the last word
    gives a suggestion for each of its matches.
    """
    q = TextQuery(term, properties, relevance=relevance, boost=boost, tolerance=tolerance)
    props = searched(index, properties)
    tokens = query_tokens(index, q, props)
    # The word to complete is the last one typed, even where it repeats an earlier one.
    typed = index.analyzer.tokens(term)
    if typed:
        tokens = [t for t in tokens if t != typed[-1]] + [typed[-1]]
    if tokens == [""]:
        return index.spark.createDataFrame([], "suggestion string, score double, count long")
    last = len(tokens) - 1
    found = None
    for i, t in enumerate(tokens):
        whole = prefix is False or (prefix == "last" and i < last)
        words = TextQuery(t, properties, relevance=relevance, boost=boost, tolerance=tolerance, prefix=not whole)
        part = _words(index, words, t, i, props)
        found = part if found is None else found.unionAll(part)
    if allowed is not None:
        found = found.join(allowed.select("seq"), "seq", "left_semi")
    # A word of several fields: the best word by one field's score, completions by all.
    best = found.groupBy("seq", "i").agg(F.max_by("term", F.struct("w", F.col("order"))).alias("word"), F.max("w").alias("w"), F.sum("w").alias("all"))
    docs = best.groupBy("seq").agg(
        F.array_sort(F.collect_list(F.struct("i", "word", "w"))).alias("b"), F.count("*").alias("n"), F.sum("all").alias("total")
    )
    if threshold > 0:
        partial = docs.where(F.col("n") < len(tokens))
        take = math.ceil(round(min(threshold, 1) * partial.count(), 9))
        docs = docs.where(F.col("n") == len(tokens)).unionAll(partial.orderBy(F.desc(F.round("total", 9)), "seq").limit(take))
    else:
        docs = docs.where(F.col("n") == len(tokens))
    names = F.array(*[F.coalesce(F.get(F.filter("b", lambda x, i=i: x["i"] == i), 0)["word"], F.lit(t)) for i, t in enumerate(tokens[:-1])]) if last else F.array().cast("array<string>")
    context = F.aggregate(F.filter("b", lambda x: x["i"] < last), F.lit(0.0), lambda s, x: s + x["w"])
    ends = found.where(F.col("i") == last).groupBy("seq", "term").agg(F.sum("w").alias("w"))
    rows = docs.select("seq", names.alias("names"), context.alias("c")).join(ends, "seq", "left")
    phrase = F.array_join(F.concat("names", F.array(F.coalesce("term", F.lit(tokens[-1])))), " ")
    rows = rows.select(phrase.alias("suggestion"), (F.col("c") + F.coalesce("w", F.lit(0.0))).alias("s"))
    out = rows.groupBy("suggestion").agg(F.sum("s").alias("score"), F.count("*").alias("count"))
    return out.orderBy(F.desc(F.round("score", 9)), F.desc("count"), "suggestion").offset(offset).limit(limit)


def _words(index: Index, q: TextQuery, token: str, i: int, props: list[str]) -> DataFrame:
    """seq, i, term, w, order: matches of one word; order prefers smaller words."""
    from ..functions.scoring import bm25

    for_check = [p for p in props if (q.boost or {}).get(p, 1) <= 0]
    if for_check:
        return events(index, q, [token], props)
    exact = not q.prefix and not q.tolerance
    post = matched(index, [token], props, exact, q.tolerance, q.boost)
    if not q.prefix and q.tolerance:
        post = post.where(F.levenshtein("term", F.lit(token), q.tolerance) >= 0)
    weight = bm25(F.col("tf"), F.col("idf"), F.col("len"), F.col("average"), q.relevance) * F.col("demotion") * F.col("boost")
    # Ends above all signs, so that of two words one of which begins the other the shorter is preferred.
    inverse = F.concat(F.transform(F.split("term", ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))
    return post.select("seq", F.lit(i).alias("i"), "term", weight.alias("w"), inverse.alias("order"))
